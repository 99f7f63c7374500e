"""Exact duplicates through an extendible-hash index kept in the shared folder.

Tasks first write segments: every row with the hash key of its text without
white space; the text itself travels once per run of equal texts in a task (its
carrier), so copies are combined before any shuffle.  Of a text that very many
tasks carry, groups of carriers are compared first, so that a few of each group
reach the owner.  A histogram of keys grows the directory: while a bucket holds
more bytes than its capacity it is split, and the directory doubles when the
bucket is as deep as the directory.  Each owner task then reads the key range of
its buckets in key order, keeps a chain of the different texts under one key,
and compares bytes along it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .shared import Scratch, partitions, whole

#: Bytes of text that a bucket holds before it is split.
CAPACITY = 32 << 20
#: Bytes of different texts that a task remembers; beyond, it starts a new run.
REMEMBER = 16 << 20
MAX_DEPTH = 20
#: Carriers of one key from which they are compared in groups first.
MANY = 64
_DELETE = T.WHITE.encode()


class Directory:
    """Extendible-hash directory over the leading bits of 64-bit keys."""

    def __init__(self, capacity: int, max_depth: int = MAX_DEPTH):
        self.capacity, self.max_depth = capacity, max_depth
        self.depth, self.cells, self.buckets = 0, [0], [(0, 0)]  # bucket: (depth, prefix)

    def grow(self, weights: np.ndarray) -> "Directory":
        """Split by a histogram over 2**d leading-bit cells; d bounds the depth."""
        d = int(len(weights)).bit_length() - 1
        below = np.concatenate(([0], np.cumsum(weights)))
        todo = [0]
        while todo:
            b = todo.pop()
            depth, prefix = self.buckets[b]
            width = 1 << (d - depth)
            if depth >= min(d, self.max_depth) or below[(prefix + 1) * width] - below[prefix * width] <= self.capacity:
                continue
            if depth == self.depth:  # directory doubling
                self.cells = [c for c in self.cells for _ in (0, 1)]
                self.depth += 1
            self.buckets[b] = (depth + 1, 2 * prefix)
            self.buckets.append((depth + 1, 2 * prefix + 1))
            new, span = len(self.buckets) - 1, 1 << (self.depth - depth - 1)
            at = (2 * prefix + 1) * span
            self.cells[at : at + span] = [new] * span
            todo += [b, new]
        return self

    def bucket(self, key: int) -> int:
        return self.cells[(key & (1 << 64) - 1) >> (64 - self.depth)] if self.depth else 0

    def table(self, spark: SparkSession) -> DataFrame:
        """(cell, bucket); at most 2**max_depth rows."""
        return spark.createDataFrame(list(enumerate(self.cells)), "cell long, bucket int")


def _segments(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        seen: dict[bytes, tuple[int, int]] = {}
        held = row = 0
        for batch in batches:
            buf, offs = T.flat(batch.column("text"))
            points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
            view = memoryview(buf)
            keys, carriers, texts, shas = [], [], [], []
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
                plain = bytes(view[a:b]).translate(None, _DELETE)
                found = seen.get(plain)
                if found is None:
                    if held > REMEMBER:
                        seen, held = {}, 0
                    found = seen[plain] = (base + row, xxhash.xxh64_intdigest(plain))
                    held += len(plain) + 200
                    texts.append(plain)
                    shas.append(hashlib.sha256(plain).hexdigest())
                else:
                    texts.append(None)
                    shas.append(None)
                carriers.append(found[0])
                keys.append(found[1])
                row += 1
            n = len(keys)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.arange(row - n, row) + base), pa.array(carriers, pa.int64()), pa.array(T.signed(keys)), pa.array(points[offs[1:]] - points[offs[:-1]]), batch.column("h"), pa.array(texts, pa.binary()), pa.array(shas, pa.string())],
                ["doc_id", "row_id", "carrier", "key", "n_points", "h", "plain", "sha"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h")).mapInArrow(T.lean(run), "doc_id long, row_id long, carrier long, key long, n_points long, h long, plain binary, sha string")


def _owners(carriers: DataFrame, buckets: int) -> DataFrame:
    """(carrier, leader): leader is one carrier of equal bytes, the same for all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chain = None, []
        for batch in batches:
            own, lead = [], []
            for key, carrier, plain in zip(batch.column("key").to_pylist(), batch.column("carrier").to_pylist(), batch.column("plain")):
                plain = plain.as_py()
                if key != at:
                    at, chain = key, []
                leader = next((c for c, other in chain if other == plain), None)
                if leader is None:
                    leader = carrier
                    chain.append((carrier, plain))
                own.append(carrier)
                lead.append(leader)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(lead, pa.int64())], ["carrier", "leader"])

    return carriers.repartitionById(buckets, "bucket").sortWithinPartitions("key", "carrier").select("key", "carrier", "plain").mapInArrow(T.lean(run), "carrier long, leader long")


def _thinned(carriers: DataFrame, scratch: Scratch, many: int) -> tuple[DataFrame, DataFrame | None]:
    """(carriers, (carrier, stands)): of keys with over `many` carriers, groups of them are compared, and one of equal bytes stands for each group."""
    count = carriers.groupBy("key").agg(F.count("*").alias("c")).where(f"c > {many}")
    count = scratch.put("many", count)
    if count.isEmpty():
        return carriers, None
    groups = F.ceil(F.sqrt("c"))
    hot = carriers.join(count.hint("merge"), "key").withColumn("bucket", F.pmod(F.xxhash64("key", F.pmod(F.xxhash64("carrier"), groups)), F.lit(1 << 30)))
    tasks = partitions(scratch.spark)
    owned = _owners(hot.withColumn("bucket", F.pmod("bucket", F.lit(tasks)).cast("int")).select("bucket", F.xxhash64("key", "bucket").alias("key"), "carrier", "plain"), tasks)
    stands = scratch.put("stands", owned.select("carrier", F.col("leader").alias("stands")))
    fewer = carriers.join(stands.where("carrier <> stands").select("carrier"), "carrier", "left_anti")
    return scratch.put("carriers", fewer.select("key", "carrier", "plain")), stands


def decisions(docs: DataFrame, capacity: int = CAPACITY, many: int = MANY) -> DataFrame:
    """One row per row of docs: doc_id, h, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; null counts as empty.
    Of equal texts the row with the most code points stays, then the smallest
    doc_id, nulls last; of rows that repeat both, exactly one stays.  h is the
    xxhash64 of the original text.  A very long text is held whole by its owner.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dup")
    seg = scratch.put("segments", _segments(docs))
    carriers, stands = _thinned(seg.where("carrier = row_id"), scratch, many)
    total = carriers.agg(F.sum(F.octet_length("plain") + 64)).first()[0] or 0
    d = min(MAX_DEPTH, max(4, int(np.ceil(np.log2(max(1, total / capacity)))) + 4))
    weights = np.zeros(1 << d)
    for cell, w in carriers.groupBy(F.shiftrightunsigned("key", 64 - d).alias("cell")).agg(F.sum(F.octet_length("plain") + 64)).collect():  # at most 2**d rows
        weights[cell] = w
    directory = Directory(capacity).grow(weights)
    if directory.depth:
        cells = F.broadcast(directory.table(spark))  # at most 2**MAX_DEPTH rows of 12 bytes
        placed = carriers.join(cells, F.shiftrightunsigned("key", 64 - directory.depth) == F.col("cell"))
    else:
        placed = carriers.withColumn("bucket", F.lit(0))
    index = scratch.put("index", _owners(placed.select("bucket", "key", "carrier", "plain"), len(directory.buckets)))
    if stands is not None:
        rest = stands.where("carrier <> stands").join(index.withColumnRenamed("carrier", "stands"), "stands").select("carrier", "leader")
        index = scratch.put("index", index.unionByName(rest))

    best = F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("low"), F.bitwise_not("row_id").alias("row")))
    own = seg.groupBy("carrier").agg(best.alias("best"), F.count("*").alias("size"), F.max("sha").alias("sha")).join(index, "carrier")
    own = scratch.put("own", own)
    group = own.groupBy("leader").agg(F.max("best").alias("best"), F.sum("size").alias("size"))
    group = scratch.put("groups", group.select("leader", F.bitwise_not("best.low").alias("keep_id"), F.bitwise_not("best.row").alias("keep_row"), "size"))
    scratch.clear(seg, own, group)
    result = own.select("carrier", "leader", "sha").join(group.hint("merge"), "leader").select("carrier", "sha", "keep_id", "keep_row", "size")
    out = seg.select("doc_id", "row_id", "carrier", "h").join(result.hint("merge"), "carrier")
    return out.select("doc_id", "h", "keep_id", F.col("size").alias("group_size"), (F.col("row_id") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names: one of each group of equal texts.

    Null, empty and blank texts are equal to each other; ties go to the
    smallest doc_id, nulls last.  Of rows that repeat both doc_id and text, the
    one with the least hash of all its columns stays.  An empty table stays empty.
    """
    every = Scratch(docs.sparkSession, "exact-dup").put("decisions", decisions(docs, capacity).select(F.col("doc_id").alias("id2"), F.col("h").alias("h2"), "kept"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), whole(docs))
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2"))
    out = rows.join(every.where("kept").select("id2", "h2").distinct(), same, "left_semi")
    again = every.groupBy("id2", "h2").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    if not again.isEmpty():
        one = out.join(again, same, "left_semi").groupBy("id", "h").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        out = out.join(again, same, "left_anti").unionByName(one)
    return out.select("row.*")
