"""WARC archives: written by Spark's text sink, read back by boundary chains.

The writer makes one string per record and lets the sink end it with the blank
lines that close a WARC record.  The reader splits files of any size at the
record magic, which payloads may contain too.  Tasks parse every candidate and
emit the offset of its successor, where its record would end.  A file is cut
into parts of fixed size by offset; within a part, every candidate's chain is
followed to where it leaves the part.  Pointer jumping over these exits, from
the start of each file, finds the candidates at which the chain of real records
enters a part, in as many rounds as the number of parts has binary digits; from
there the records of a part are found.  All other candidates are payload.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import text as T
from .shared import Scratch

MAGIC = b"WARC/1.0\r\n"
END = "\r\n\r\n"
# The base32 alphabet of payload digests, and the revisit profile.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Bytes of a file within which one task follows chains.
PART_BYTES = 4 << 20


def base32_sha1(column: Column) -> Column:
    """Upper-case base32 of a SHA-1: 5 hex digits are 4 letters."""
    hexed = F.sha1(column)
    letters = []
    for i in range(8):
        value = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.lit(BASE32).substr((F.shiftright(value, s).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def write(pages: DataFrame, path: str, *, least: int = 0, compression: str = "none", date: str = DATE) -> None:
    """Write a record per row of pages (page_id, url, html) as WARC files under path.

    Payload is html in UTF-8, null being empty.  Of records with equal payloads
    of at least `least` bytes the one with the largest page_id is a response
    and the others revisit it; rows that repeat this page_id are responses too,
    and so are all where every page_id is null.  Line ends in a url are
    percent-encoded; a null url or page_id leaves its header out.  Other columns
    are ignored, whatever their names; no rows make no records; a payload may
    be as long as a string.  Files that aren't compressed are read in splits;
    of gzip, a file is one task.
    """
    scratch = Scratch(pages.sparkSession, "warc-write")
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body")).withColumn("n", F.octet_length("body").cast("long")).withColumn("digest", base32_sha1(F.col("body").cast("binary")))
    same = scratch.put("same", base.where(f"n >= {least}").groupBy("digest", "n").agg(F.max("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"))
    rows = base.join(same, ["digest", "n"], "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))

    def header(name: str, value: Column) -> Column:
        return F.concat(F.lit(name + ": "), value, F.lit("\r\n"))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), header("Content-Length", F.col("n").cast("string")), F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("body")))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    record = F.concat(
        F.lit(MAGIC.decode()),
        header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        F.coalesce(header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))), F.lit("")),
        header("WARC-Date", F.lit(date)),
        F.coalesce(header("WARC-Target-URI", url), F.lit("")),
        F.when(revisit, F.concat(header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))), header("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        header("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
        F.col("block"),
    )
    rows.withColumn("block", block).select(record.alias("value")).write.option("lineSep", END).option("compression", compression).mode("overwrite").text(path)
    scratch.drop(same)


def parse(data: bytes) -> tuple[dict, int] | None:
    """(headers with lower-case names, length up to the block) of what follows a magic, or None."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in data[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return (fields, end + 4) if fields.get("content-length", "").isdigit() else None


def _id(value: str | None) -> int | None:
    """The page_id of a record id that the writer made."""
    digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.removeprefix("-").isdigit() else None


def record(fields: dict, block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, intact) of one record.

    The payload of a revisit is elsewhere; its size is the one that its HTTP
    header repeats, its digest that of its WARC header.
    """
    head, _, payload = block.partition(b"\r\n\r\n")
    kind, named = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        size = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
        return _id(fields.get("warc-record-id")), size, named, kind, _id(fields.get("warc-refers-to")), True
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return _id(fields.get("warc-record-id")), len(payload), digest, kind, None, digest == named


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
_NAMES = [x.split()[0] for x in RECORD.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Bytes between magics, with their file and the start of their block, in order."""
    read = spark.read.option("lineSep", MAGIC.decode()).option("recursiveFileLookup", "true").text(path)
    return read.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row per candidate: file, block, place within the block, at (offset of its
    magic from the block's first byte), ends (of its record, on the same scale),
    whole (the record has no magic inside), and the record; and a row per block
    with place -1, whose ends is the block's size."""

    names = ["file", "block", "place", "at", "ends", "whole", *_NAMES]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), *_TYPES]
    none = (None,) * len(_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, place, offset = None, 0, 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

        for batch in batches:
            rows = []
            for value, file, block in zip(batch.column("value"), batch.column("file").to_pylist(), batch.column("block").to_pylist()):
                if (file, block) != where:
                    if where:
                        rows.append((*where, -1, None, offset, None, *none))
                    where, place, offset = (file, block), 0, 0
                data = value.as_py()
                found, at = parse(data), offset - len(MAGIC)
                if found is None:
                    rows.append((*where, place, at, None, False, *none))
                else:
                    fields, start = found
                    size = start + int(fields["content-length"]) + len(END)
                    whole = size == len(data)
                    rows.append((*where, place, at, offset + size, whole, *(record(fields, data[start : len(data) - len(END)]) if whole else none)))
                offset += len(data) + len(MAGIC)
                place += 1
            yield out(rows)
        if where:
            yield out([(*where, -1, None, offset, None, *none)])

    schema = f"file string, block long, place long, at long, ends long, whole boolean, {RECORD}"
    return _lines(spark, path).mapInArrow(T.lean(run), schema)


def _exits(links: DataFrame) -> DataFrame:
    """(file, part, at, leaves): where the chain from a candidate first is outside its part."""

    def run(group: pa.Table) -> pa.Table:
        t = group.sort_by("at")
        at, ends = t.column("at").to_pylist(), t.column("ends").to_pylist()
        leave: dict[int, int] = {}
        for a, e in zip(at[::-1], ends[::-1]):
            leave[a] = leave.get(e, e)
        return pa.table({"file": t.column("file"), "part": t.column("part"), "at": t.column("at"), "leaves": pa.array([leave[a] for a in at], pa.int64())})

    return links.groupBy("file", "part").applyInArrow(run, "file string, part long, at long, leaves long")


def _entries(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(file, part, at) of the candidates where the chain from a file's start enters its parts.

    Only candidates at a file's start, and those that some exit leads to, take
    part in the jumping: a few per part, whatever the payloads hold.
    """
    exits = scratch.put("exits", _exits(links))
    led = exits.select("file", F.col("leaves").alias("at")).distinct()
    doors = scratch.put("doors", exits.join(led, ["file", "at"], "left_semi").unionByName(exits.where("at = 0")))
    parts = doors.groupBy("file").agg(F.countDistinct("part").alias("c")).agg(F.max("c")).first()[0] or 1
    jump = doors.select("file", "at", F.col("leaves").alias("to"), (F.col("at") == 0).alias("seen"))
    for _ in range((parts - 1).bit_length()):
        # Mark what 2**k jumps reach, then make jumps twice as long; a chain that has left its file leads to no door.
        onward = jump.select("file", F.col("at").alias("to"), F.col("to").alias("then"))
        marks = jump.where("seen").select("file", F.col("to").alias("at"), F.lit(True).alias("mark")).distinct()
        longer = jump.join(onward, ["file", "to"], "left").join(marks, ["file", "at"], "left")
        jump = scratch.put("jump", longer.select("file", "at", F.col("then").alias("to"), F.coalesce("mark", "seen").alias("seen")))
    return doors.join(jump.where("seen"), ["file", "at"], "left_semi").select("file", "part", "at")


def _reached(links: DataFrame, entries: DataFrame) -> DataFrame:
    """(file, at) of candidates on the chain from an entry of their part."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ends = dict(zip(left.column("at").to_pylist(), left.column("ends").to_pylist()))
        good = set()
        for a in right.column("at").to_pylist():
            while a in ends and a not in good:
                good.add(a)
                a = ends[a]
        return pa.table({"file": pa.array([key[0].as_py()] * len(good), pa.string()), "at": pa.array(sorted(good), pa.int64())})

    return links.groupBy("file", "part").cogroup(entries.groupBy("file", "part")).applyInArrow(run, "file string, at long")


def read(spark: SparkSession, path: str, *, part_bytes: int = PART_BYTES) -> DataFrame:
    """The records of all WARC files under path (RECORD).

    intact tells whether a response's payload has the digest of its header.
    Bytes after a record that isn't followed by another are ignored, as are
    files that don't start with a record.  An empty folder of Spark gives no
    rows.  Payloads of any number of magics are read; one record is held at a
    time, so its size is bounded by a task's memory.
    """
    scratch = Scratch(spark, "warc-read")
    found = scratch.put("candidates", candidates(spark, path))
    before = W.Window.partitionBy("file").orderBy("block").rowsBetween(W.Window.unboundedPreceding, -1)  # a row per input split
    blocks = scratch.put("blocks", found.where("place = -1").select("file", "block", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("base")))
    found = found.where("place >= 0").join(blocks, ["file", "block"]).withColumn("at", F.col("at") + F.col("base")).withColumn("ends", F.col("ends") + F.col("base"))
    found = found.withColumn("part", F.floor(F.col("at") / part_bytes))

    links = found.where("ends is not null").select("file", "part", "at", "ends")
    reached = scratch.put("reached", _reached(links, _entries(links, scratch)))
    real = found.join(reached.hint("merge"), ["file", "at"])
    out = real.where("whole").select(*_NAMES)
    broken = scratch.put("broken", real.where("not whole").select("file", "at", "ends"))
    return out if broken.isEmpty() else out.unionByName(_joined(spark, path, found, broken, part_bytes))


def _joined(spark: SparkSession, path: str, found: DataFrame, broken: DataFrame, part_bytes: int) -> DataFrame:
    """Records with magics inside: their pieces, in the parts that they span, are read again and put together."""
    spans = F.explode(F.sequence(F.floor(F.col("at") / part_bytes), F.floor((F.col("ends") - 1) / part_bytes)))
    spanned = broken.select("file", spans.alias("part"), F.col("at").alias("own"), F.col("ends").alias("until"))
    marked = found.select("file", "part", "block", "place", "at").join(spanned, ["file", "part"]).where("own <= at and at < until").drop("part", "until")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, place = None, 0
        for batch in batches:
            places = []
            for key in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()):
                where, place = key, place + 1 if key == where else 0
                places.append(place)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], ["value", "file", "block", "place"])

    lines = _lines(spark, path).mapInArrow(T.lean(numbered), "value binary, file string, block long, place long")
    pieces = lines.join(marked, ["file", "block", "place"])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        data = MAGIC.join(t.column("value").to_pylist())
        fields, start = parse(data)
        row = record(fields, data[start : start + int(fields["content-length"])])
        return pa.table({n: pa.array([v], k) for n, v, k in zip(_NAMES, row, _TYPES)})

    return pieces.groupBy("file", "own").applyInArrow(run, RECORD)
