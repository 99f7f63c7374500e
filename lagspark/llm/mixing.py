"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame functions only.

Every source gets a budget of words.  Complete epochs of a source come first;
what is left of its budget goes to documents in the order of their exponential
keys -ln(u) / weight, u being a hash of the document's id, until the prefix sum
of sizes is nearest to it.  Prefix sums take two levels: sums by (source,
bucket of the key), then rows within a bucket, so that a source with a third of
all rows is spread over as many window partitions as there are buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import text as T
from .shared import Scratch, whole

#: Buckets of keys: one for so many rows, and at least as many.
BUCKET_ROWS, LEAST_BUCKETS = 100_000, 1024
#: Sources that one window holds; more are ordered in ranges.
TASK_SOURCES = 1_000_000


def n_words(column: str = "text") -> Column:
    """Maximal runs of non-white characters; null has none."""
    return F.coalesce(F.regexp_count(column, F.lit(T.WORD_RE)), F.lit(0)).cast("long")


def _before(rows: DataFrame, order: Sequence[Column], sums: dict[str, Column], most: int) -> DataFrame:
    """rows with running sums of what comes before each in the order; over `most` rows in two levels, by ranges."""
    n = rows.count()
    if n <= most:
        w = W.Window.orderBy(*order).rowsBetween(W.Window.unboundedPreceding, -1)
        return rows.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(k) for k, c in sums.items()])
    ranged = rows.repartitionByRange(-(-n // most), *order).withColumn("part", F.spark_partition_id())
    ranged = Scratch(rows.sparkSession, "mixing").put("ranged", ranged)
    parts = ranged.groupBy("part").agg(*[F.sum(c).alias(f"{k}_part") for k, c in sums.items()])  # a row for `most` rows
    w = W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    parts = parts.select("part", *[F.coalesce(F.sum(f"{k}_part").over(w), F.lit(0)).alias(f"{k}_part") for k in sums])
    w = W.Window.partitionBy("part").orderBy(*order).rowsBetween(W.Window.unboundedPreceding, -1)
    own = ranged.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(k) for k, c in sums.items()])
    return own.join(parts, "part").select(*rows.columns, *[(F.col(k) + F.col(f"{k}_part")).alias(k) for k in sums])


def targets(sizes: DataFrame, weights: Sequence[float], most: int = 3, task_sources: int = TASK_SOURCES) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, take the weights in turn and share
    the sum of all sizes; none gets more than `most` times its size, and the
    excess is shared again by weight.  That fixed point is water filling:
    sources in order of capacity by weight are capped until one isn't.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = _before(sizes, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)}, task_sources)
    s = s.select("source", "source_size", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).alias("w"), (F.col("source_size") * most).alias("cap"))
    s = _before(s, [F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()], {"cap_before": F.col("cap"), "w_before": F.col("w")}, task_sources)
    all_size, all_w = s.agg(F.sum("source_size"), F.sum("w")).first()
    if all_w is None:
        return s.select("source", "source_size", F.lit(0.0).alias("target"))
    s = s.withColumn("left", F.lit(all_size) - F.col("cap_before")).withColumn("left_w", F.lit(all_w) - F.col("w_before"))
    s = s.withColumn("full", F.col("cap") * F.col("left_w") < F.col("w") * F.col("left"))
    # The first source that isn't full sets the level of all that follow.
    level = s.where("not full").agg(F.min_by(F.struct("left", "left_w"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")).alias("v")).select("v.*").first()
    share = F.lit(None).cast("double") if level[0] is None else F.col("w") * F.lit(float(level[0])) / F.lit(float(level[1]))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share)
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, *, row: Column | None = None, weights: Sequence[float] = (5, 2, 1), most: int = 3, seed: str = "", buckets: int | None = None, task_sources: int = TASK_SOURCES) -> DataFrame:
    """(row, doc_id, size, source_size, target, taken, copies) of every row of docs.

    `row` is what is carried along of an input row: by default all of it, as a
    struct, so other columns may have any name; a narrow one saves a pass.  quality: (doc_id, quality) with quality 0 or 1; labelled good
    documents weigh 2, bad ones 1/2, others 1; of repeated labels the best
    counts.  taken = size * copies is at most `most` times the size.  Null or
    blank texts have size 0 and are never taken; a null source is a source; a
    null doc_id draws like the text 'null'; rows that repeat a doc_id draw
    alike and are ordered by size; a very long text is taken whole or not.  An
    empty table gives an empty result.
    """
    if buckets is None:
        buckets = max(LEAST_BUCKETS, docs.count() // BUCKET_ROWS)
    base = docs.select(whole(docs) if row is None else row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words().alias("size"))
    weight = F.lit(1.0)
    if quality is not None:
        label = quality.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("q_id")).agg(F.max("quality").alias("q"))
        base = base.join(label, F.col("doc_id") == F.col("q_id"), "left").drop("q_id")
        weight = F.when(F.col("q") > 0, 2.0).when(F.col("q") <= 0, 0.5).otherwise(1.0)
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    # 1 - u ** (1 / weight) orders as -ln(u) / weight does, and is in (0, 1).
    base = base.withColumn("key", 1 - F.pow(u, 1 / weight)).withColumn("bucket", F.least(F.lit(buckets - 1), F.floor(F.col("key") * buckets)).cast("int"))

    scratch = Scratch(docs.sparkSession, "mixing")
    if row is not None:  # then rows are narrow, and are read again rather than their words counted again
        base = scratch.put("rows", base)
    cells = base.groupBy("source", "bucket").agg(F.sum("size").alias("cell"))
    by_source = W.Window.partitionBy("source").orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("cell").over(by_source), F.lit(0)))
    sizes = scratch.put("sizes", cells.groupBy("source").agg(F.sum("cell").alias("source_size")))
    goals = targets(sizes, weights, most, task_sources)
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = goals.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    cells = cells.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("c_source"), F.col("bucket").alias("c_bucket"), "before", "source_size", "target", "epochs", "rest")

    within = W.Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.Window.unboundedPreceding, -1)
    rows = base.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(cells, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("bucket") == F.col("c_bucket")))
    chosen = (F.col("size") > 0) & (F.col("before") + F.col("ahead") + F.col("size") / 2 <= F.col("rest"))
    copies = F.when(F.col("size") > 0, F.col("epochs") + chosen.cast("long")).otherwise(0)
    return rows.withColumn("copies", copies).select("row", "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_rows(docs: DataFrame, quality: DataFrame | None = None, **options) -> DataFrame:
    """The rows of docs with all their columns, whatever their names, each as often as the mix takes it.

    The mix is made on ids and hashes of the texts; texts are shuffled once, to
    meet their numbers of copies.  Null, empty and blank texts are never taken;
    rows that repeat an id, text and source share their copies out, in the order
    of the hashes of all their columns.  An empty table stays empty.
    """
    same = lambda: F.xxhash64("text", "source")
    named = F.struct(F.col("doc_id").cast("long").alias("id"), same().alias("h"))
    taken = mix(docs, quality, row=named, **options).groupBy("row.id", "row.h").agg(F.sum("copies").alias("all"), F.count("*").alias("rows"))
    taken = Scratch(docs.sparkSession, "mixing").put("copies", taken.select(F.col("id").alias("id2"), F.col("h").alias("h2"), "all", "rows"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), same().alias("h"), whole(docs))
    rows = rows.join(taken.where("all > 0"), F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")))
    copies = F.col("all")
    if not taken.where("rows > 1").isEmpty():
        rows = rows.withColumn("nth", F.row_number().over(W.Window.partitionBy("id2", "h2").orderBy(F.xxhash64("row"))))
        copies = F.floor(F.col("all") / F.col("rows")) + (F.col("nth") <= F.col("all") % F.col("rows")).cast("long")
    rows = rows.withColumn("copies", copies).where("copies > 0")
    return rows.select(F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))), "row").select("row.*")
