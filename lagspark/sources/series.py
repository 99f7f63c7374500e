"""Regular series as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Steps that one array or window holds.
BLOCK = 1 << 16
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def grid_step(time: str, unit: str) -> Column:
    """Whole units since the epoch of a TIMESTAMP_NTZ column."""
    return F.expr(f"timestampdiff({unit}, {EPOCH}, {time})")


def _carried(rows: DataFrame, channels: Sequence[str], block: int) -> DataFrame:
    """Last values carried on: within blocks of steps, and from the blocks before."""
    rows = rows.withColumn("__block", F.floor(F.col("t") / block))
    ends = rows.groupBy("series_id", "__block").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("t"))).alias(f"__{c}") for c in channels])
    earlier = W.Window.partitionBy("series_id").orderBy("__block").rowsBetween(W.Window.unboundedPreceding, -1)  # a row per block
    ends = ends.select("series_id", "__block", *[F.last(f"__{c}", True).over(earlier).alias(f"__{c}") for c in channels])
    within = W.Window.partitionBy("series_id", "__block").orderBy("t").rowsBetween(W.Window.unboundedPreceding, 0)
    own = rows.select("series_id", "t", "__block", *[F.last(c, True).over(within).alias(c) for c in channels])
    return own.join(ends, ["series_id", "__block"]).select("series_id", "t", *[F.coalesce(c, f"__{c}").alias(c) for c in channels])


def regularise(events: DataFrame, *, time: str, unit: str, value: Column | str, channels: Sequence[str], channel: Column | str, series: Column | None = None, how: str = "sum", fill: float | str | None = 0.0, block: int = BLOCK) -> DataFrame:
    """Wide series on a gap-free grid: one row per series and step between its first and last.

    how: sum, avg, count, min or max of value within a step.  fill: a number
    for empty cells, "locf" to carry the last value on, or None to leave nulls.
    """
    value, channel = (F.col(c) if isinstance(c, str) else c for c in (value, channel))
    own = events.select((F.lit("all") if series is None else series.cast("string")).alias("series_id"), grid_step(time, unit).alias("t"), channel.alias("channel"), value.cast("double").alias("v"))
    own = own.where(F.col("t").isNotNull())
    agg = {"sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max}[how]
    cells = own.groupBy("series_id", "t").agg(*[agg(F.when(F.col("channel") == c, F.col("v"))).cast("double").alias(c) for c in channels])
    span = cells.groupBy("series_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    pieces = span.select("series_id", "hi", F.explode(F.sequence("lo", "hi", F.lit(block))).alias("from"))  # an array holds one block at most
    grid = pieces.select("series_id", F.explode(F.sequence("from", F.least("hi", F.col("from") + block - 1))).alias("t"))
    out = grid.join(cells, ["series_id", "t"], "left")
    if fill == "locf":
        return _carried(out, channels, block)
    return out if fill is None else out.fillna(float(fill), list(channels))


def to_long(wide: DataFrame, channels: Sequence[str]) -> DataFrame:
    return wide.unpivot(["series_id", "t"], list(channels), "channel", "value")


def to_wide(long: DataFrame, channels: Sequence[str]) -> DataFrame:
    return long.groupBy("series_id", "t").agg(*[F.max(F.when(F.col("channel") == c, F.col("value"))).alias(c) for c in channels])


def to_dense(wide: DataFrame, channels: Sequence[str]) -> DataFrame:
    return wide.select("series_id", "t", F.array(*[F.col(c).cast("double") for c in channels]).alias("x"))


def from_channel_major(rows: DataFrame) -> DataFrame:
    """(series_id, channel, x ARRAY over time) to long."""
    return rows.select("series_id", "channel", F.posexplode("x").alias("t", "value")).select("series_id", F.col("t").cast("long").alias("t"), "channel", "value")


def to_channel_major(long: DataFrame) -> DataFrame:
    """Long to one row per series and channel with its values in order of t; a row holds a whole channel."""
    own = F.array_sort(F.collect_list(F.struct("t", "value")))
    return long.groupBy("series_id", "channel").agg(F.transform(own, lambda s: s["value"]).alias("x"))


def require_complete(wide: DataFrame, channels: Sequence[str], order: int = 1) -> DataFrame:
    """wide, with an error at run time where a value is null or not finite."""
    bad = " or ".join(f"({c} is null or isnan({c}) or abs({c}) = double('Infinity'))" for c in channels)
    return wide.where(F.expr(f"if({bad}, raise_error('series has missing or non-finite values'), true)"))
