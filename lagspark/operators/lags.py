"""Lag designs and lag moments with native windows and aggregates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

BLOCK = 1 << 16


def lagged(wide: DataFrame, channels: Sequence[str], lags: int, block: int = BLOCK, depth: str | None = None) -> DataFrame:
    """wide with <channel>_l<k> for k = 1..lags; rows without the full history are dropped.

    With depth, all rows stay, and a column of that name says how many lags each has.

    A series is cut into blocks of steps and the last rows of each block are
    copied into the next, so a window holds one block, however long a series
    is.  Lags never cross a gap or a series.
    """
    own = F.struct(F.floor(F.col("t") / block).alias("block"), F.lit(False).alias("copy"))
    next_ = F.struct((F.floor(F.col("t") / block) + 1).alias("block"), F.lit(True).alias("copy"))
    last = F.pmod(F.col("t"), F.lit(block)) >= block - lags
    rows = wide.select("*", F.explode(F.when(last, F.array(own, next_)).otherwise(F.array(own))).alias("__in"))
    rows = rows.select(*wide.columns, F.col("__in.block").alias("__block"), F.col("__in.copy").alias("__copy"))
    w = W.Window.partitionBy("series_id", "__block").orderBy("t")
    for k in range(1, lags + 1):
        rows = rows.select("*", *[F.lag(c, k).over(w).alias(f"{c}_l{k}") for c in channels])
    if depth is not None:
        gapless = [(F.coalesce(F.col("t") - F.lag("t", k).over(w), F.lit(-1)) == k).cast("int") for k in range(1, lags + 1)]
        return rows.withColumn(depth, sum(gapless, F.lit(0))).where(~F.col("__copy")).drop("__block", "__copy")
    rows = rows.withColumn("__from", F.lag("t", lags).over(w))
    return rows.where(~F.col("__copy") & (F.col("t") - F.col("__from") == lags)).drop("__block", "__copy", "__from")


def design_columns(channels: Sequence[str], lags: int) -> list[str]:
    return list(channels) + [f"{c}_l{k}" for k in range(1, lags + 1) for c in channels]


def lag_moments(wide: DataFrame, channels: Sequence[str], lags: int, *, pooled: bool = False, block: int = BLOCK) -> DataFrame:
    """One row of sufficient statistics per series, or in all: model_id, rows, mean, cov.

    mean and cov (row-major, denominator rows - 1) are of (x_t, x_{t-1}, ..).
    Partial aggregates combine before the shuffle; covar_samp keeps centred sums.
    """
    cols = design_columns(channels, lags)
    return _moments(lagged(wide, channels, lags, block), F.lit("all") if pooled else F.col("series_id"), [F.col(c) for c in cols])


#: Columns from which moments are summed by matrix products over Arrow batches, not by an aggregate per pair.
WIDE_DESIGN = 24


def _moments(rows: DataFrame, model: Column, cols: list[Column], *more: str) -> DataFrame:
    """model_id, more, rows, mean, cov of columns."""
    d = len(cols)
    own = rows.select(model.cast("string").alias("model_id"), *more, *[c.cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    if d > WIDE_DESIGN:
        return _matrix_moments(own, d, more)
    pairs = {(i, j): F.covar_samp(f"x{i}", f"x{j}") for i in range(d) for j in range(i, d)}
    own = own.groupBy("model_id", *more).agg(F.count("*").alias("rows"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(d)], *[e.alias(f"c{i}_{j}") for (i, j), e in pairs.items()])
    cov = F.array(*[F.col(f"c{min(i, j)}_{max(i, j)}") for i in range(d) for j in range(d)])
    return own.select("model_id", *more, "rows", F.array(*[f"m{i}" for i in range(d)]).alias("mean"), cov.alias("cov"))


def merge(parts: Sequence[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, covariance with denominator rows - 1) of all parts together; parts without rows don't count."""
    parts = [p for p in parts if p[0]]
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    spread = sum(np.nan_to_num(p[2]) * (p[0] - 1) + p[0] * np.outer(p[1] - mean, p[1] - mean) for p in parts)
    return n, mean, spread / (n - 1) if n > 1 else np.full_like(spread, np.nan)


def _matrix_moments(own: DataFrame, d: int, more: Sequence[str]) -> DataFrame:
    """The same for wide designs: X'X per Arrow batch and group, then merged by group, one row of d * d numbers per batch."""
    schema = "model_id string, " + "".join(f"{c} {dict(own.dtypes)[c]}, " for c in more) + "rows long, mean array<double>, cov array<double>"
    keys = ["model_id", *more]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, part in pdf.groupby(keys, dropna=False, sort=False):
                x = part[[f"x{i}" for i in range(d)]].to_numpy(float)
                mean = x.mean(0)
                cov = (x - mean).T @ (x - mean) / (len(x) - 1) if len(x) > 1 else np.full((d, d), np.nan)
                yield pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "rows": [len(x)], "mean": [mean], "cov": [cov.ravel()]})

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, mean, cov = merge([(r, np.asarray(m, float), np.asarray(c, float).reshape(d, d)) for r, m, c in zip(pdf["rows"], pdf["mean"], pdf["cov"])])
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "rows": [n], "mean": [mean], "cov": [cov.ravel()]})

    # Salted first, so that no task merges the batches of a long series alone.
    parts = own.mapInPandas(partial, schema).withColumn("__salt", F.spark_partition_id() % 256)
    some = parts.groupBy(*keys, "__salt").applyInPandas(lambda key, pdf: whole(key[:-1], pdf), schema)
    return some.groupBy(*keys).applyInPandas(whole, schema)


def depth_moments(wide: DataFrame, channels: Sequence[str], lags: int, *, pooled: bool = False, block: int = BLOCK) -> DataFrame:
    """model_id, depth, rows, mean, cov: moments of the rows that have just `depth` of the lags, absent lags being 0.

    Any order's moments are those of the depths from it on, so one pass serves all orders.
    """
    cols = design_columns(channels, lags)
    rows = lagged(wide, channels, lags, block, depth="depth")
    return _moments(rows, F.lit("all") if pooled else F.col("series_id"), [F.coalesce(F.col(c), F.lit(0.0)) for c in cols], "depth")


def hankel(wide: DataFrame, channels: Sequence[str], past: int, future: int, block: int = BLOCK) -> DataFrame:
    """series_id, t, past (newest first) and future (oldest first) windows around each step that has both."""
    rows = lagged(wide, channels, past + future - 1, block)
    at = lambda k: [F.col(c if k == 0 else f"{c}_l{k}") for c in channels]
    newest = future - 1
    return rows.select(
        "series_id", (F.col("t") - newest).alias("t"),
        F.array(*[e for k in range(future, future + past) for e in at(k)]).alias("past"),
        F.array(*[e for k in range(newest, -1, -1) for e in at(k)]).alias("future"),
    )
