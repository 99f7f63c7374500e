"""Structured Streaming forms of regularise and of the innovations filter."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import models as M


def grid_stream(events: DataFrame, *, time: str, width: str, late: str, value: Column | str, channels: Sequence[str], channel: Column | str, series: Column | None = None) -> DataFrame:
    """Wide rows (series_id, start, channels) of closed windows; events later than the watermark are dropped.

    Empty windows give no row; filter_stream takes a gap as steps without an observation.
    """
    value, channel = (F.col(c) if isinstance(c, str) else c for c in (value, channel))
    own = events.select((F.lit("all") if series is None else series.cast("string")).alias("series_id"), F.col(time).cast("timestamp").alias("ts"), channel.alias("channel"), value.cast("double").alias("v"))
    own = own.withWatermark("ts", late).groupBy("series_id", F.window("ts", width)).agg(*[F.coalesce(F.sum(F.when(F.col("channel") == c, F.col("v"))), F.lit(0.0)).alias(c) for c in channels])
    return own.select("series_id", F.col("window.start").alias("start"), *channels)


def filter_stream(grid: DataFrame, model: M.Innovations, channels: Sequence[str], step_seconds: int) -> DataFrame:
    """series_id, step, innovation, score per grid row; the state lives in the state store.

    A gap of k steps predicts k - 1 times without an update.  Rows at or before
    the last step seen are dropped.  score is innovation' V^-1 innovation.
    """
    a, c, k, v = model.a[0], model.c[0], model.k[0], np.linalg.inv(model.v[0])
    d = a.shape[0]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, x = (None, np.zeros(d)) if not state.exists else (state.get[0], np.array(state.get[1]))
        rows = pd.concat(list(batches)).sort_values("step")
        out = []
        for step, y in zip(rows["step"], rows[list(channels)].to_numpy(float)):
            if last is not None and step <= last:
                continue
            for _ in range(0 if last is None else int(step - last) - 1):
                x = a @ x
            e = y - c @ x
            x, last = a @ x + k @ e, int(step)
            out.append((key[0], last, e.tolist(), float(e @ v @ e)))
        if last is not None:
            state.update((last, x.tolist()))
        yield pd.DataFrame(out, columns=["series_id", "step", "innovation", "score"])

    own = grid.withColumn("step", F.floor(F.unix_timestamp("start") / step_seconds)).select("series_id", "step", *channels)
    return own.groupBy("series_id").applyInPandasWithState(run, "series_id string, step long, innovation array<double>, score double", "last long, x array<double>", "append", "NoTimeout")
