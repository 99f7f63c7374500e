"""Model tables: VAR estimates from moments, conversions, and what applies a model to rows.

A model row has model_id, n, p, coef (row-major lag, target, source), intercept
and sigma; an innovations row has model_id, n, r and row-major a, c, k, v.  A
row whose model can't be used has a status other than 'ok' and null arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg as L
from ..functions import models as M
from . import lags as lags_

VAR = "model_id string, n int, p int, rows long, coef array<double>, intercept array<double>, sigma array<double>, radius double, status string"
INNOVATIONS = "model_id string, n int, r int, a array<double>, c array<double>, k array<double>, v array<double>, status string"


def by_shape(pdf: pd.DataFrame, *keys: str) -> Iterator[pd.DataFrame]:
    for _, own in pdf.groupby(list(keys), sort=False):
        yield own


def stack(column: pd.Series, *shape: int) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in column]).reshape(len(column), *shape)


def flat(x: np.ndarray) -> list:
    return list(x.reshape(len(x), -1)) if len(x) else []


def each_or_one(run: Callable, batch: int) -> list:
    """run(indices) for all items at once; one by one where the batch fails. (value, status) per item."""
    try:
        return [(v, "ok") for v in run(np.arange(batch))]
    except (np.linalg.LinAlgError, ValueError):
        out = []
        for i in range(batch):
            try:
                out.append((run(np.array([i]))[0], "ok"))
            except (np.linalg.LinAlgError, ValueError) as e:
                out.append((None, str(e)[:200] or type(e).__name__))
        return out


def fit_var(wide: DataFrame, channels: Sequence[str], order: int = 1, *, alpha: float = 0.0, intercept: bool = True, pooled: bool = False, unbiased: bool = True, block: int = lags_.BLOCK) -> DataFrame:
    """VAR rows by least squares or ridge: one native pass for moments, then a kernel over model rows."""
    return var_from_moments(lags_.lag_moments(wide, channels, order, pooled=pooled, block=block), len(channels), order, alpha=alpha, intercept=intercept, unbiased=unbiased)


def var_from_moments(moments: DataFrame, n: int, order: int, *, alpha: float = 0.0, intercept: bool = True, unbiased: bool = True) -> DataFrame:
    d = n * (order + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            mean, rows = stack(pdf["mean"], d), pdf["rows"].to_numpy(float)
            cov = stack(pdf["cov"].map(lambda c: [np.nan if v is None else v for v in c]), d, d)
            s = cov * (rows - 1)[:, None, None]
            if not intercept:
                s = s + rows[:, None, None] * mean[:, :, None] * mean[:, None, :]
            free = rows - (n * order + intercept if unbiased else 0)

            def solve(i: np.ndarray) -> list:
                if (free[i] <= 0).any() or not np.isfinite(s[i]).all():
                    raise ValueError("too few rows or non-finite values")
                szz, szy, syy = s[i][:, n:, n:], s[i][:, n:, :n], s[i][:, :n, :n]
                b = np.linalg.solve(szz + alpha * np.eye(n * order), szy)
                sigma = syy - L.t(b) @ szy - L.t(szy) @ b + L.t(b) @ szz @ b
                coef = np.moveaxis(L.t(b).reshape(-1, n, order, n), 2, 1)
                const = mean[i][:, :n] - np.einsum("bkn,bk->bn", b, mean[i][:, n:]) if intercept else np.zeros((len(i), n))
                return list(zip(coef.reshape(len(i), -1), const, L.symmetrise(sigma / free[i][:, None, None]).reshape(len(i), -1), M.var_radius(coef)))

            got = each_or_one(solve, len(pdf))
            part = lambda k: [None if g[0] is None else g[0][k] for g in got]
            yield pd.DataFrame({"model_id": pdf["model_id"], "n": n, "p": order, "rows": pdf["rows"], "coef": part(0), "intercept": part(1), "sigma": part(2), "radius": part(3), "status": [g[1] for g in got]})

    return moments.select("model_id", "rows", "mean", "cov").mapInPandas(run, VAR)


def kernel(models: DataFrame, schema: str, run: Callable[[pd.DataFrame], pd.DataFrame], failed: Callable[[pd.DataFrame, list], pd.DataFrame] | None = None) -> DataFrame:
    """A numpy kernel over model rows with status ok, by shape, in Arrow batches; no shuffle.

    Other rows pass with their status where the schema has one; so does a row
    that the kernel fails on, which is found by running the batch row by row.
    failed: rows for models and their statuses, for schemas without a status.
    """
    keys = [c for c in ("n", "p", "r") if c in models.columns]
    names = [f.split()[0] for f in schema.split(", ")]

    def lost(pdf: pd.DataFrame, statuses: list) -> list[pd.DataFrame]:
        if len(pdf) and failed is not None:
            return [failed(pdf, statuses)]
        if not len(pdf) or "status" not in names:
            return []
        return [pd.DataFrame({c: statuses if c == "status" else pdf[c] if c in ("model_id", "n") else [None] * len(pdf) for c in names})]

    def each(own: pd.DataFrame) -> list[pd.DataFrame]:
        try:
            return [run(own)]
        except (np.linalg.LinAlgError, ValueError) as e:
            if len(own) == 1:
                return lost(own, [str(e)[:200] or type(e).__name__])
            return [x for i in range(len(own)) for x in each(own.iloc[i : i + 1].reset_index(drop=True))]

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = pdf["status"] == "ok"
            parts = lost(pdf[~ok].reset_index(drop=True), pdf.loc[~ok, "status"].tolist())
            for own in by_shape(pdf[ok], *keys):
                parts += each(own.reset_index(drop=True))
            yield from (x for x in parts if len(x))

    return models.mapInPandas(over, schema)


def read_var(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    n, p = int(pdf["n"].iloc[0]), int(pdf["p"].iloc[0])
    return stack(pdf["coef"], p, n, n), stack(pdf["sigma"], n, n)


def read_innovations(pdf: pd.DataFrame) -> M.Innovations:
    n, r = int(pdf["n"].iloc[0]), int(pdf["r"].iloc[0])
    return M.Innovations(stack(pdf["a"], r, r), stack(pdf["c"], n, r), stack(pdf["k"], r, n), stack(pdf["v"], n, n))


def write_innovations(ids: Sequence, m: M.Innovations) -> pd.DataFrame:
    ok = np.isfinite(m.a).all((1, 2)) & np.isfinite(m.v).all((1, 2))
    keep = lambda x: [row if o else None for row, o in zip(flat(x), ok)]
    return pd.DataFrame({"model_id": list(ids), "n": m.n, "r": m.a.shape[-1], "a": keep(m.a), "c": keep(m.c), "k": keep(m.k), "v": keep(m.v), "status": np.where(ok, "ok", "no stationary solution")})


def to_innovations(models: DataFrame) -> DataFrame:
    """VAR rows to innovations rows; VARs with a radius of one or more keep a status."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        coef, sigma = read_var(pdf)
        out = write_innovations(pdf["model_id"], M.var_to_innovations(coef, sigma))
        out.loc[(M.var_radius(coef) >= 1), "status"] = "unstable"
        return out

    return kernel(models, INNOVATIONS, run)


def varma_to_innovations(rows: DataFrame) -> DataFrame:
    """Rows (model_id, n, p, q, ar, ma, sigma, status) of VARMA models, row-major by lag, to innovations rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for (n, p, q), own in pdf.groupby(["n", "p", "q"], sort=False):
            parts.append(write_innovations(own["model_id"], M.varma_to_innovations(stack(own["ar"], int(p), int(n), int(n)), stack(own["ma"], int(q), int(n), int(n)), stack(own["sigma"], int(n), int(n)))))
        return pd.concat(parts, ignore_index=True)

    return kernel(rows, INNOVATIONS, run)


def to_state_space(models: DataFrame) -> DataFrame:
    """VAR rows to general systems (model_id, n, r, a, c, q, rr, status) without observation noise."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [x.reshape(len(pdf), -1) for x in M.var_to_state_space(*read_var(pdf))]
        return pd.DataFrame({"model_id": pdf["model_id"], "n": pdf["n"], "r": pdf["n"] * pdf["p"], **{k: list(v) for k, v in zip(("a", "c", "q", "rr"), parts)}, "status": "ok"})

    return kernel(models, "model_id string, n int, r int, a array<double>, c array<double>, q array<double>, rr array<double>, status string", run)


def state_space_to_innovations(systems: DataFrame) -> DataFrame:
    """Rows (model_id, n, r, a, c, q, rr, status) of general state-space models to innovations rows by the Riccati equation."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, r = int(pdf["n"].iloc[0]), int(pdf["r"].iloc[0])
        return write_innovations(pdf["model_id"], M.innovations_form(stack(pdf["a"], r, r), stack(pdf["c"], n, r), stack(pdf["q"], r, r), stack(pdf["rr"], n, n)))

    return kernel(systems, INNOVATIONS, run)


def transform(models: DataFrame, change: Callable[[M.Innovations, pd.DataFrame], M.Innovations]) -> DataFrame:
    """Innovations rows through a kernel that may use further columns of its rows."""
    return kernel(models, INNOVATIONS, lambda pdf: write_innovations(pdf["model_id"], change(read_innovations(pdf), pdf)))


def reduce(models: DataFrame, keep: Sequence[int]) -> DataFrame:
    return transform(models, lambda m, _: M.reduce(m, keep))


def project(models: DataFrame, rows: Sequence[Sequence[float]]) -> DataFrame:
    return transform(models, lambda m, _: M.project(m, np.asarray(rows, float)))


def downsample(models: DataFrame, step: int) -> DataFrame:
    return transform(models, lambda m, _: M.downsample(m, step))


def scale_grid(models: DataFrame, factors: Sequence[float]) -> DataFrame:
    """Every model with its dynamics times every factor; model_id gains '@<factor>'."""
    spark = models.sparkSession
    grid = spark.createDataFrame([(float(f),) for f in factors], "factor double")
    own = models.crossJoin(F.broadcast(grid)).withColumn("model_id", F.concat_ws("@", "model_id", F.col("factor").cast("string")))  # a parameter grid
    return transform(own, lambda m, pdf: M.scale(m, pdf["factor"].to_numpy()))


def _with_model(rows: DataFrame, models: DataFrame, pooled: bool) -> DataFrame:
    own = models.where("status = 'ok'").select("model_id", "coef", "intercept", "sigma")
    if pooled:  # one row, named 'all'
        return rows.withColumn("model_id", F.lit("all")).join(F.broadcast(own.where("model_id = 'all'")), "model_id")
    return rows.join(own, F.col("series_id") == F.col("model_id"))


def predictions(wide: DataFrame, models: DataFrame, channels: Sequence[str], order: int, *, pooled: bool = False, block: int = lags_.BLOCK) -> DataFrame:
    """series_id, t, x, prediction, residual: a native projection over the lag design.

    A pooled table of one model joins every row; otherwise models join by series.
    """
    n = len(channels)
    own = _with_model(lags_.lagged(wide, channels, order, block), models, pooled)
    z = [F.col(f"{c}_l{k}") for k in range(1, order + 1) for c in channels]
    terms = []
    for i in range(n):
        e = F.col("intercept")[i]
        for k in range(order):
            for j in range(n):
                e = e + F.col("coef")[k * n * n + i * n + j] * z[k * n + j]
        terms.append(e)
    x = F.array(*[F.col(c) for c in channels])
    own = own.select("series_id", "t", x.alias("x"), F.array(*terms).alias("prediction"), "model_id", "sigma")
    return own.select("series_id", "t", "x", "prediction", F.zip_with("x", "prediction", lambda a, b: a - b).alias("residual"), "model_id", "sigma")


def negative_log_likelihood(predicted: DataFrame, n: int) -> DataFrame:
    """series_id, t, nll of prediction rows; the quadratic form's matrix comes from a kernel over models."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                e, s = stack(pdf["residual"], n), stack(pdf["sigma"], n, n)
                q = (e * np.linalg.solve(s, e[:, :, None])[:, :, 0]).sum(-1)
                yield pd.DataFrame({"series_id": pdf["series_id"], "t": pdf["t"], "nll": 0.5 * (q + np.linalg.slogdet(s)[1] + n * np.log(2 * np.pi))})

    return predicted.select("series_id", "t", "residual", "sigma").mapInPandas(run, "series_id string, t long, nll double")


def forecast(wide: DataFrame, models: DataFrame, channels: Sequence[str], order: int, steps: int, *, pooled: bool = False) -> DataFrame:
    """series_id, t, x for `steps` steps after each series' last row."""
    n = len(channels)
    last = wide.groupBy("series_id").agg(F.max("t").alias("last"))
    tail = wide.join(last, "series_id").where(F.col("t") > F.col("last") - order)
    own = tail.groupBy("series_id", "last").agg(F.array_sort(F.collect_list(F.struct("t", F.array(*channels).alias("x")))).alias("rows")).where(F.size("rows") == order)
    own = _with_model(own, models, pooled).select("series_id", "last", F.transform("rows", lambda r: r["x"]).alias("past"), "coef", "intercept")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..functions import ident

        for pdf in batches:
            if len(pdf):
                past = np.stack([np.stack([np.asarray(v, float) for v in rows]) for rows in pdf["past"]])
                got = ident.forecast(past, stack(pdf["coef"], order, n, n), stack(pdf["intercept"], n), steps)
                yield pd.DataFrame({"series_id": np.repeat(pdf["series_id"].to_numpy(), steps), "t": (pdf["last"].to_numpy()[:, None] + np.arange(1, steps + 1)).ravel(), "x": list(got.reshape(-1, n))})

    return own.mapInPandas(run, "series_id string, t long, x array<double>")
