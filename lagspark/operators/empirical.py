"""Measures straight from observations, lattice estimates, whiteness, and temporal selection of state spaces."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dependence as X
from ..functions import ident
from ..functions import linalg as L
from ..functions import models as M
from ..functions import testing
from . import lags as lags_
from . import models as models_
from . import statespace


def coefficient_table(models: DataFrame) -> DataFrame:
    """model_id, lag, target, source, value of VAR rows: the exploded layout."""
    own = models.where("status = 'ok'").select("model_id", "n", F.posexplode("coef").alias("k", "value"))
    n2 = F.col("n") * F.col("n")
    return own.select("model_id", (F.floor(F.col("k") / n2) + 1).cast("int").alias("lag"), F.floor(F.col("k") % n2 / F.col("n")).cast("int").alias("target"), (F.col("k") % F.col("n")).alias("source"), "value")


def from_coefficient_table(table: DataFrame, n: int) -> DataFrame:
    """model_id, p and row-major coef from the exploded layout."""
    at = ((F.col("lag") - 1) * n * n + F.col("target") * n + F.col("source")).alias("at")
    own = table.groupBy("model_id").agg(F.max("lag").alias("p"), F.array_sort(F.collect_list(F.struct(at, "value"))).alias("v"))  # p * n * n values
    return own.select("model_id", "p", F.transform("v", lambda x: x["value"]).alias("coef"))


def fit_lwr(wide: DataFrame, channels: Sequence[str], order: int, unbiased: bool = True) -> DataFrame:
    """VAR rows by the lattice recursion, one task per series; it needs rows, not moments."""
    n = len(channels)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("t")[list(channels)].to_numpy(float)[None]
        head = {"model_id": [pdf["series_id"].iloc[0]], "n": n, "p": order, "rows": x.shape[1] - order}
        try:
            f = ident.fit_lwr(x, order, unbiased=unbiased)
            return pd.DataFrame({**head, "coef": [f["coef"].ravel()], "intercept": [f["intercept"][0]], "sigma": [f["sigma"].ravel()], "radius": float(M.var_radius(f["coef"])[0]), "status": "ok"})
        except (np.linalg.LinAlgError, ValueError) as e:
            return pd.DataFrame({**head, "coef": [None], "intercept": [None], "sigma": [None], "radius": [None], "status": str(e)[:200] or "failed"})

    return wide.select("series_id", "t", *channels).groupBy("series_id").applyInPandas(run, models_.VAR)


def _log_det(models: DataFrame, keep: Sequence[int], n: int, name: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["status"] == "ok"]
            if len(pdf):
                yield pd.DataFrame({"model_id": pdf["model_id"], name: L.logdet(L.sub(models_.stack(pdf["sigma"], n, n), list(keep)))})

    return models.mapInPandas(run, f"model_id string, {name} double")


def empirical_mvgc(wide: DataFrame, order: int, source: Sequence[str], target: Sequence[str], conditional: Sequence[str] = (), *, pooled: bool = True, base: float = math.e) -> DataFrame:
    """model_id, value: log determinant ratio of nested VARs fitted without and with the source."""
    less, full = [*target, *conditional], [*target, *conditional, *source]
    head = range(len(target))
    a = _log_det(models_.fit_var(wide, less, order, pooled=pooled), head, len(less), "less")
    b = _log_det(models_.fit_var(wide, full, order, pooled=pooled), head, len(full), "whole")
    return a.join(b, "model_id").select("model_id", ((F.col("less") - F.col("whole")) / math.log(base)).alias("value"))


def empirical_spectral_mvgc(wide: DataFrame, order: int, source: Sequence[str], target: Sequence[str], freqs: Sequence[float], conditional: Sequence[str] = (), *, base: float = math.e) -> DataFrame:
    """model_id, f, value by two fitted VARs; the conjugate transpose is used for complex spectra."""
    nt, nc, ns = len(target), len(conditional), len(source)
    less, full = [*target, *conditional], [*target, *conditional, *source]
    cols = ("coef", "sigma")
    a = models_.fit_var(wide, less, order, pooled=True).select(*[F.col(c).alias(f"r_{c}") for c in cols])
    b = models_.fit_var(wide, full, order, pooled=True).select("model_id", *cols)
    freqs = np.asarray(freqs, float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..functions import gaussian as G

        for pdf in batches:
            if not len(pdf):
                continue
            coef, sigma = models_.stack(pdf["coef"], order, nt + nc + ns, nt + nc + ns), models_.stack(pdf["sigma"], nt + nc + ns, nt + nc + ns)
            r_coef, r_sigma = models_.stack(pdf["r_coef"], order, nt + nc, nt + nc), models_.stack(pdf["r_sigma"], nt + nc, nt + nc)
            drivers = [*range(nt + nc, nt + nc + ns), *range(nt, nt + nc)]
            part = G.schur(sigma, drivers, list(range(nt)))
            q = M.var_inverse_transfer(r_coef, freqs)[..., :nt, :] @ np.linalg.inv(M.var_inverse_transfer(coef, freqs))[..., : nt + nc, :][..., drivers] @ L.stable_cholesky(part)[:, None]
            v = L.sub(r_sigma, list(range(nt)))
            value = (L.logdet(v)[:, None] - L.logdet(v[:, None] - q @ L.h(q))) / math.log(base)
            yield pd.DataFrame({"model_id": np.repeat(pdf["model_id"].to_numpy(), len(freqs)), "f": np.tile(freqs, len(pdf)), "value": value.ravel()})

    return b.crossJoin(F.broadcast(a)).mapInPandas(run, "model_id string, f double, value double")  # one row each


def _product(a: Sequence, b: Sequence, name: str, where=None) -> list:
    """Native sums of products of two lists of columns, as name_i_j."""
    keep = (lambda e: e) if where is None else (lambda e: F.when(where, e))
    return [F.sum(keep(x * y)).alias(f"{name}_{i}_{j}") for i, x in enumerate(a) for j, y in enumerate(b)]


def _square(row, name: str, n: int) -> np.ndarray:
    return np.array([[row[f"{name}_{i}_{j}"] for j in range(n)] for i in range(n)], float)


def whiteness(wide: DataFrame, channels: Sequence[str], order: int, block: int = lags_.BLOCK) -> DataFrame:
    """series_id, channel, dw, pvalue of a VAR's residuals.

    Everything follows from sums over consecutive rows, which native windows
    and aggregates give: no task holds a series.
    """
    n = len(channels)
    model = models_.fit_var(wide, channels, order, block=block)
    own = models_.predictions(wide, model, channels, order, block=block)
    x, e = [f"x{i}" for i in range(n)], [f"e{i}" for i in range(n)]
    own = own.select("series_id", "t", *[F.col("x")[i].alias(c) for i, c in enumerate(x)], *[F.col("residual")[i].alias(c) for i, c in enumerate(e)])
    rows = lags_.lagged(own, [*x, *e], 2, block, depth="depth")
    mean = wide.groupBy("series_id").agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(channels)])
    rows = rows.join(mean, "series_id")
    level = [F.col(c) - F.col(f"m{i}") for i, c in enumerate(x)]
    step = lambda c: F.col(c) - F.col(f"{c}_l1")
    before = lambda c: F.col(f"{c}_l1") - F.col(f"{c}_l2")
    second, third = F.col("depth") >= 1, F.col("depth") >= 2
    sums = _product(level, level, "levels") + _product([step(c) for c in x], [step(c) for c in x], "steps", second) + _product([step(c) for c in x], [before(c) for c in x], "turns", third)
    sums += [F.sum(F.when(second, step(c) * step(c))).alias(f"up{i}") for i, c in enumerate(e)] + [F.sum(F.col(c) * F.col(c)).alias(f"down{i}") for i, c in enumerate(e)]
    found = rows.groupBy("series_id").agg(F.count("*").alias("rows"), *sums)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, r in pdf.iterrows():  # a series each
                dw = np.array([r[f"up{i}"] / r[f"down{i}"] for i in range(n)], float)
                try:
                    p = testing.two_sided(dw, *testing.durbin_watson_law(_square(r, "levels", n), _square(r, "steps", n), _square(r, "turns", n), int(r["rows"])))
                except (np.linalg.LinAlgError, ZeroDivisionError):
                    p = np.full(n, np.nan)
                yield pd.DataFrame({"series_id": r["series_id"], "channel": list(channels), "dw": dw, "pvalue": p})

    return found.mapInPandas(run, "series_id string, channel string, dw double, pvalue double")


def innovation_diagnostics(predicted: DataFrame, n: int, max_lag: int = 10, block: int = lags_.BLOCK) -> DataFrame:
    """series_id, measure, value: summaries of one-step errors of prediction rows, from native sums.

    Errors are standardised by the model's covariance after the sums, which
    are of plain errors.
    """
    x, e = [f"x{i}" for i in range(n)], [f"e{i}" for i in range(n)]
    own = predicted.select("series_id", "t", "sigma", *[F.col("x")[i].alias(c) for i, c in enumerate(x)], *[F.col("residual")[i].alias(c) for i, c in enumerate(e)])
    rows = lags_.lagged(own, e, max_lag, block, depth="depth")
    now, model = [F.col(c) for c in e], [F.col(a) - F.col(b) for a, b in zip(x, e)]
    value = [F.col(c) for c in x]
    sums = [F.count("*").alias("rows"), F.first("sigma").alias("sigma")]
    for name, cols in (("e", now), ("x", value), ("p", model)):
        sums += [F.avg(c).alias(f"{name}mean_{i}") for i, c in enumerate(cols)]
        sums += [F.covar_pop(a, b).alias(f"{name}cov_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)]
    for k in range(1, max_lag + 1):
        there = F.col("depth") >= k
        late = [F.col(f"{c}_l{k}") for c in e]
        sums += [F.covar_pop(F.when(there, a), F.when(there, b)).alias(f"lag{k}_{i}_{j}") for i, a in enumerate(now) for j, b in enumerate(late)]
        sums.append(F.count_if(there).alias(f"rows{k}"))
    sums += [F.sum(F.when(F.col("depth") >= 1, F.pow(F.col(c) - F.col(f"{c}_l1"), 2))).alias(f"up{i}") for i, c in enumerate(e)]
    found = rows.groupBy("series_id").agg(*sums)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, r in pdf.iterrows():  # a series each
                mean = lambda name: np.array([r[f"{name}mean_{i}"] for i in range(n)], float)
                d = testing.innovation_summary(
                    int(r["rows"]), np.asarray(r["sigma"], float).reshape(n, n), (mean("e"), _square(r, "ecov", n)), (mean("x"), _square(r, "xcov", n)), (mean("p"), _square(r, "pcov", n)),
                    [(_square(r, f"lag{k}", n), int(r[f"rows{k}"])) for k in range(1, max_lag + 1)], np.array([r[f"up{i}"] for i in range(n)], float),
                )
                out = [(f"{k}[{i}]" if np.size(v) > 1 else k, float(z)) for k, v in d.items() for i, z in enumerate(np.ravel(v))]
                yield pd.DataFrame({"series_id": r["series_id"], "measure": [o[0] for o in out], "value": [o[1] for o in out]})

    return found.mapInPandas(run, "series_id string, measure string, value double")


def macro_sweep(spark, model: M.Innovations, *, runs: int = 16, seed: int = 0, points: int = 129, max_iter: int = 500) -> DataFrame:
    """m, run, objective, loadings of dependence searches for every macro dimension below n; tasks by (m, run)."""
    n = model.n
    grid = spark.createDataFrame([(m, k) for m in range(1, n) for k in range(runs)], "m int, run int").repartition(min(64, runs * (n - 1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for m, k in zip(pdf["m"], pdf["run"]):
                got = X.search(model, int(m), initial=X.random_frames(1, int(m), n, seed * 1000 + int(k)), objective="spectral", points=points, max_iter=max_iter)
                yield pd.DataFrame({"m": [m], "run": [k], "objective": [float(got["objective"][0])], "loadings": [X.loadings(got["rows"])[0]]})

    return grid.mapInPandas(run, "m int, run int, objective double, loadings array<double>")


def frame_distances(found: DataFrame, m: int, n: int) -> DataFrame:
    """run_a, run_b, distance of projections (run, rows); every run meets every other, runs being a parameter."""
    rows = found.select("run", "rows").toPandas()  # one row a run
    d = X.grassmann_distances(X.orthonormal(np.stack(rows["rows"]).reshape(-1, m, n)))
    ids = rows["run"].tolist()
    return found.sparkSession.createDataFrame([(int(a), int(b), float(d[i, j])) for i, a in enumerate(ids) for j, b in enumerate(ids)], "run_a long, run_b long, distance double")
