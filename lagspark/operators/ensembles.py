"""Ensembles: bootstrap intervals, matched nulls, projection search, simulation.

An ensemble is a range of member numbers; each member draws from a stream keyed
by seed and number, so results don't depend on partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decomposition as P
from ..functions import dependence as X
from ..functions import ident
from ..functions import models as M
from ..functions import systems
from ..plans import measures as plan

#: Rows of a series that a residual bootstrap ships to its members.
MOST_ROWS = 1_000_000


def _rng(seed: int, member: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=[seed, member]))


def _one_series(dense: DataFrame) -> np.ndarray:
    rows = dense.orderBy("t").limit(MOST_ROWS + 1).select("series_id", "x").toPandas()
    if rows["series_id"].nunique(dropna=False) > 1:
        raise ValueError("a bootstrap takes one series")
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a bootstrap takes a series of at most {MOST_ROWS} rows")
    return np.stack([np.asarray(v, float) for v in rows["x"]])


def bootstrap(dense: DataFrame, n: int, order: int, names: Sequence[str] | str, config: plan.Config = plan.Config(), *, members: int = 1000, method: str = "residual", seed: int = 0) -> DataFrame:
    """MEASURES of refitted resamples of one series of at most MOST_ROWS rows, model_id being the member.

    A member that isn't stable has one row, of family status.  Longer series,
    and several, take block_bootstrap.
    """
    x = _one_series(dense)
    fit = ident.fit_var(x[None], order)
    coef, const, sigma, res = fit["coef"], fit["intercept"], fit["sigma"], fit["residuals"][0]
    res = res - res.mean(0)
    names = plan.resolve(names)
    lags = plan.required_lag(names, config)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf["id"].to_numpy()
            for i in range(0, len(ids), 64):
                own = ids[i : i + 64]
                if method == "residual":
                    shocks = np.stack([res[_rng(seed, int(k)).integers(0, len(res), len(res))] for k in own])
                else:
                    shocks = np.stack([_rng(seed, int(k)).standard_normal(res.shape) for k in own]) @ np.linalg.cholesky(sigma[0]).T
                start = np.broadcast_to(x[:order], (len(own), order, n)).copy()
                again = ident.fit_var(ident.run_var(np.broadcast_to(coef, (len(own), *coef.shape[1:])), start, shocks, const[0]), order)
                ok = M.var_radius(again["coef"]) < 1
                if ok.any():
                    c = plan.Context(M.var_to_innovations(again["coef"][ok], again["sigma"][ok]), config, lags)
                    for name in names:
                        if plan.REGISTRY[name].needs(n, config) is None:
                            yield plan.long_rows([str(k) for k in own[ok]], name, np.asarray(plan.REGISTRY[name].run(c)), c)
                if not ok.all():
                    yield plan.status_rows([str(k) for k in own[~ok]], ["unstable"] * int((~ok).sum()))

    return dense.sparkSession.range(members).mapInPandas(run, plan.MEASURES)


def bootstrap_state_space(dense: DataFrame, n: int, states: int, past: int, names: Sequence[str] | str, config: plan.Config = plan.Config(), *, members: int = 1000, seed: int = 0) -> DataFrame:
    """The same for an innovations model: its one-step errors are resampled, run through it and refitted."""
    x = _one_series(dense)
    x = x - x.mean(0)
    model = ident.larimore(x[None], states, past)["model"]
    errors = ident.innovations(x[None], model)[0]
    errors = errors - errors.mean(0)
    names = plan.resolve(names)
    lags = plan.required_lag(names, config)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in pdf["id"]:
                shocks = errors[_rng(seed, int(k)).integers(0, len(errors), len(errors))]
                again = ident.larimore(ident.run_innovations(model, shocks[None]), states, past)["model"]
                if np.abs(np.linalg.eigvals(again.a)).max() < 1:
                    c = plan.Context(again, config, lags)
                    for name in names:
                        if plan.REGISTRY[name].needs(n, config) is None:
                            yield plan.long_rows([str(k)], name, np.asarray(plan.REGISTRY[name].run(c)), c)
                else:
                    yield plan.status_rows([str(k)], ["unstable"])

    return dense.sparkSession.range(members).mapInPandas(run, plan.MEASURES)


def block_bootstrap(wide: DataFrame, channels: Sequence[str], order: int, names: Sequence[str] | str, config: plan.Config = plan.Config(), *, members: int = 1000, block: int = 256, pooled: bool = True, seed: int = 0) -> DataFrame:
    """MEASURES of VARs refitted to resampled blocks of rows, for series of any number and length.

    A block is `block` steps of one series; its lag moments are one row.  Each
    member draws every block a Poisson(1) number of times, from a stream keyed
    by seed, member and block, so a member is a weighted sum of block moments,
    added up where the blocks are.  model_id is the member, with "series#" before
    it unless pooled; members without a stable fit have one row, of family status.
    """
    from . import lags as lags_
    from .models import to_innovations, var_from_moments

    n, d = len(channels), len(channels) * (order + 1)
    rows = lags_.lagged(wide, channels, order)
    piece = F.concat_ws("#", "series_id", F.floor(F.col("t") / block).cast("string"))
    moments = lags_._moments(rows.withColumn("__series", F.lit("all") if pooled else F.col("series_id")), piece, [F.col(c) for c in lags_.design_columns(channels, order)], "__series")
    schema = "model_id string, v array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for name, series, r, mean, cov in zip(pdf["model_id"], pdf["__series"], pdf["rows"], pdf["mean"], pdf["cov"]):
                key = int.from_bytes(hashlib.blake2b(str(name).encode(), digest_size=8).digest(), "little")
                times = np.random.Generator(np.random.Philox(key=[seed, key])).poisson(1.0, members)
                mean = np.asarray(mean, float)
                second = np.nan_to_num(np.array([np.nan if c is None else c for c in cov], float)).reshape(d, d) * (r - 1) + r * np.outer(mean, mean)
                own = np.concatenate(([r], r * mean, second.ravel()))
                total[series] = total.get(series, 0) + times[:, None] * own
        for series, sums in total.items():
            yield pd.DataFrame({"model_id": [str(k) if pooled else f"{series}#{k}" for k in range(members)], "v": list(sums)})

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = np.stack([np.asarray(x, float) for x in pdf["v"]]) if len(pdf) else np.zeros((0, 1 + d + d * d))
            r = v[:, 0]
            mean = v[:, 1 : 1 + d] / np.maximum(r, 1)[:, None]
            cov = (v[:, 1 + d :].reshape(-1, d, d) - r[:, None, None] * mean[:, :, None] * mean[:, None, :]) / np.maximum(r - 1, 1)[:, None, None]
            yield pd.DataFrame({"model_id": pdf["model_id"], "rows": r.astype(int), "mean": list(mean), "cov": list(cov.reshape(-1, d * d))})

    size = 1 + d + d * d
    sums = moments.mapInPandas(run, schema).groupBy("model_id").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(size)]).alias("v"))
    again = sums.mapInPandas(finish, "model_id string, rows long, mean array<double>, cov array<double>")
    return plan.measures(to_innovations(var_from_moments(again, n, order)), names, config)


def intervals(samples: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Percentile intervals of every number in a table of resampled measures; exact, interpolated."""
    tail = (1 - confidence) / 2
    keys = ["family", "measure", "i", "j", "lag", "f", "atom"]
    own = samples.where("family <> 'status'").groupBy(*keys).agg(F.count("*").alias("members"), F.avg("value").alias("mean"), F.expr(f"percentile(value, array({tail}, {1 - tail}))").alias("q"))
    return own.select(*keys, "members", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def numit(spark: SparkSession, coef: np.ndarray, sigma: np.ndarray, source0: Sequence[int], source1: Sequence[int], *, members: int = 1000, kind: str = "mmi", seed: int = 0, base: float = 2.0, points: int = 512) -> DataFrame:
    """atom, observed, quantile of a VAR's decomposition among random VARs with as much predictive information."""
    coef, sigma = np.asarray(coef, float)[None], np.asarray(sigma, float)[None]
    order, n = coef.shape[1], coef.shape[-1]
    target = float(systems.total_information(coef, sigma, base)[0])
    seen = P.pid_of_var(coef, sigma, source0, source1, kind, base, points)[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in pdf["id"]:
                c = _rng(seed, int(k)).standard_normal((1, order, n, n)) / np.sqrt(n * order)
                s = systems.random_covariance(n, 1, seed + int(k) + 1)
                atoms = P.pid_of_var(systems.match_information(c, s, target, base), s, source0, source1, kind, base, points)[0]
                yield pd.DataFrame({"member": [int(k)] * 4, "atom": P.PID_ATOMS, "value": atoms})

    nulls = spark.range(members).mapInPandas(run, "member long, atom string, value double")
    observed = spark.createDataFrame([(a, float(v)) for a, v in zip(P.PID_ATOMS, seen)], "atom string, observed double")
    equal = F.abs(F.col("value") - F.col("observed")) <= 1e-8
    joined = nulls.join(F.broadcast(observed), "atom")  # four rows
    return joined.groupBy("atom", "observed").agg((F.avg(((F.col("value") < F.col("observed")) & ~equal).cast("double")) + 0.5 * F.avg(equal.cast("double"))).alias("quantile"))


def mid_quantiles(samples: DataFrame, value: str, reference: str, by: Sequence[str], atol: float = 1e-8) -> DataFrame:
    """by columns and the mid-quantile of a reference column among values; native."""
    equal = F.abs(F.col(value) - F.col(reference)) <= atol
    return samples.groupBy(*by).agg((F.avg(((F.col(value) < F.col(reference)) & ~equal).cast("double")) + 0.5 * F.avg(equal.cast("double"))).alias("quantile"))


def _starts(spark: SparkSession, runs: int, m: int, n: int, seed: int) -> DataFrame:
    frames = X.random_frames(runs, m, n, seed)
    return spark.createDataFrame([(i, f.ravel().tolist()) for i, f in enumerate(frames)], "run long, start array<double>").repartition(min(runs, 64))


def dependence_search(
    spark: SparkSession, model: M.Innovations, m: int, *, runs: int = 32, seed: int = 0, tolerance: float = 0.01, optimizer: str = "adaptive", points: int = 513, max_iter: int = 10_000,
    lags: int | None = None, var_coef: np.ndarray | None = None, objective: str | None = None, options: dict | None = None,
) -> DataFrame:
    """run, rows, objective (nats for the spectral one), code, size: proxy starts in parallel, clusters, spectral refinement in parallel.

    objective: proxy or spectral runs that stage alone, from all starts, with a
    size of one.  options: further arguments of functions.dependence.adaptive or armijo.
    """
    n = model.n
    white, low = X.whiten(model)
    opts = dict(optimizer=optimizer, lags=lags, points=points, max_iter=max_iter, options=options)

    def stage(kind: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for k, start in zip(pdf["run"], pdf["start"]):
                    got = X.search(model, m, initial=np.asarray(start, float).reshape(1, m, n), objective=kind, **opts, var_coef=None if kind == "spectral" else var_coef)
                    yield pd.DataFrame({"run": [k], "rows": [got["rows"][0].ravel()], "objective": [float(got["objective"][0])], "code": [int(got["code"][0])]})

        return run

    schema = "run long, rows array<double>, objective double, code int"
    starts = _starts(spark, runs, m, n, seed)
    if objective is not None:
        return starts.mapInPandas(stage(objective), schema).withColumn("size", F.lit(1))
    first = starts.mapInPandas(stage("proxy"), schema).toPandas().sort_values(["objective", "run"])  # one row a run
    reps, sizes = X.cluster(X.grassmann_distances(X.orthonormal(np.stack(first["rows"]).reshape(-1, m, n) @ low)), tolerance)
    chosen = first.iloc[reps]
    again = spark.createDataFrame([(int(r), list(map(float, v)), int(s)) for r, v, s in zip(chosen["run"], chosen["rows"], sizes)], "run long, start array<double>, size int").repartition(min(len(reps), 64))
    return again.select("run", "start").mapInPandas(stage("spectral"), schema).join(again.select("run", "size"), "run")


def search_paths(spark: SparkSession, model: M.Innovations, m: int, objective: str, *, runs: int = 32, seed: int = 0, optimizer: str = "adaptive", points: int = 513, max_iter: int = 10_000, lags: int | None = None, options: dict | None = None) -> DataFrame:
    """run, iteration, objective, step, gradient (norm) of one stage from dependence_search's starts; iteration 0 is the start."""
    n = model.n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, start in zip(pdf["run"], pdf["start"]):
                seen: list[tuple] = []
                watch = lambda i, _, f, step, norm: seen.append((i, float(f[0]), float(step[0]), float(norm[0])))
                X.search(model, m, initial=np.asarray(start, float).reshape(1, m, n), objective=objective, optimizer=optimizer, lags=lags, points=points, max_iter=max_iter, options={**(options or {}), "watch": watch})
                yield pd.DataFrame(seen, columns=["iteration", "objective", "step", "gradient"]).assign(run=k)[["run", "iteration", "objective", "step", "gradient"]]

    return _starts(spark, runs, m, n, seed).mapInPandas(run, "run long, iteration int, objective double, step double, gradient double")


def candidate_search(spark: SparkSession, model: M.Innovations, m: int, *, candidates: int = 256, seed: int = 0, smallest: bool = True) -> DataFrame:
    """The best of random projections by exact dependence in bits: one row (run, rows, value)."""
    from ..functions import causality as R

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in pdf["id"]:
                rows = X.random_frames(1, m, model.n, seed + int(k))
                yield pd.DataFrame({"run": [int(k)], "rows": [rows[0].ravel()], "value": R.dynamical_dependence(model, rows)})

    pick = F.min_by if smallest else F.max_by
    got = spark.range(candidates).mapInPandas(run, "run long, rows array<double>, value double")
    return got.agg(pick(F.struct("run", "rows", "value"), F.struct("value", "run")).alias("b")).select("b.*")


def simulate(models: DataFrame, times: int, *, burn: int | None = None, seed: int = 0) -> DataFrame:
    """series_id, t, x, innovation: trajectories of VAR rows from streams keyed by seed and model_id.

    burn None takes as many steps as a model needs to forget its start.
    """
    from .models import kernel, read_var

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        coef, sigma = read_var(pdf)
        keys = [int.from_bytes(hashlib.blake2b(str(m).encode(), digest_size=8).digest(), "little") for m in pdf["model_id"]]
        x, e = ident.simulate_var(coef, sigma, times, burn=burn, seed=seed, keys=keys, shocks=True)
        n = x.shape[-1]
        return pd.DataFrame({"series_id": np.repeat(pdf["model_id"].to_numpy(), times), "t": np.tile(np.arange(times), len(pdf)), "x": list(x.reshape(-1, n)), "innovation": list(e.reshape(-1, n))})

    return kernel(models, "series_id string, t long, x array<double>, innovation array<double>", run)


def system_parameters(spark: SparkSession) -> DataFrame:
    """system, parameter: what every synthetic topology takes besides its size."""
    return spark.createDataFrame([(s, p) for s in systems.SYSTEMS for p in systems.parameters(s)], "system string, parameter string")


def synthetic_catalogue(spark: SparkSession, n: int = 5, radii: Sequence[float] = (0.5, 0.8), correlations: Sequence[float] = (0.0, 0.3)) -> DataFrame:
    """VAR rows of every synthetic topology over a grid of radii and noise correlations."""
    from .models import VAR

    grid = [(s, r, c) for s in systems.SYSTEMS for r in radii for c in correlations]
    rows = []
    for s, r, c in grid:
        coef, sigma = systems.synthetic_var(s, n, r, c)
        rows.append((f"{s}|{r}|{c}", n, 1, 0, coef.ravel().tolist(), [0.0] * n, sigma.ravel().tolist(), float(M.var_radius(coef)[0]), "ok"))
    return spark.createDataFrame(rows, VAR)
