"""State-space filtering, smoothing and identification over series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ident
from ..functions import linalg as L
from ..functions import models as M
from . import checks
from . import lags as lags_
from .models import INNOVATIONS, stack, state_space_to_innovations, write_innovations


def kalman_filter(dense: DataFrame, a, c, q, r, mean=None, cov=None) -> DataFrame:
    """series_id, t, mean, innovation, loglik (running) by one general system.

    Rows stream in order of t, so a task holds the state of one series only.
    """
    a, c, q, r = (np.asarray(x, float) for x in (a, c, q, r))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, m, p, total = None, None, None, 0.0
        for pdf in batches:
            out = []
            for sid, t, x in zip(pdf["series_id"], pdf["t"], pdf["x"]):
                if sid != at:
                    at, m, p, total = sid, mean, cov, 0.0
                f = ident.kalman(np.asarray(x, float)[None], a, c, q, r, m, p)
                m, p, total = f["mean"][0], f["cov"][0], total + f["loglik"]
                out.append((sid, t, m, f["innovation"][0], total))
            yield pd.DataFrame(out, columns=["series_id", "t", "mean", "innovation", "loglik"])

    return dense.repartition("series_id").sortWithinPartitions("series_id", "t").select("series_id", "t", "x").mapInPandas(run, "series_id string, t long, mean array<double>, innovation array<double>, loglik double")


def kalman_smoother(dense: DataFrame, a, c, q, r, mean=None, cov=None) -> DataFrame:
    """series_id, t, mean, cov of smoothed states; the backward pass needs a series whole."""
    a, c, q, r = (np.asarray(x, float) for x in (a, c, q, r))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("t")
        s = ident.smooth(stack(own["x"], c.shape[0]), a, c, q, r, mean, cov)
        return pd.DataFrame({"series_id": own["series_id"], "t": own["t"], "mean": list(s["mean"]), "cov": list(s["cov"].reshape(len(own), -1))})

    return dense.groupBy("series_id").applyInPandas(run, "series_id string, t long, mean array<double>, cov array<double>")


_SUMS = ("all", "before", "after", "cross", "yz", "yy")


def _expected(a, c, q, r, cov):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e = ident.expectation(stack(pdf.sort_values("t")["x"], c.shape[0]), a, c, q, r, cov)
        return pd.DataFrame({"v": [np.concatenate([*(e[k].ravel() for k in _SUMS), [e["rows"], e["series"], e["loglik"]]])]})

    return run


def expectation_maximisation(dense: DataFrame, system: Sequence, iterations: int = 10, floor: float = 1e-8) -> tuple[list[np.ndarray], list[float]]:
    """((A, C, Q, R, state covariance), log-likelihoods) of one model for all series.

    Each iteration smooths series in parallel and adds up expected moments, a
    row of fixed size; only that row reaches the driver.
    """
    now = [np.asarray(x, float) for x in system]
    now = now if len(now) == 5 else [*now, np.eye(now[0].shape[0])]
    history = []
    for _ in range(iterations):
        a, c, q, r, cov = now

        parts = dense.groupBy("series_id").applyInPandas(_expected(a, c, q, r, cov), "v array<double>")
        d, n = a.shape[0], c.shape[0]
        size = 4 * d * d + n * d + n * n + 3
        total = np.array(parts.agg(*[F.sum(F.col("v")[i]) for i in range(size)]).first(), float)
        shapes, e, at = [(d, d)] * 4 + [(n, d), (n, n)], {}, 0
        for k, s in zip(_SUMS, shapes):
            e[k] = total[at : at + s[0] * s[1]].reshape(s)
            at += s[0] * s[1]
        e["rows"], e["series"] = total[at], total[at + 1]
        history.append(float(total[at + 2]))
        now = list(ident.maximisation(e, floor))
    return now, history


def larimore_from_moments(moments: DataFrame, n: int, states: int | Sequence[int], past: int, future: int, ridge: float = 1e-12) -> DataFrame:
    """Innovations rows by canonical variates from lag moments of past + future windows, one for every number of states.

    States are a linear map of the past, so every regression of the method
    comes from the one covariance matrix that a native pass gives.
    """
    sizes = [states] if isinstance(states, int) else list(states)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for mid, cov in zip(pdf["model_id"], _covariances(pdf, n * (past + future))):
                for r in sizes:
                    try:
                        yield write_innovations([mid], _larimore(cov, n, r, past, future, ridge)[0])
                    except (np.linalg.LinAlgError, ValueError) as e:
                        yield pd.DataFrame({"model_id": [mid], "n": n, "r": r, "a": [None], "c": [None], "k": [None], "v": [None], "status": [str(e)[:200] or "failed"]})

    return moments.select("model_id", "cov").mapInPandas(run, INNOVATIONS)


def _covariances(pdf: pd.DataFrame, d: int) -> list[np.ndarray]:
    return [np.array([np.nan if v is None else v for v in c], float).reshape(d, d) for c in pdf["cov"]]


def _larimore(cov: np.ndarray, n: int, states: int, past: int, future: int, ridge: float) -> tuple[M.Innovations, np.ndarray]:
    """The window is x_{t+future-1}, .., x_t, .., x_{t-past}, newest first."""
    block = lambda k: list(range(k * n, (k + 1) * n))
    fut = [i for k in range(future - 1, -1, -1) for i in block(k)]
    pst = [i for k in range(future, future + past) for i in block(k)]
    nxt = [i for k in range(future - 1, future + past - 1) for i in block(k)]
    y = block(future - 1)
    lp = np.linalg.cholesky(L.sub(cov, pst) + ridge * np.eye(len(pst)))
    lf = np.linalg.cholesky(L.sub(cov, fut) + ridge * np.eye(len(fut)))
    _, rho, v = np.linalg.svd(np.linalg.solve(lp, np.linalg.solve(lf, L.sub(cov, fut, pst)).T).T, full_matrices=False)
    w = (rho[:, None] * np.linalg.solve(lp.T, v.T).T)[:states]
    zz, yz = w @ L.sub(cov, pst) @ w.T, L.sub(cov, y, pst) @ w.T
    z1z = w @ L.sub(cov, nxt, pst) @ w.T
    c, a = np.linalg.solve(zz, yz.T).T, np.linalg.solve(zz, z1z.T).T
    ve = L.symmetrise(L.sub(cov, y) - c @ yz.T)
    # Next state less its prediction, on the innovation.
    cross = w @ L.sub(cov, nxt, y) - a @ (w @ L.sub(cov, pst, y)) - (z1z - a @ zz) @ c.T
    k = np.linalg.solve(ve, cross.T).T
    return M.Innovations(a[None], c[None], k[None], ve[None]), rho


def larimore(wide: DataFrame, channels: Sequence[str], states: int, past: int, future: int | None = None, *, pooled: bool = True) -> DataFrame:
    future = future or past
    return larimore_from_moments(lags_.lag_moments(wide, channels, past + future - 1, pooled=pooled), len(channels), states, past, future)


def bauer_order(wide: DataFrame, channels: Sequence[str], past: int, future: int | None = None, least: int = 1, pooled: bool = True) -> DataFrame:
    """model_id, order, svc, chosen by Bauer's criterion over canonical correlations, from order `least` on.

    A model whose windows have no positive definite covariance has one row without an order.
    """
    from ..functions import testing

    future, n = future or past, len(channels)
    moments = lags_.lag_moments(wide, channels, past + future - 1, pooled=pooled)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for mid, rows, cov in zip(pdf["model_id"], pdf["rows"], _covariances(pdf, n * (past + future))):
                try:
                    _, rho = _larimore(cov, n, 1, past, future, 1e-12)
                except (np.linalg.LinAlgError, ValueError):
                    yield pd.DataFrame({"model_id": [mid], "order": None, "svc": np.nan, "chosen": False}).astype({"order": "Int32"})
                    continue
                best, svc = testing.bauer_order(rho, n, int(rows), least)
                yield pd.DataFrame({"model_id": mid, "order": np.arange(len(svc)), "svc": svc, "chosen": np.arange(len(svc)) == best})

    return moments.select("model_id", "rows", "cov").mapInPandas(run, "model_id string, order int, svc double, chosen boolean")


def n4sid(dense: DataFrame, n: int, states: int | Sequence[int], rows: int) -> DataFrame:
    """Per series and number of states: (model_id, n, r, a, c, q, rr, status) of a general system; a task holds one series."""
    sizes = [states] if isinstance(states, int) else list(states)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("t")
        x, out = stack(own["x"], n)[None], []
        for r in sizes:
            try:
                parts, status = [v.ravel() for v in ident.n4sid(x, r, rows)["system"]], "ok"
            except (ValueError, np.linalg.LinAlgError) as e:
                parts, status = [None] * 4, str(e)[:200] or "failed"
            out.append((own["series_id"].iloc[0], n, r, *parts, status))
        return pd.DataFrame(out, columns=["model_id", "n", "r", "a", "c", "q", "rr", "status"])

    return dense.groupBy("series_id").applyInPandas(run, "model_id string, n int, r int, a array<double>, c array<double>, q array<double>, rr array<double>, status string")


def innovations(dense: DataFrame, model: M.Innovations) -> DataFrame:
    """series_id, t, innovation of one model from a zero state; rows stream in order."""
    a, c, k = model.a[0], model.c[0], model.k[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, x = None, None
        for pdf in batches:
            out = []
            for sid, v in zip(pdf["series_id"], pdf["x"]):
                if sid != at:
                    at, x = sid, np.zeros(a.shape[0])
                e = np.asarray(v, float) - c @ x
                x = a @ x + k @ e
                out.append(e)
            yield pd.DataFrame({"series_id": pdf["series_id"], "t": pdf["t"], "innovation": out})

    return dense.repartition("series_id").sortWithinPartitions("series_id", "t").select("series_id", "t", "x").mapInPandas(run, "series_id string, t long, innovation array<double>")


def filtered(rows: DataFrame, models: DataFrame, n: int, seen: Sequence[str]) -> DataFrame:
    """series_id, t, r, x, residual of test rows: one-step errors of every innovations model of a series.

    Steps of phases not in `seen`, steps without a row and rows with a null
    move the state on without a correction.  A task streams rows and holds one
    state per model; models are told apart by their number of states.
    """
    fits = models.where("status = 'ok'").select(F.col("model_id").alias("series_id"), F.lit(None).cast("long").alias("t"), "r", "a", "c", "k")
    both = checks.stream(rows.select("series_id", "t", "phase", "x"), fits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own, last = None, {}, None
        for pdf in batches:
            out = []
            for sid, t, phase, x, r, a, c, k in zip(*(pdf[v] for v in ("series_id", "t", "phase", "x", "r", "a", "c", "k"))):
                if sid != at:
                    at, own, last = sid, {}, None
                if a is not None:
                    r = int(r)
                    own[r] = [np.reshape(a, (r, r)), np.reshape(c, (n, r)), np.reshape(k, (r, n)), np.zeros(r)]
                    continue
                x = np.array([np.nan if w is None else w for w in x], float)
                whole, holes = np.isfinite(x).all(), int(t - last - 1) if last is not None else 0
                last = t
                for r, m in own.items():
                    a, c, k, z = m
                    for _ in range(holes):
                        new = a @ z
                        if np.array_equal(new, z, equal_nan=True):
                            break
                        z = new
                    e = x - c @ z
                    if phase == "test" and whole:
                        out.append((sid, t, r, x, e))
                    m[3] = a @ z + k @ e if whole and phase in seen else a @ z
            yield pd.DataFrame(out, columns=["series_id", "t", "r", "x", "residual"]).astype({"t": "int64", "r": "int32"})

    return both.mapInPandas(run, "series_id string, t long, r int, x array<double>, residual array<double>")


def fold_errors(wide: DataFrame, channels: Sequence[str], states: Sequence[int], past: int, fold_table: DataFrame, estimator: str = "larimore", evaluation: str = "rolling", gap: str = "warmup") -> DataFrame:
    """filtered() on the test rows of folds, by models of each fold's training rows, which also give the mean.

    estimator: larimore (moments) or n4sid (a task holds a fold's training rows of one series).
    Series are named series#fold; a fold in which a fit fails has no rows for it.
    """
    n = len(channels)
    train, test = checks.fold_rows(wide, channels, fold_table, None)
    if estimator == "larimore":
        fits = larimore_from_moments(lags_.lag_moments(train, channels, 2 * past - 1), n, states, past, past)
    elif estimator == "n4sid":
        whole = train.where(" and ".join(f"`{c}` is not null" for c in channels))
        fits = state_space_to_innovations(n4sid(whole.select("series_id", "t", F.array(*channels).alias("x")), n, states, past))
    else:
        raise ValueError("estimator is larimore or n4sid")
    means = train.groupBy("series_id").agg(*[F.avg(c).alias(f"__m{i}") for i, c in enumerate(channels)])
    centred = F.array(*[F.col(c) - F.col(f"__m{i}") for i, c in enumerate(channels)])
    rows = test.join(means, "series_id").select("series_id", "t", "phase", centred.alias("x"))
    return filtered(rows, fits, n, checks.seen_phases(evaluation, gap))


def out_of_sample(wide: DataFrame, channels: Sequence[str], states: int, past: int, fold_table: DataFrame, estimator: str = "larimore") -> DataFrame:
    """series_id, fold, channel, rmse, nmse, r2 of one-step errors on each fold's test rows, by the model of its training rows."""
    return checks.by_fold(checks.fit_summary(fold_errors(wide, channels, [states], past, fold_table, estimator), len(channels)))


def cross_validation(wide: DataFrame, channels: Sequence[str], states: Sequence[int], past: int, fold_table: DataFrame, rule: str = "best", estimator: str = "larimore", evaluation: str = "rolling", gap: str = "warmup") -> DataFrame:
    """states, fold, rmse with means and the choice; modes as in checks.var_cross_validation, a model per series and fold."""
    errors = fold_errors(wide, channels, states, past, fold_table, estimator, evaluation, gap)
    square = F.aggregate("residual", F.lit(0.0), lambda a, e: a + e * e) / len(channels)
    scores = errors.groupBy(checks.fold_of().alias("fold"), F.col("r").alias("states")).agg(F.sqrt(F.avg(square)).alias("rmse"))
    return checks.choose(scores, "states", "rmse", rule)
