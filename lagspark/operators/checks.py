"""Diagnostics, tests and order selection as DataFrames."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import testing
from . import lags as lags_
from . import models as models_


def durbin_watson(rows: DataFrame, error: str, block: int = lags_.BLOCK) -> DataFrame:
    """series_id, dw of an error column: squared steps over squares, windows by blocks of steps."""
    steps = lags_.lagged(rows.select("series_id", "t", error), [error], 1, block)
    up = steps.groupBy("series_id").agg(F.sum(F.pow(F.col(error) - F.col(f"{error}_l1"), 2)).alias("up"))
    down = rows.groupBy("series_id").agg(F.sum(F.col(error) * F.col(error)).alias("down"))
    return up.join(down, "series_id").select("series_id", (F.col("up") / F.col("down")).alias("dw"))


def ljung_box(rows: DataFrame, error: str, max_lag: int, block: int = lags_.BLOCK) -> DataFrame:
    """series_id, n, q and p-value of an error column; one windowed pass gives all autocorrelations."""
    base = rows.groupBy("series_id").agg(F.avg(error).alias("m"), F.var_pop(error).alias("v"), F.count("*").alias("n"))
    own = lags_.lagged(rows.select("series_id", "t", error), [error], max_lag, block, depth="depth").join(base, "series_id")
    e = F.col(error) - F.col("m")
    rho = [(F.sum(F.when(F.col("depth") >= k, e * (F.col(f"{error}_l{k}") - F.col("m")))) / F.first("n") / F.first("v")).alias(f"r{k}") for k in range(1, max_lag + 1)]
    out = own.groupBy("series_id").agg(F.first("n").alias("n"), *rho)
    q = F.col("n") * (F.col("n") + 2) * sum((F.pow(f"r{k}", 2) / (F.col("n") - k) for k in range(1, max_lag + 1)), F.lit(0.0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..functions import special

        for pdf in batches:
            yield pdf.assign(pvalue=special.chi2_sf(pdf["q"].to_numpy(float), max_lag) if len(pdf) else [])

    return out.select("series_id", "n", q.alias("q")).mapInPandas(run, "series_id string, n long, q double, pvalue double")


def _p_bin(p: str, bins: int) -> Column:
    """Bins that rise with p: `bins` of equal width above 1/64, and as many in all for each halving below."""
    even = F.floor(F.col(p) * bins)
    halvings = F.floor(F.log2(F.greatest(F.col(p), F.lit(5e-324))) * (bins // 16)) - 2 * bins  # below every even bin
    return F.when(F.col(p) >= 1 / 64, F.least(even, F.lit(bins))).otherwise(halvings).cast("long")


def significance(rows: DataFrame, p: str = "p", alpha: float = 0.05, method: str = "fdr_bh", by: Sequence[str] = (), bins: int = 1024) -> DataFrame:
    """rows with `significant`; Benjamini-Hochberg per group, null and NaN never significant.

    Only the threshold needs an order, so ranks are taken within ranges of p:
    counts of bins give each bin's first rank, and rows rank within theirs.
    Small p-values, the usual crowd, have bins by their logarithm; bins is the
    number for the others, to grow with the rows.
    """
    finite = F.col(p).isNotNull() & ~F.isnan(p)
    if method == "none":
        return rows.withColumn("significant", finite & (F.col(p) <= alpha))
    own = rows.where(finite).select(*by, F.col(p).alias("__p"), _p_bin(p, bins).alias("__bin"))
    counts = own.groupBy(*by, "__bin").agg(F.count("*").alias("__c"))
    before = W.Window.partitionBy(*by).orderBy("__bin").rowsBetween(W.Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0))).withColumn("__m", F.sum("__c").over(W.Window.partitionBy(*by)))
    ranked = own.withColumn("__rank", F.count("*").over(W.Window.partitionBy(*by, "__bin").orderBy("__p"))).join(counts, [*by, "__bin"])
    limit = ranked.where(F.col("__p") <= alpha * (F.col("__rank") + F.col("__before")) / F.col("__m")).groupBy(*by).agg(F.max("__p").alias("__limit"))
    out = rows.join(limit, list(by), "left") if by else rows.crossJoin(F.broadcast(limit))  # one row
    return out.withColumn("significant", F.coalesce(finite & (F.col(p) <= F.col("__limit")), F.lit(False))).drop("__limit")


def mvgc_pvalues(stats: DataFrame, groups: tuple[int, int, int], order: int, rows: int, law: str = "f") -> DataFrame:
    """stats (.., value) with a p-value column by testing.causality_pvalue."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(p=testing.causality_pvalue(pdf["value"].to_numpy(float), groups, order, rows, law) if len(pdf) else [])

    return stats.mapInPandas(run, ", ".join(f"{c} {k}" for c, k in stats.dtypes) + ", p double")


def prediction_consistency(predicted: DataFrame, n: int) -> DataFrame:
    """series_id and consistency of prediction rows: 1 - |Rs - Rr| / |Rr|, from native moments."""
    exps = [F.covar_samp(F.col("x")[i], F.col("x")[j]).alias(f"r{i}_{j}") for i in range(n) for j in range(n)]
    exps += [F.covar_samp(F.col("prediction")[i], F.col("prediction")[j]).alias(f"s{i}_{j}") for i in range(n) for j in range(n)]
    own = predicted.groupBy("series_id").agg(*exps)
    total = lambda f: sum((f(i, j) for i in range(n) for j in range(n)), F.lit(0.0))
    diff = total(lambda i, j: F.pow(F.col(f"s{i}_{j}") - F.col(f"r{i}_{j}"), 2))
    return own.select("series_id", (1 - F.sqrt(diff) / F.sqrt(total(lambda i, j: F.pow(f"r{i}_{j}", 2)))).alias("consistency"))


def fit_summary(predicted: DataFrame, n: int) -> DataFrame:
    """series_id, channel, rmse, nmse, r2 of prediction rows; native."""
    each = predicted.select("series_id", F.posexplode(F.arrays_zip("x", "residual")).alias("channel", "v"))
    own = each.groupBy("series_id", "channel").agg(F.avg(F.pow("v.residual", 2)).alias("mse"), F.var_pop("v.x").alias("var"))
    return own.select("series_id", "channel", F.sqrt("mse").alias("rmse"), (F.col("mse") / F.col("var")).alias("nmse"), (1 - F.col("mse") / F.col("var")).alias("r2"))


def select_by_criteria(scores: DataFrame, criterion: str = "bic", by: Sequence[str] = (), small_sample: bool = False) -> DataFrame:
    """scores (order, loglik, k, n) with aic, bic, hqc, their difference to the least, and the chosen one; small_sample corrects aic."""
    l, k, n = F.col("loglik"), F.col("k"), F.col("n")
    aic = -2 * l + 2 * k
    if small_sample:
        aic = aic + F.when(n - k > 1, 2 * k * (k + 1) / (n - k - 1))
    out = scores.withColumn("aic", aic).withColumn("bic", -2 * l + k * F.ln(n)).withColumn("hqc", -2 * l + 2 * k * F.ln(F.ln(n)))
    w = W.Window.partitionBy(*by)  # as many rows as candidate orders
    out = out.withColumn("delta", F.col(criterion) - F.min(criterion).over(w))
    return out.withColumn("chosen", F.row_number().over(w.orderBy(F.col(criterion), "order")) == 1)


def var_criteria(wide: DataFrame, channels: Sequence[str], orders: Sequence[int], criterion: str = "bic", pooled: bool = True, per_observation: bool = False, covariance: bool = False, small_sample: bool = False) -> DataFrame:
    """model_id, order, loglik, k, n and criteria; one native pass serves all orders.

    The log-likelihood is that of the unbiased residual covariance, k = order *
    n^2, with covariance also its n (n + 1) / 2 numbers, and every order has the
    rows its own lags leave.
    """
    n, most = len(channels), max(orders)
    d = n * (most + 1)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [(int(u), int(r), np.array([np.nan if v is None else v for v in m], float), np.array([np.nan if v is None else v for v in c], float).reshape(d, d)) for u, r, m, c in zip(pdf["depth"], pdf["rows"], pdf["mean"], pdf["cov"])]
        out = []
        for p in orders:
            use = [x[1:] for x in parts if x[0] >= p]
            free = sum(x[0] for x in use) - n * p - 1
            if free <= 0:
                continue
            rows, _, cov = lags_.merge([(r, m[: n * (p + 1)], c[: n * (p + 1), : n * (p + 1)]) for r, m, c in use])
            spread = cov * (rows - 1)
            try:
                left = spread[:n, :n] - spread[:n, n:] @ np.linalg.solve(spread[n:, n:], spread[n:, :n])
                sign, ld = np.linalg.slogdet(left / free)
            except np.linalg.LinAlgError:
                continue
            if sign > 0:
                out.append((key[0], p, -0.5 * rows * (n * math.log(2 * math.pi) + ld + n), testing.var_parameters(n, p, covariance), rows))
        return pd.DataFrame(out, columns=["model_id", "order", "loglik", "k", "n"])

    moments = lags_.depth_moments(wide, channels, most, pooled=pooled)
    out = moments.groupBy("model_id").applyInPandas(run, "model_id string, order int, loglik double, k long, n long")  # a row per depth
    out = select_by_criteria(out, criterion, ["model_id"], small_sample)
    return out if not per_observation else out.select("model_id", "order", "loglik", "k", "n", *[(F.col(c) / F.col("n")).alias(c) for c in ("aic", "bic", "hqc", "delta")], "chosen")


def folds(n_times: int, spark, *, k: int = 5, test: int | None = None, min_train: int | None = None, gap: int = 0) -> DataFrame:
    """(fold, train_end, test_start, test_end) in steps from a series' first; a parameter table."""
    rows = [(i, *f) for i, f in enumerate(testing.splits(n_times, folds=k, test=test, min_train=min_train, gap=gap))]
    return spark.createDataFrame(rows, "fold int, train_end long, test_start long, test_end long")


def fold_rows(wide: DataFrame, channels: Sequence[str], fold_table: DataFrame, past: int | None, since: str = "train_end") -> tuple[DataFrame, DataFrame]:
    """(training, test) rows of every fold, as series named series#fold; a range join with a parameter table.

    Test rows begin `past` steps before the fold's train_end or test_start
    (None: at the series' first); their phase is past, gap or test.
    """
    first = wide.groupBy("series_id").agg(F.min("t").alias("__t0"))
    rows = wide.join(first, "series_id").withColumn("__u", F.col("t") - F.col("__t0"))
    f = F.broadcast(fold_table)  # k rows
    u, end = F.col("__u"), F.col("train_end")
    name = F.concat_ws("#", "series_id", F.col("fold").cast("string")).alias("series_id")
    phase = F.when(u < end, "past").when(u < F.col("test_start"), "gap").otherwise("test").alias("phase")
    train = rows.join(f, u < end).select(name, "t", *channels)
    reach = u < F.col("test_end")
    test = rows.join(f, reach if past is None else reach & (u >= F.col(since) - past)).select(name, "t", *channels, phase)
    return train, test


def fold_of(name: str = "series_id") -> Column:
    return F.element_at(F.split(name, "#"), -1).cast("int")


def seen_phases(evaluation: str, gap: str) -> tuple[str, ...]:
    """Phases whose rows update a model: rolling sees tested rows, recursive doesn't; warmup sees the gap, embargo doesn't."""
    if evaluation not in ("rolling", "recursive") or gap not in ("warmup", "embargo"):
        raise ValueError("evaluation is rolling or recursive, gap is warmup or embargo")
    return ("past",) + ("gap",) * (gap == "warmup") + ("test",) * (evaluation == "rolling")


def stream(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """Rows of series in order of t, each series after its model rows, whose t is null; the model isn't copied to every row."""
    both = rows.unionByName(fits, allowMissingColumns=True)
    return both.repartition("series_id").sortWithinPartitions("series_id", F.col("t").asc_nulls_first())


def stepped(test: DataFrame, models: DataFrame, channels: Sequence[str], order: int, seen: Sequence[str]) -> DataFrame:
    """series_id, t, x, prediction, residual, sigma of the test rows of folds, step by step.

    Steps of phases not in `seen`, steps without a row and rows with a null go
    on with their prediction.  A task streams rows and holds `order` steps.
    """
    n = len(channels)
    fits = models.where("status = 'ok'").select(F.col("model_id").alias("series_id"), F.lit(None).cast("long").alias("t"), "coef", "intercept", "sigma")
    rows = stream(test.select("series_id", "t", "phase", F.array(*channels).alias("x")), fits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, coef, const, sigma, past, last = None, None, None, None, np.empty((0, n)), None

        def ahead() -> np.ndarray:
            return const + np.einsum("kij,kj->i", coef, past[::-1])

        for pdf in batches:
            out = []
            for sid, t, phase, x, b, c, v in zip(*(pdf[k] for k in ("series_id", "t", "phase", "x", "coef", "intercept", "sigma"))):
                if sid != at:
                    at, coef, past, last = sid, None, np.empty((0, n)), None
                if b is not None:
                    coef, const, sigma = np.reshape(np.asarray(b, float), (order, n, n)), np.asarray(c, float), v
                    continue
                if coef is None:
                    continue
                for _ in range(int(t - last - 1) if last is not None else 0):
                    new = np.vstack([past[1:], ahead()]) if len(past) == order else np.empty((0, n))
                    if new.shape == past.shape and np.array_equal(new, past, equal_nan=True):
                        break
                    past = new
                last = t
                x = np.array([np.nan if w is None else w for w in x], float)
                full, whole = len(past) == order, np.isfinite(x).all()
                guess = ahead() if full else None
                if phase == "test" and full and whole:
                    out.append((sid, t, x, guess, x - guess, sigma))
                new = x if whole and phase in seen else guess
                past = np.empty((0, n)) if new is None else np.vstack([past, new])[-order:]
            yield pd.DataFrame(out, columns=["series_id", "t", "x", "prediction", "residual", "sigma"]).astype({"t": "int64"})

    return rows.mapInPandas(run, "series_id string, t long, x array<double>, prediction array<double>, residual array<double>, sigma array<double>")


def out_of_sample(wide: DataFrame, channels: Sequence[str], order: int, fold_table: DataFrame) -> DataFrame:
    """series_id, fold, channel, rmse, nmse, r2 of one-step errors on each fold's test rows, by the VAR of its training rows."""
    train, test = fold_rows(wide, channels, fold_table, order, "test_start")
    return by_fold(fit_summary(models_.predictions(test, models_.fit_var(train, channels, order), channels, order), len(channels)))


def by_fold(summary: DataFrame) -> DataFrame:
    """A fit_summary of series named series#fold, with series and fold apart."""
    series = F.regexp_extract("series_id", "^(.*)#[0-9]+$", 1)
    return summary.select(series.alias("series_id"), fold_of().alias("fold"), *summary.columns[1:])


def var_cross_validation(wide: DataFrame, channels: Sequence[str], orders: Sequence[int], fold_table: DataFrame, rule: str = "best", scoring: str = "rmse", evaluation: str = "rolling", gap: str = "warmup") -> DataFrame:
    """order, fold, score (rmse or nll) of held-out predictions, with each order's mean and the choice.

    evaluation: rolling predicts one step from observations, recursive goes on
    from its own predictions.  gap: warmup lets the rows between training and
    test update the history, embargo goes on with predictions there.

    Rows join the folds as a range join with a parameter table; all folds of an
    order are fitted in one pass, as series named by the fold.  Rolling scores
    after a warmup are a native projection over the lag design.
    """
    seen = seen_phases(evaluation, gap)
    parts = []
    for p in orders:
        native = len(seen) == 3
        train, test = fold_rows(wide, channels, fold_table, p, "test_start" if native else "train_end")
        fits = models_.fit_var(train, channels, p)
        got = models_.predictions(test, fits, channels, p) if native else stepped(test, fits, channels, p, seen)
        if scoring == "nll":
            got, score = models_.negative_log_likelihood(got, len(channels)), F.avg("nll")
        else:
            score = F.sqrt(F.avg(F.aggregate("residual", F.lit(0.0), lambda a, r: a + r * r) / len(channels)))
        parts.append(got.groupBy(fold_of().alias("fold")).agg(score.alias(scoring)).withColumn("order", F.lit(p)))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return choose(out, "order", scoring, rule)


def choose(scores: DataFrame, order: str, scoring: str, rule: str) -> DataFrame:
    """Scores per order and fold with mean and standard error by order, and the order that the rule takes: a row per order and fold."""
    w, every = W.Window.partitionBy(order), W.Window.partitionBy()  # scores of candidates: few rows
    out = scores.withColumn("mean", F.avg(scoring).over(w)).withColumn("se", F.stddev_samp(scoring).over(w) / F.sqrt(F.count("*").over(w)))
    known = F.col("mean").isNotNull() & ~F.isnan("mean")
    best = F.min(F.when(known, F.struct("mean", order, "se"))).over(every)
    limit = best["mean"] + (F.coalesce(best["se"], F.lit(0.0)) if rule == "one_se" else 0.0)
    out = out.withColumn("__limit", limit)
    chosen = F.min(F.when(F.col("mean") <= F.col("__limit"), F.col(order))).over(every)
    return out.withColumn("chosen", F.coalesce(F.col(order) == chosen, F.lit(False))).drop("__limit")
