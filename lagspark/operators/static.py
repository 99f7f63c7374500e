"""Entropies and informations of columns: counts natively, covariances by native aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce as fold

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import discrete
from ..functions import gaussian as G
from .models import stack


def entropies(rows: DataFrame, sets: Sequence[Sequence[str]], by: Sequence[str] = (), base: float = 2.0) -> DataFrame:
    """by columns, set (index into sets), n and plug-in entropy of each set of columns.

    One aggregation with grouping sets counts all code combinations at once.
    """
    cols = list(dict.fromkeys(c for s in sets for c in s))
    distinct = list(dict.fromkeys(frozenset(s) for s in sets))
    grouped = rows.groupingSets([[*by, *[c for c in cols if c in s]] for s in distinct], *by, *cols)
    counts = grouped.agg(F.count("*").alias("c"), F.grouping_id().alias("gid"))
    # grouping_id has a bit for every column that a set leaves out, the first column's the highest.
    gid = lambda s: sum(1 << (len(cols) - 1 - k) for k, c in enumerate(cols) if c not in s)
    names = rows.sparkSession.createDataFrame([(gid(set(s)), k) for k, s in enumerate(sets)], "gid long, set int")
    counts = counts.join(F.broadcast(names), "gid")  # a row per set
    total = counts.groupBy(*by, "set").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.ln("c")).alias("s"))
    return total.select(*by, "set", "n", ((F.ln("n") - F.col("s") / F.col("n")) / math.log(base)).alias("entropy"))


def _terms(rows, sets, signs, by, base, name) -> DataFrame:
    h = entropies(rows, sets, by, base)
    weight = F.element_at(F.array(*[F.lit(float(s)) for s in signs]), F.col("set") + 1)
    return h.groupBy(*by).agg(F.max("n").alias("n"), F.sum(weight * F.col("entropy")).alias(name))


def discrete_entropy(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = (), base: float = 2.0) -> DataFrame:
    return _terms(rows, [columns], [1], by, base, "entropy")


def discrete_mutual_information(rows: DataFrame, x: Sequence[str], y: Sequence[str], by: Sequence[str] = (), base: float = 2.0) -> DataFrame:
    return _terms(rows, [x, y, [*x, *y]], [1, 1, -1], by, base, "mutual_information")


def discrete_total_correlation(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = (), base: float = 2.0) -> DataFrame:
    return _terms(rows, [*[[c] for c in columns], list(columns)], [*[1] * len(columns), -1], by, base, "total_correlation")


def lempel_ziv(rows: DataFrame, key: str, order: str, symbol: str, normalise: bool = False) -> DataFrame:
    """key, length, complexity of each key's symbols in order; a task holds one sequence at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values([order, symbol], kind="stable")
        return pd.DataFrame({key: [own[key].iloc[0]], "length": [len(own)], "complexity": [discrete.lempel_ziv(own[symbol].tolist(), normalise)]})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, order, symbol).groupBy(key).applyInPandas(run, f"{key} {kind}, length long, complexity double")


def covariances(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by columns, n and cov (row-major sample covariance) by native aggregates."""
    d = len(columns)
    pair = lambda i, j: F.covar_samp(columns[i], columns[j])
    own = rows.groupBy(*by).agg(F.count("*").alias("n"), *[pair(i, j).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)])
    return own.select(*by, "n", F.array(*[F.col(f"c{min(i, j)}_{max(i, j)}") for i in range(d) for j in range(d)]).alias("cov"))


def determinant(m: list[list[Column]]) -> Column:
    """Cofactor expansion of a small matrix of columns, for plans without Python."""
    if len(m) == 1:
        return m[0][0]
    terms = [(1 if j % 2 == 0 else -1) * m[0][j] * determinant([row[:j] + row[j + 1 :] for row in m[1:]]) for j in range(len(m))]
    return fold(lambda a, b: a + b, terms)


def native_matrix(cov: str, d: int, keep: Sequence[int] | None = None) -> list[list[Column]]:
    keep = range(d) if keep is None else keep
    return [[F.col(cov)[i * d + j] for j in keep] for i in keep]


def native_measures(cov: DataFrame, d: int, base: float = 2.0) -> DataFrame:
    """cov rows with entropy, total and dual total correlation, O- and S-information; d at most 4, all in the JVM."""
    if d > 4:
        raise ValueError("closed forms are for at most four columns; use gaussian_measures")
    ld = lambda keep: F.ln(determinant(native_matrix("cov", d, keep)))
    full = ld(range(d))
    tc = 0.5 * (fold(lambda a, b: a + b, [F.ln(F.col("cov")[i * d + i]) for i in range(d)]) - full)
    # log of the inverse's diagonal is the difference of a leave-one-out determinant and the whole.
    dtc = 0.5 * (full + fold(lambda a, b: a + b, [ld([j for j in range(d) if j != i]) - full for i in range(d)])) if d > 1 else F.lit(0.0)
    scale = 1 / math.log(base)
    out = cov.withColumn("entropy", (0.5 * (d * math.log(2 * math.pi * math.e) + full)) * scale).withColumn("tc", tc * scale).withColumn("dtc", dtc * scale)
    return out.withColumn("o", F.col("tc") - F.col("dtc")).withColumn("s", F.col("tc") + F.col("dtc"))


def native_mutual_information(cov: DataFrame, d: int, left: Sequence[int], right: Sequence[int], given: Sequence[int] = (), base: float = 2.0) -> DataFrame:
    ld = lambda keep: F.ln(determinant(native_matrix("cov", d, list(keep)))) if keep else F.lit(0.0)
    x, y, z = list(left), list(right), list(given)
    return cov.withColumn("mi", 0.5 / math.log(base) * (ld(x + z) + ld(y + z) - ld(z) - ld(x + y + z)))


def gaussian_measures(cov: DataFrame, d: int, by: Sequence[str] = (), base: float = 2.0) -> DataFrame:
    """The same for any number of columns, by a kernel over covariance rows."""
    fields = ", ".join(f"{c} {dict(cov.dtypes)[c]}" for c in by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                m = stack(pdf["cov"], d, d)
                tc, dtc = G.total_correlation(m, base), G.dual_total_correlation(m, base)
                yield pdf[list(by)].assign(n=pdf["n"], entropy=G.entropy(m, base), tc=tc, dtc=dtc, o=tc - dtc, s=tc + dtc)

    return cov.select(*by, "n", "cov").mapInPandas(run, f"{fields}{', ' if by else ''}n long, entropy double, tc double, dtc double, o double, s double")


def local_mutual_information(rows: DataFrame, x: str, y: str, by: Sequence[str] = (), base: float = 2.0) -> DataFrame:
    """rows with the pointwise information of two columns under their groups' Gaussian; native.

    The statistics join by group; AQE splits a hot one, as both sides are plain shuffles.
    """
    stats = rows.groupBy(*by).agg(F.avg(x).alias("__mx"), F.avg(y).alias("__my"), F.var_samp(x).alias("__vx"), F.var_samp(y).alias("__vy"), F.covar_samp(x, y).alias("__c"))
    own = rows.join(stats, list(by)) if by else rows.crossJoin(F.broadcast(stats))  # one row
    u, v = F.col(x) - F.col("__mx"), F.col(y) - F.col("__my")
    det = F.col("__vx") * F.col("__vy") - F.col("__c") * F.col("__c")
    joint = (F.col("__vy") * u * u - 2 * F.col("__c") * u * v + F.col("__vx") * v * v) / det
    value = 0.5 * (F.ln("__vx") + F.ln("__vy") - F.ln(det)) + 0.5 * (u * u / F.col("__vx") + v * v / F.col("__vy") - joint)
    return own.withColumn("local_mi", value / math.log(base)).drop("__mx", "__my", "__vx", "__vy", "__c")


def lagged_emergence(wide: DataFrame, channels: Sequence[str], rows: Sequence[Sequence[float]], lag: int = 1, base: float = 2.0) -> DataFrame:
    """series_id and emergence criteria from plug-in covariances of each series (one native pass, one kernel)."""
    from ..functions import decomposition as P
    from . import lags as lags_

    n = len(channels)
    zero = covariances(wide, channels, ["series_id"])
    far = lags_.lagged(wide, channels, lag)
    mean = wide.groupBy("series_id").agg(*[F.avg(c).alias(f"__m{i}") for i, c in enumerate(channels)])
    cross = far.join(mean, "series_id").groupBy("series_id").agg(F.array(*[F.sum((F.col(a) - F.col(f"__m{i}")) * (F.col(f"{b}_l{lag}") - F.col(f"__m{j}"))) / (F.count("*") - 1) for i, a in enumerate(channels) for j, b in enumerate(channels)]).alias("cross"))
    names = ("psi", "delta", "gamma", "macro", "micro_to_macro", "macro_to_micro", "micro_to_micro")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                e = P.emergence(stack(pdf["cov"], n, n), stack(pdf["cross"], n, n), rows, base)
                yield pd.DataFrame({"series_id": pdf["series_id"], **{k: e[k] for k in names}})

    return zero.join(cross, "series_id").mapInPandas(run, "series_id string, " + ", ".join(f"{k} double" for k in names))
