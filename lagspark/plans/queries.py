"""Registered queries of the analytics operators, each with SQL for DuckDB where SQL can express it.

Computed columns are rounded on both sides; `+ 0.0` removes negative zeros.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources as S
from ..functions import models as M
from ..functions import systems
from ..operators import checks, empirical, ensembles, lags, models, static, statespace
from ..session import ship
from . import measures as plan

TYPES3 = ("purchase", "click", "view")
TYPES2 = TYPES3[:2]
Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{d}/{table}.parquet")


def hourly(spark: SparkSession, d: str, channels=TYPES2) -> DataFrame:
    return S.regularise(_read(spark, d, "events"), time="ts", unit="HOUR", value="value", channel="event_type", channels=channels)


def daily_users(spark: SparkSession, d: str) -> DataFrame:
    return S.regularise(_read(spark, d, "events"), time="ts", unit="DAY", value="value", channel="event_type", channels=TYPES2, series=F.col("user_id"))


def steps(wide: DataFrame) -> int:
    """Steps of one gap-free series, from its first to its last."""
    return wide.agg(F.max("t") - F.min("t") + 1).first()[0] or 0


def folds_of(wide: DataFrame) -> DataFrame:
    return checks.folds(steps(wide), wide.sparkSession, k=3, test=60)


def r(c: Column | str, k: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, k) + 0.0


def rounded(df: DataFrame, k: int = 6) -> DataFrame:
    return df.select(*[r(F.col(f"`{c}`"), k).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])


# SQL building blocks.


def sql_grid(unit: str, channels, series: str = "'all'") -> str:
    sums = ", ".join(f"sum(case when event_type = '{c}' then value end) as {c}" for c in channels)
    fills = ", ".join(f"coalesce(c.{c}, 0.0::double) as {c}" for c in channels)
    return f"""ev as (select {series}::varchar as series_id, datediff('{unit}', timestamp '1970-01-01', ts) as t, event_type, value from events),
cells as (select series_id, t, {sums} from ev group by 1, 2),
span as (select series_id, min(t) as lo, max(t) as hi from cells group by 1),
full_grid as (select series_id, unnest(generate_series(lo, hi)) as t from span),
g as (select f.series_id, f.t, {fills} from full_grid f left join cells c on f.series_id = c.series_id and f.t = c.t)"""


def sql_lags(channels, p: int = 1, grid: str = "g") -> str:
    cols = ", ".join(f"lag({c}, {k}) over w as {c}_l{k}" for k in range(1, p + 1) for c in channels)
    return f"lagged as (select * from (select *, {cols}, lag(t, {p}) over w as t0 from {grid} window w as (partition by series_id order by t)) where t - t0 = {p})"


def sql_var1(by: str | None = None, alpha: float = 0.0) -> str:
    """Coefficients a11..a22, intercepts and sigma of a VAR(1) of two channels x, y."""
    x, y = TYPES2
    cs = [x, y, f"{x}_l1", f"{y}_l1"]
    names = "pquv"
    cov = ", ".join(f"covar_samp({cs[i]}, {cs[j]}) * (count(*) - 1) as s{names[i]}{names[j]}" for i in range(4) for j in range(i, 4))
    head = f"{by} as model_id" if by else "'all' as model_id"
    return f"""mom as (select {head}, count(*) as rws, avg({x}) as mp, avg({y}) as mq, avg({x}_l1) as mu, avg({y}_l1) as mv, {cov} from lagged group by 1),
ridge as (select *, suu + {alpha} as ru, svv + {alpha} as rv from mom),
ab as (select *, ru * rv - suv * suv as det from ridge),
co as (select *, (spu * rv - spv * suv) / det as a11, (spv * ru - spu * suv) / det as a12, (squ * rv - sqv * suv) / det as a21, (sqv * ru - squ * suv) / det as a22 from ab),
var1 as (select *, mp - a11 * mu - a12 * mv as c1, mq - a21 * mu - a22 * mv as c2,
  (spp - 2 * (a11 * spu + a12 * spv) + a11 * a11 * suu + 2 * a11 * a12 * suv + a12 * a12 * svv) / (rws - 3) as s11,
  (spq - a21 * spu - a22 * spv - a11 * squ - a12 * sqv + a11 * a21 * suu + (a11 * a22 + a12 * a21) * suv + a12 * a22 * svv) / (rws - 3) as s12,
  (sqq - 2 * (a21 * squ + a22 * sqv) + a21 * a21 * suu + 2 * a21 * a22 * suv + a22 * a22 * svv) / (rws - 3) as s22 from co)"""


BASE = "with " + sql_grid("hour", TYPES2) + ", " + sql_lags(TYPES2) + ", " + sql_var1()
#: Stationary covariance by doubling-free iteration: P <- S + A P A'.
LYAPUNOV = """, lyap as (select p11, p12, p22 from (with recursive it(k, p11, p12, p22) as (
  select 0, s11, s12, s22 from var1 union all
  select k + 1, s11 + a11*a11*p11 + 2*a11*a12*p12 + a12*a12*p22, s12 + a11*a21*p11 + (a11*a22 + a12*a21)*p12 + a12*a22*p22, s22 + a21*a21*p11 + 2*a21*a22*p12 + a22*a22*p22
  from it, var1 where k < 200) select * from it where k = 200))"""
#: Spectrum of the VAR(1) at 129 points of [0, 1/2]: powers f11, f22 and squared modulus of f12.
SPECTRUM = """, grid as (select i, i / 256.0::double as f, case when i in (0, 128) then 0.5::double else 1.0::double end / 128 as w from range(129) t(i)),
tr as (select i, f, w, cos(2*pi()*f) as cc, sin(2*pi()*f) as ss from grid),
b as (select tr.*, v.*, 1 - a11*cc as b11r, a11*ss as b11i, -a12*cc as b12r, a12*ss as b12i, -a21*cc as b21r, a21*ss as b21i, 1 - a22*cc as b22r, a22*ss as b22i from tr, var1 v),
dt as (select *, b11r*b22r - b11i*b22i - b12r*b21r + b12i*b21i as dr, b11r*b22i + b11i*b22r - b12r*b21i - b12i*b21r as di from b),
sp as (select *, dr*dr + di*di as dd,
  (s11*(b22r*b22r + b22i*b22i) + s22*(b12r*b12r + b12i*b12i) - 2*s12*(b22r*b12r + b22i*b12i)) / (dr*dr + di*di) as f11,
  (s11*(b21r*b21r + b21i*b21i) + s22*(b11r*b11r + b11i*b11i) - 2*s12*(b21r*b11r + b21i*b11i)) / (dr*dr + di*di) as f22,
  (s11*s22 - s12*s12) / (dr*dr + di*di) as fdet from dt),
sz as (select exp(sum(w * ln(f11))) as v1, exp(sum(w * ln(f22))) as v2 from sp)"""


# Series and estimation.


@query("grid_hourly", "with " + sql_grid("hour", TYPES3) + " select series_id, t, round(purchase, 6) + 0.0 as purchase, round(click, 6) + 0.0 as click, round(view, 6) + 0.0 as view from g")
def grid_hourly(spark, d):
    return rounded(hourly(spark, d, TYPES3))


@query("grid_daily_users", "with " + sql_grid("day", TYPES2, "user_id") + " select series_id, t, round(purchase, 6) + 0.0 as purchase, round(click, 6) + 0.0 as click from g")
def grid_daily_users(spark, d):
    return rounded(daily_users(spark, d))


@query("series_long", "with " + sql_grid("hour", TYPES2) + " select series_id, t, 'purchase' as channel, round(purchase, 6) + 0.0 as value from g union all select series_id, t, 'click', round(click, 6) + 0.0 from g")
def series_long(spark, d):
    return rounded(S.to_long(hourly(spark, d), TYPES2))


@query("lag_design_p2", "with " + sql_grid("hour", TYPES2) + ", " + sql_lags(TYPES2, 2) + " select series_id, t, " + ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in lags.design_columns(TYPES2, 2)) + " from lagged")
def lag_design(spark, d):
    return rounded(lags.lagged(hourly(spark, d), TYPES2, 2).select("series_id", "t", *lags.design_columns(TYPES2, 2)))


_D = lags.design_columns(TYPES2, 1)


@query("lag_moments_p1", "with " + sql_grid("hour", TYPES2) + ", " + sql_lags(TYPES2) + " select count(*) as n, " + ", ".join(f"round(avg({a}), 6) + 0.0 as m{i}" for i, a in enumerate(_D)) + ", " + ", ".join(f"round(covar_samp({a}, {b}), 4) + 0.0 as c{i}{j}" for i, a in enumerate(_D) for j, b in enumerate(_D)) + " from lagged")
def lag_moments(spark, d):
    m = lags.lag_moments(hourly(spark, d), TYPES2, 1)
    return m.select(F.col("rows").alias("n"), *[r(F.col("mean")[i]).alias(f"m{i}") for i in range(4)], *[r(F.col("cov")[4 * i + j], 4).alias(f"c{i}{j}") for i in range(4) for j in range(4)])


def _var_columns(m: DataFrame) -> DataFrame:
    at = lambda c, i: r(F.col(c)[i])
    return m.select("model_id", "rows", *[at("coef", i).alias(f"a{x}") for i, x in enumerate(("11", "12", "21", "22"))], at("intercept", 0).alias("c1"), at("intercept", 1).alias("c2"), r(F.col("sigma")[0], 3).alias("s11"), r(F.col("sigma")[1], 3).alias("s12"), r(F.col("sigma")[3], 3).alias("s22"))


_VAR = " select model_id, rws as rows, " + ", ".join(f"round({c}, {3 if c[0] == 's' else 6}) + 0.0 as {c}" for c in ("a11", "a12", "a21", "a22", "c1", "c2", "s11", "s12", "s22")) + " from var1"


@query("var1_ols_n2", BASE + _VAR)
def var1_ols(spark, d):
    return _var_columns(models.fit_var(hourly(spark, d), TYPES2))


@query("var1_ridge_n2", "with " + sql_grid("hour", TYPES2) + ", " + sql_lags(TYPES2) + ", " + sql_var1(alpha=1000.0) + _VAR)
def var1_ridge(spark, d):
    return _var_columns(models.fit_var(hourly(spark, d), TYPES2, alpha=1000.0))


_USERS = "with " + sql_grid("day", TYPES2, "user_id") + ", " + sql_lags(TYPES2) + ", "


@query("var1_independent_by_user", _USERS + sql_var1("series_id") + _VAR + " where rws > 6 and det > 1e-6 * ru * rv")
def var1_independent(spark, d):
    m = lags.lag_moments(daily_users(spark, d), TYPES2, 1).where("rows > 6")
    c = F.col("cov")
    ok = (c[10] * c[15] - c[11] * c[11]) > 1e-6 * c[10] * c[15]
    return _var_columns(models.var_from_moments(m.where(ok), 2, 1))


@query("var1_pooled_by_user", _USERS + sql_var1() + _VAR)
def var1_pooled(spark, d):
    return _var_columns(models.fit_var(daily_users(spark, d), TYPES2, pooled=True))


@query("var2_n3")
def var2(spark, d):
    return rounded(models.fit_var(hourly(spark, d, TYPES3), TYPES3, 2).select("model_id", "rows", F.posexplode("coef").alias("k", "value")))


_RES = BASE + ", res as (select l.series_id, l.t, purchase, click, c1 + a11*purchase_l1 + a12*click_l1 as p1, c2 + a21*purchase_l1 + a22*click_l1 as p2, v.* from lagged l, var1 v)"


def _predicted(spark, d):
    w = hourly(spark, d)
    return models.predictions(w, models.fit_var(w, TYPES2), TYPES2, 1)


@query("var1_residuals", _RES + " select series_id, t, round(p1, 4) + 0.0 as p1, round(p2, 4) + 0.0 as p2, round(purchase - p1, 4) + 0.0 as e1, round(click - p2, 4) + 0.0 as e2 from res")
def var1_residuals(spark, d):
    return _predicted(spark, d).select("series_id", "t", *[r(F.col("prediction")[i], 4).alias(f"p{i + 1}") for i in (0, 1)], *[r(F.col("residual")[i], 4).alias(f"e{i + 1}") for i in (0, 1)])


@query("var1_nll", _RES + ", q as (select *, purchase - p1 as e1, click - p2 as e2, s11*s22 - s12*s12 as dets from res) select round(avg(0.5 * ((s22*e1*e1 - 2*s12*e1*e2 + s11*e2*e2) / dets + ln(dets) + 2 * ln(2*pi()))), 6) + 0.0 as mean_nll, count(*) as n from q")
def var1_nll(spark, d):
    return models.negative_log_likelihood(_predicted(spark, d), 2).agg(r(F.avg("nll")).alias("mean_nll"), F.count("*").alias("n"))


@query("var1_forecast", BASE + ", last_row as (select * from g order by t desc limit 1), fc as (with recursive it(k, x, y) as (select 0, purchase, click from last_row union all select k + 1, c1 + a11*x + a12*y, c2 + a21*x + a22*y from it, var1 where k < 5) select * from it) select 'all' as series_id, t + k as t, round(x, 4) + 0.0 as purchase, round(y, 4) + 0.0 as click from fc, (select max(t) as t from g) where k > 0")
def var1_forecast(spark, d):
    w = hourly(spark, d)
    f = models.forecast(w, models.fit_var(w, TYPES2), TYPES2, 1, 5)
    return f.select("series_id", "t", r(F.col("x")[0], 4).alias("purchase"), r(F.col("x")[1], 4).alias("click"))


# Static measures.


def _embedded(spark, d, k=3):
    return _read(spark, d, "embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(k)])


def sql_cov(k: int) -> str:
    return "with e as (select label, " + ", ".join(f"embedding[{i + 1}]::double as e{i}" for i in range(k)) + " from embeddings), c as (select label, count(*) as n, " + ", ".join(f"covar_samp(e{i}, e{j}) as c{i}{j}" for i in range(k) for j in range(i, k)) + " from e group by 1)"


_DET3 = "(c00*(c11*c22 - c12*c12) - c01*(c01*c22 - c12*c02) + c02*(c01*c12 - c11*c02))"


@query("tc_dtc_o_s_n3", sql_cov(3) + f""", m as (select *, ln({_DET3}) as ld, ln(c00*c11 - c01*c01) as l01, ln(c00*c22 - c02*c02) as l02, ln(c11*c22 - c12*c12) as l12 from c),
t as (select *, 0.5 * (ln(c00) + ln(c11) + ln(c22) - ld) / ln(2) as tc0, 0.5 * (ld + l01 + l02 + l12 - 3 * ld) / ln(2) as dtc0 from m)
select label, n, round(0.5 * (3 * ln(2*pi()*exp(1)) + ld) / ln(2), 6) + 0.0 as entropy, round(tc0, 6) + 0.0 as tc, round(dtc0, 6) + 0.0 as dtc, round(tc0 - dtc0, 6) + 0.0 as o, round(tc0 + dtc0, 6) + 0.0 as s from t""")
def tc_dtc(spark, d):
    return rounded(static.native_measures(static.covariances(_embedded(spark, d), ["e0", "e1", "e2"], ["label"]), 3).drop("cov"))


@query("gauss_measures_n8")
def gauss_measures(spark, d):
    cols = [f"e{i}" for i in range(8)]
    return rounded(static.gaussian_measures(static.covariances(_embedded(spark, d, 8), cols, ["label"]), 8, ["label"]))


@query("gauss_mi", sql_cov(3) + f" select label, round(0.5 * (ln(c00) + ln(c11*c22 - c12*c12) - ln({_DET3})) / ln(2), 6) + 0.0 as mi from c")
def gauss_mi(spark, d):
    return rounded(static.native_mutual_information(static.covariances(_embedded(spark, d), ["e0", "e1", "e2"], ["label"]), 3, [0], [1, 2]).select("label", "mi"))


@query("gauss_cmi", sql_cov(3) + f" select label, round(0.5 * (ln(c00*c22 - c02*c02) + ln(c11*c22 - c12*c12) - ln(c22) - ln({_DET3})) / ln(2), 6) + 0.0 as mi from c")
def gauss_cmi(spark, d):
    return rounded(static.native_mutual_information(static.covariances(_embedded(spark, d), ["e0", "e1", "e2"], ["label"]), 3, [0], [1], [2]).select("label", "mi"))


@query("pairwise_mi", sql_cov(3) + " select label, i, j, round(-0.5 * ln(1 - rho2) / ln(2), 6) + 0.0 as mi from (select label, 0 as i, 1 as j, c01*c01/(c00*c11) as rho2 from c union all select label, 0, 2, c02*c02/(c00*c22) from c union all select label, 1, 2, c12*c12/(c11*c22) from c)")
def pairwise_mi(spark, d):
    c = static.covariances(_embedded(spark, d), ["e0", "e1", "e2"], ["label"])
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.col("cov")[3 * i + j] * F.col("cov")[3 * i + j] / (F.col("cov")[4 * i] * F.col("cov")[4 * j])).alias("rho2")) for i in range(3) for j in range(i + 1, 3)])).alias("p")
    return c.select("label", pairs).select("label", "p.i", "p.j", r(-0.5 * F.ln(1 - F.col("p.rho2")) / math.log(2)).alias("mi"))


@query("local_mi", """with e as (select vec_id, label, embedding[1]::double as x, embedding[2]::double as y from embeddings),
s as (select label, avg(x) as mx, avg(y) as my, var_samp(x) as vx, var_samp(y) as vy, covar_samp(x, y) as c from e group by 1),
z as (select vec_id, e.label, x - mx as u, y - my as v, vx, vy, c, vx*vy - c*c as det from e join s using (label))
select vec_id, label, round((0.5 * (ln(vx) + ln(vy) - ln(det)) + 0.5 * (u*u/vx + v*v/vy - (vy*u*u - 2*c*u*v + vx*v*v)/det)) / ln(2), 5) + 0.0 as local_mi from z""")
def local_mi(spark, d):
    e = _read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return static.local_mutual_information(e, "x", "y", ["label"]).select("vec_id", "label", r("local_mi", 5).alias("local_mi"))


_H = "(select -sum(c / n * ln(c / n)) / ln(2) from (select count(*)::double as c, sum(count(*)) over () as n from {t} group by {k}))"


@query("disc_entropy", "select " + "(select count(*) from events)::bigint as n, round(" + _H.format(t="events", k="event_type") + ", 6) + 0.0 as entropy")
def disc_entropy(spark, d):
    return rounded(static.discrete_entropy(_read(spark, d, "events"), ["event_type"]))


@query("disc_mi", "select (select count(*) from orders)::bigint as n, round(" + " + ".join(_H.format(t="orders", k=k) for k in ("o_orderstatus", "o_orderpriority")) + " - " + _H.format(t="orders", k="o_orderstatus, o_orderpriority") + ", 6) + 0.0 as mutual_information")
def disc_mi(spark, d):
    return rounded(static.discrete_mutual_information(_read(spark, d, "orders"), ["o_orderstatus"], ["o_orderpriority"]))


@query("disc_tc", "select (select count(*) from lineitem)::bigint as n, round(" + " + ".join(_H.format(t="lineitem", k=k) for k in ("l_returnflag", "l_linestatus", "l_linenumber")) + " - " + _H.format(t="lineitem", k="l_returnflag, l_linestatus, l_linenumber") + ", 6) + 0.0 as total_correlation")
def disc_tc(spark, d):
    return rounded(static.discrete_total_correlation(_read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]))


@query("lz_roles")
def lz_roles(spark, d):
    return static.lempel_ziv(_read(spark, d, "conversations"), "conv_id", "turn", "role")


# Dynamics, memory, causality and rates of the hourly VAR(1).


def model2(spark, d):
    return models.to_innovations(models.fit_var(hourly(spark, d), TYPES2))


def model3(spark, d):
    return models.to_innovations(models.fit_var(hourly(spark, d, TYPES3), TYPES3))


def wide_measures(m: DataFrame, names: list[str], k: int = 6, config: plan.Config = plan.Config()) -> DataFrame:
    """Scalar measures as columns."""
    got = plan.measures(m, names, config)
    return got.groupBy("model_id").agg(*[r(F.max(F.when(F.col("measure") == n, F.col("value"))), k).alias(n) for n in names])


_TOT = BASE + LYAPUNOV


@query("stationary_covariance_n2", _TOT + " select round(p11, 3) + 0.0 as p11, round(p12, 3) + 0.0 as p12, round(p22, 3) + 0.0 as p22 from lyap")
def stationary_covariance(spark, d):
    c = plan.measures(model2(spark, d), ["covariance"])
    pick = lambda i, j: r(F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("value"))), 3)
    return c.agg(pick(0, 0).alias("p11"), pick(0, 1).alias("p12"), pick(1, 1).alias("p22"))


@query("autocovariance_n2", _TOT + " select lag, i, j, round(value, 3) + 0.0 as value from (select 0 as lag, 0 as i, 0 as j, p11 as value from lyap union all select 0, 0, 1, p12 from lyap union all select 0, 1, 0, p12 from lyap union all select 0, 1, 1, p22 from lyap union all select 1, 0, 0, a11*p11 + a12*p12 from lyap, var1 union all select 1, 0, 1, a11*p12 + a12*p22 from lyap, var1 union all select 1, 1, 0, a21*p11 + a22*p12 from lyap, var1 union all select 1, 1, 1, a21*p12 + a22*p22 from lyap, var1)")
def autocovariance(spark, d):
    return plan.measures(model2(spark, d), ["autocovariance"]).select("lag", "i", "j", r("value", 3).alias("value"))


@query("criticality_n2", BASE + ", e as (select *, a11 + a22 as tr, a11*a22 - a12*a21 as dt from var1), rad as (select case when tr*tr/4 - dt >= 0 then greatest(abs(tr/2 + sqrt(greatest(tr*tr/4 - dt, 0))), abs(tr/2 - sqrt(greatest(tr*tr/4 - dt, 0)))) else sqrt(dt) end as rho from e) select 'all' as model_id, round(rho, 6) + 0.0 as spectral_radius, round(1 - rho, 6) + 0.0 as stability_margin, round(-1 / ln(rho), 6) + 0.0 as dominant_timescale from rad")
def criticality(spark, d):
    return wide_measures(model2(spark, d), ["spectral_radius", "stability_margin", "dominant_timescale"])


@query("information_dynamics_n2", _TOT + """ select 'all' as model_id, round(0.5 * (2 * ln(2*pi()*exp(1)) + ln(s11*s22 - s12*s12)) / ln(2), 6) + 0.0 as entropy_rate,
 round(0.5 * (ln(p11*p22 - p12*p12) - ln(s11*s22 - s12*s12)) / ln(2), 6) + 0.0 as predictive_information, round((p11 + p22) / (s11 + s22), 6) + 0.0 as covariance_amplification,
 round((0.5 * (ln(s11) + ln(s22) - ln(s11*s22 - s12*s12)) - 0.5 * (ln(p11) + ln(p22) - ln(p11*p22 - p12*p12))) / ln(2), 6) + 0.0 as cmem3_total from var1, lyap""")
def information_dynamics(spark, d):
    return wide_measures(model2(spark, d), ["entropy_rate", "predictive_information", "covariance_amplification", "cmem3_total"])


@query("ais_n2", _TOT + " select i, round(-0.5 * ln(1 - rho * rho) / ln(2), 6) + 0.0 as value from (select 0 as i, (a11*p11 + a12*p12) / p11 as rho from var1, lyap union all select 1, (a21*p12 + a22*p22) / p22 from var1, lyap)")
def ais(spark, d):
    return plan.measures(model2(spark, d), ["active_information_storage"]).select("i", r("value").alias("value"))


@query("cmem1_n2", _TOT + """, q as (select *, (a11*p11 + a12*p12) / p11 as r1, (a21*p12 + a22*p22) / p22 as r2 from var1, lyap)
 select 'all' as model_id, round((0.5 * (ln(p11*p22 - p12*p12) - ln(s11*s22 - s12*s12)) + 0.5 * ln(1 - r1*r1) + 0.5 * ln(1 - r2*r2)) / ln(2), 6) + 0.0 as cmem1_total from q""")
def cmem1(spark, d):
    return wide_measures(model2(spark, d), ["cmem1_total"])


_SP = BASE + SPECTRUM


@query("csd_n2", _SP + " select round(f, 6) + 0.0 as f, round(f11, 2) + 0.0 as s11, round(f22, 2) + 0.0 as s22 from sp")
def csd(spark, d):
    p = plan.measures(model2(spark, d), ["power"])
    return p.groupBy(r("f").alias("f")).agg(r(F.max(F.when(F.col("i") == 0, F.col("value"))), 2).alias("s11"), r(F.max(F.when(F.col("i") == 1, F.col("value"))), 2).alias("s22"))


@query("spectral_entropy_n2", _SP + ", t as (select sum(f11) as t1, sum(f22) as t2 from sp) select i, round(value, 6) + 0.0 as value from (select 0 as i, -sum(f11/t1 * ln(f11/t1)) / ln(129) as value from sp, t union all select 1, -sum(f22/t2 * ln(f22/t2)) / ln(129) from sp, t)")
def spectral_entropy(spark, d):
    return plan.measures(model2(spark, d), ["spectral_entropy"]).select("i", r("value").alias("value"))


@query("spectral_entropy_rate_n2", _SP + " select round(f, 6) + 0.0 as f, round(0.5 * (2 * ln(2*pi()*exp(1)) + ln(fdet)) / ln(2), 6) + 0.0 as value from sp")
def spectral_entropy_rate(spark, d):
    return plan.measures(model2(spark, d), ["spectral_entropy_rate"]).select(r("f").alias("f"), r("value").alias("value"))


@query("marginal_entropy_rate_n2", _SP + " select i, round(0.5 * ln(2*pi()*exp(1) * v) / ln(2), 6) + 0.0 as value from (select 0 as i, v1 as v from sz union all select 1, v2 from sz)")
def marginal_entropy_rate(spark, d):
    return plan.measures(model2(spark, d), ["marginal_entropy_rate"]).select("i", r("value").alias("value"))


@query("mvgc_pairwise_n2", _SP + " select source, target, round(value, 6) + 0.0 as value from (select 'purchase' as source, 'click' as target, ln(v2 / s22) as value from sz, var1 union all select 'click', 'purchase', ln(v1 / s11) from sz, var1)")
def mvgc_pairwise(spark, d):
    names = F.array(*[F.lit(c) for c in TYPES2])
    m = plan.measures(model2(spark, d), ["pairwise_temporal_mvgc"]).where("i <> j")
    return m.select(F.element_at(names, F.col("i") + 1).alias("source"), F.element_at(names, F.col("j") + 1).alias("target"), r("value").alias("value"))


@query("mvgc_pairwise_n3")
def mvgc_pairwise3(spark, d):
    names = F.array(*[F.lit(c) for c in TYPES3])
    m = plan.measures(model3(spark, d), ["pairwise_temporal_mvgc"]).where("i <> j")
    return m.select(F.element_at(names, F.col("i") + 1).alias("source"), F.element_at(names, F.col("j") + 1).alias("target"), r("value").alias("value"))


@query("rates_n2", _SP + """ select 'all' as model_id, round(0.5 * (ln(v1) + ln(v2) - ln(s11*s22 - s12*s12)), 6) + 0.0 as mutual_information_rate, round(0.5 * ln(v2 / s22), 6) + 0.0 as transfer_entropy_rate,
 round(0.5 * (ln(s11) + ln(s22) - ln(s11*s22 - s12*s12)), 6) + 0.0 as instantaneous_rate, round((ln(v1) + ln(v2) - ln(s11*s22 - s12*s12)) / ln(2), 6) + 0.0 as stochastic_interaction from sz, var1""")
def rates(spark, d):
    return wide_measures(model2(spark, d), ["mutual_information_rate", "transfer_entropy_rate", "instantaneous_rate", "stochastic_interaction"])


@query("mir_spectral_n2", _SP + " select round(f, 6) + 0.0 as f, round(0.5 * (ln(f11) + ln(f22) - ln(fdet)), 6) + 0.0 as value from sp")
def mir_spectral(spark, d):
    return plan.measures(model2(spark, d), ["spectral_mutual_information_rate"]).select(r("f").alias("f"), r("value").alias("value"))


@query("te_spectral_n2", _SP + " select round(f, 6) + 0.0 as f, round(0.5 * (ln(f22) - ln((b11r*b11r + b11i*b11i) / dd * s22)), 6) + 0.0 as value from sp")
def te_spectral(spark, d):
    return plan.measures(model2(spark, d), ["spectral_transfer_entropy_rate"]).select(r("f").alias("f"), r("value").alias("value"))


@query("mvgc_spectral_n2", _SP + " select round(f, 6) + 0.0 as f, round(ln(f22 / (f22 - (s11 - s12*s12/s22) * (b21r*b21r + b21i*b21i) / dd)), 6) + 0.0 as value from sp")
def mvgc_spectral(spark, d):
    return plan.measures(model2(spark, d), ["spectral_mvgc"]).select(r("f").alias("f"), r("value").alias("value"))


@query("dynamical_dependence_n2", BASE + """, grid as (select i, i / 256.0::double as f, case when i in (0, 128) then 0.5::double else 1.0::double end / 128 as w from range(129) t(i)),
h as (select w, v.*, cos(2*pi()*f) as cc, sin(2*pi()*f) as ss from grid, var1 v),
b as (select *, 1 - a11*cc as b11r, a11*ss as b11i, -a12*cc as b12r, a12*ss as b12i, -a21*cc as b21r, a21*ss as b21i, 1 - a22*cc as b22r, a22*ss as b22i from h),
m as (select *, (b22r - b21r) as u1r, (b22i - b21i) as u1i, (b11r - b12r) as u2r, (b11i - b12i) as u2i, power(b11r*b22r - b11i*b22i - b12r*b21r + b12i*b21i, 2) + power(b11r*b22i + b11i*b22r - b12r*b21i - b12i*b21r, 2) as dd from b)
select 'all' as model_id, round((sum(w * ln((s11*(u1r*u1r + u1i*u1i) + s22*(u2r*u2r + u2i*u2i) + 2*s12*(u1r*u2r + u1i*u2i)) / dd)) - ln(max(s11 + 2*s12 + s22))) / ln(2), 6) + 0.0 as dynamical_dependence from m""")
def dynamical_dependence(spark, d):
    return wide_measures(model2(spark, d), ["dynamical_dependence"], config=plan.Config(macro=((1.0, 1.0),)))


@query("all_measures_n3")
def all_measures(spark, d):
    c = plan.Config(macro=((1.0, 1.0, 1.0),), max_lag=2, memory_lag=3, target=(2,), points=65, redundancy=("mmi", "ccs", "idep_a", "idep_b"), qmc=512)
    return rounded(plan.measures(model3(spark, d), "all", c))


for _name, _family in (("oir_n3", "oir"), ("pird_n3", "pird"), ("pdgc_n3", "pdgc"), ("hop_n3", "hop"), ("cmem_n3", "cmem")):
    Q[_name] = lambda spark, d, family=_family: rounded(plan.measures(model3(spark, d), family, plan.Config(target=(2,), points=65, memory_lag=3)))


@query("phiid_n2")
def phiid(spark, d):
    return rounded(plan.measures(model2(spark, d), ["phi_id"], plan.Config(redundancy=("mmi", "ccs", "idep_a", "idep_b"), qmc=512)), 8)


@query("pid_var_n2")
def pid_var(spark, d):
    from ..functions import decomposition as P

    def run(pdf):
        import pandas as pd

        coef, sigma = models.read_var(pdf)
        parts = [(k, P.pid_of_var(coef, sigma, [0], [1], k)) for k in ("mmi", "ccs", "dep")]
        return pd.DataFrame([(m, k, a, float(v)) for k, x in parts for m, row in zip(pdf["model_id"], x) for a, v in zip(P.PID_ATOMS, row)], columns=["model_id", "redundancy", "atom", "value"])

    return rounded(models.kernel(models.fit_var(hourly(spark, d), TYPES2), "model_id string, redundancy string, atom string, value double", run))


@query("emergence_n3")
def emergence(spark, d):
    return rounded(static.lagged_emergence(hourly(spark, d, TYPES3), TYPES3, [[1 / math.sqrt(3)] * 3]))


# Checks and selection.


@query("durbin_watson", _RES + ", e as (select t, purchase - p1 as e, lag(purchase - p1) over (order by t) as l from res) select 'all' as series_id, round(sum((e - l) * (e - l)) / (select sum(e * e) from e), 6) + 0.0 as dw from e where l is not null")
def durbin_watson(spark, d):
    return rounded(checks.durbin_watson(_predicted(spark, d).select("series_id", "t", F.col("residual")[0].alias("e")), "e"))


@query("ljung_box", _RES + """, e as (select t, purchase - p1 as e from res), m as (select avg(e) as m, var_pop(e) as v, count(*) as n from e),
l as (select t, e, lag(e, 1) over w as l1, lag(e, 2) over w as l2 from e window w as (order by t)), rr as (select sum((e - m) * (l1 - m)) / max(n) / max(v) as r1, sum((e - m) * (l2 - m)) / max(n) / max(v) as r2, max(n) as n from l, m)
select 'all' as series_id, n, round(n * (n + 2) * (r1*r1 / (n - 1) + r2*r2 / (n - 2)), 6) + 0.0 as q from rr""")
def ljung_box(spark, d):
    return rounded(checks.ljung_box(_predicted(spark, d).select("series_id", "t", F.col("residual")[0].alias("e")), "e", 2).drop("pvalue"))


@query("fit_diagnostics", _RES + " select 'all' as series_id, channel, round(sqrt(mse), 4) + 0.0 as rmse, round(mse / v, 6) + 0.0 as nmse, round(1 - mse / v, 6) + 0.0 as r2 from (select 0 as channel, avg((purchase - p1) * (purchase - p1)) as mse, var_pop(purchase) as v from res union all select 1, avg((click - p2) * (click - p2)), var_pop(click) from res)")
def fit_diagnostics(spark, d):
    f = checks.fit_summary(_predicted(spark, d), 2)
    return f.select("series_id", "channel", r("rmse", 4).alias("rmse"), r("nmse").alias("nmse"), r("r2").alias("r2"))


@query("consistency", _RES + """, m as (select covar_samp(purchase, purchase) as r11, covar_samp(purchase, click) as r12, covar_samp(click, click) as r22, covar_samp(p1, p1) as q11, covar_samp(p1, p2) as q12, covar_samp(p2, p2) as q22 from res)
select 'all' as series_id, round(1 - sqrt((q11-r11)*(q11-r11) + 2*(q12-r12)*(q12-r12) + (q22-r22)*(q22-r22)) / sqrt(r11*r11 + 2*r12*r12 + r22*r22), 6) + 0.0 as consistency from m""")
def consistency(spark, d):
    return rounded(checks.prediction_consistency(_predicted(spark, d), 2))


@query("bh_fdr", """with p as (select p_partkey as id, (p_partkey * 7919 % 10007) / 10007.0::double * (case when p_partkey % 5 = 0 then 0.001::double else 1.0::double end) as p from part),
k as (select *, count(*) over (order by p) as rnk, count(*) over () as m from p), lim as (select max(p) as lim from k where p <= 0.05::double * rnk / m)
select id, round(p, 9) + 0.0 as p, coalesce(p <= (select lim from lim), false) as significant from p""")
def bh_fdr(spark, d):
    p = _read(spark, d, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 7919 % 10007) / F.lit(10007.0) * F.when(F.col("p_partkey") % 5 == 0, 0.001).otherwise(1.0)).alias("p"))
    return checks.significance(p).select("id", r("p", 9).alias("p"), "significant")


@query("mid_quantile", "select o_orderpriority, round(avg((o_totalprice < 100000)::int::double) + 0.5 * avg((abs(o_totalprice - 100000) <= 1e-8)::int::double), 6) + 0.0 as quantile from (select * from orders where true) where abs(o_totalprice - 100000) > 1e-8 or true group by 1")
def mid_quantile(spark, d):
    return rounded(ensembles.mid_quantiles(_read(spark, d, "orders").withColumn("ref", F.lit(100000.0)), "o_totalprice", "ref", ["o_orderpriority"]))


@query("ci_percentile", "select l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 4) + 0.0 as low, round(quantile_cont(l_extendedprice, 0.975), 4) + 0.0 as high from lineitem group by 1")
def ci_percentile(spark, d):
    s = _read(spark, d, "lineitem").select(F.lit("f").alias("family"), F.col("l_returnflag").alias("measure"), *[F.lit(None).cast("int").alias(c) for c in ("i", "j", "lag")], F.lit(None).cast("double").alias("f"), F.lit(None).cast("string").alias("atom"), F.col("l_extendedprice").alias("value"))
    return ensembles.intervals(s).select(F.col("measure").alias("l_returnflag"), r("low", 4).alias("low"), r("high", 4).alias("high"))


@query("var_ic_select")
def var_ic(spark, d):
    return rounded(checks.var_criteria(hourly(spark, d), TYPES2, [1, 2, 3, 4]), 4)


@query("var_ic_order1", BASE + ", s as (select rws, -0.5 * (2 * ln(2*pi()) + ln(s11*s22 - s12*s12) + 2) * rws as l from var1) select 1 as \"order\", 4::bigint as k, rws as n, round(l, 3) + 0.0 as loglik, round(-2*l + 8, 3) + 0.0 as aic, round(-2*l + 4*ln(rws), 3) + 0.0 as bic, round(-2*l + 8*ln(ln(rws)), 3) + 0.0 as hqc from s")
def var_ic1(spark, d):
    return checks.var_criteria(hourly(spark, d), TYPES2, [1]).select("order", "k", "n", *[r(c, 3).alias(c) for c in ("loglik", "aic", "bic", "hqc")])


@query("cv_folds", "select i as fold, (600 - (3 - i) * 60 - 5)::bigint as train_end, (600 - (3 - i) * 60)::bigint as test_start, (600 - (2 - i) * 60)::bigint as test_end from range(3) t(i)")
def cv_folds(spark, d):
    return checks.folds(600, spark, k=3, test=60, gap=5).select(F.col("fold").cast("long").alias("fold"), "train_end", "test_start", "test_end")


@query("var_cv")
def var_cv(spark, d):
    w = hourly(spark, d)
    return rounded(checks.var_cross_validation(w, TYPES2, [1, 2, 3], folds_of(w)), 4)


@query("mvgc_pvalues")
def mvgc_pvalues(spark, d):
    m = plan.measures(model2(spark, d), ["pairwise_temporal_mvgc"]).where("i <> j").select("i", "j", "value")
    return rounded(checks.significance(checks.mvgc_pvalues(m, (1, 1, 0), 1, steps(hourly(spark, d)) - 1)), 8)


# State space.


_LEVEL = "with " + sql_grid("hour", TYPES2) + """, x as (select t, purchase / 1000 as y, row_number() over (order by t) as k from g),
f as (with recursive it(k, m, p) as (select 0::bigint, 0.0::double, 1.0::double union all
  select it.k + 1, 0.9*m + (0.81*p + 0.1) / (0.81*p + 1.1) * (y - 0.9*m), (0.81*p + 0.1) / (0.81*p + 1.1) from it join x on x.k = it.k + 1) select * from it where k > 0)"""


@query("kalman_level", _LEVEL + " select t, round(m, 6) + 0.0 as mean from f join x using (k)")
def kalman_level(spark, d):
    w = hourly(spark, d).withColumn("y", F.col("purchase") / 1000)
    return statespace.kalman_filter(S.to_dense(w, ["y"]), [[0.9]], [[1.0]], [[0.1]], [[1.0]]).select("t", r(F.col("mean")[0]).alias("mean"))


@query("rts_level", _LEVEL + """, last_k as (select max(k) as n from f), b as (with recursive bt(k, m, p) as (select k, m, p from f, last_k where k = n union all
  select f.k, f.m + 0.9*f.p / (0.81*f.p + 0.1) * (bt.m - 0.9*f.m), f.p + power(0.9*f.p / (0.81*f.p + 0.1), 2) * (bt.p - (0.81*f.p + 0.1)) from bt join f on f.k = bt.k - 1) select * from bt)
select t, round(m, 6) + 0.0 as mean, round(p, 6) + 0.0 as cov from b join x using (k)""")
def rts_level(spark, d):
    w = hourly(spark, d).withColumn("y", F.col("purchase") / 1000)
    return statespace.kalman_smoother(S.to_dense(w, ["y"]), [[0.9]], [[1.0]], [[0.1]], [[1.0]]).select("t", r(F.col("mean")[0]).alias("mean"), r(F.col("cov")[0]).alias("cov"))


@query("em_level")
def em_level(spark, d):
    w = hourly(spark, d).withColumn("y", F.col("purchase") / 1000)
    (a, c, q, v, p), ll = statespace.expectation_maximisation(S.to_dense(w, ["y"]), ([[0.5]], [[1.0]], [[0.5]], [[1.0]]), 3)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(ll)], "iteration int, loglik double")


@query("larimore_n2")
def larimore(spark, d):
    return rounded(wide_measures(statespace.larimore(hourly(spark, d), TYPES2, 2, 3), ["entropy_rate", "predictive_information", "mutual_information_rate"]))


@query("n4sid_n2")
def n4sid(spark, d):
    m = models.state_space_to_innovations(statespace.n4sid(S.to_dense(hourly(spark, d), TYPES2), 2, 2, 3))
    return rounded(wide_measures(m, ["entropy_rate", "predictive_information"]))


@query("bauer_order")
def bauer(spark, d):
    return rounded(statespace.bauer_order(hourly(spark, d), TYPES2, 3))


@query("innovations_n2", "with " + sql_grid("hour", TYPES2) + " select t, round(purchase - 0.1 * coalesce(lag(purchase) over (order by t), 0), 6) + 0.0 as e1, round(click - 0.1 * coalesce(lag(click) over (order by t), 0), 6) + 0.0 as e2 from g")
def innovations(spark, d):
    coef = np.array([[[[0.1, 0.0], [0.0, 0.1]]]])
    got = statespace.innovations(S.to_dense(hourly(spark, d), TYPES2), M.var_to_innovations(coef, np.eye(2)[None]))
    return got.select("t", r(F.col("innovation")[0]).alias("e1"), r(F.col("innovation")[1]).alias("e2"))


# Transformations and ensembles.


@query("downsample_n2")
def downsample(spark, d):
    return wide_measures(models.downsample(model2(spark, d), 3), ["entropy_rate", "predictive_information"])


@query("scale_grid_n2")
def scale_grid(spark, d):
    return wide_measures(models.scale_grid(model2(spark, d), [0.0, 0.5, 1.0, 2.0]), ["spectral_radius", "predictive_information"])


@query("project_n3")
def project(spark, d):
    return wide_measures(models.project(model3(spark, d), [[1.0, 1.0, 0.0], [0.0, 0.0, 1.0]]), ["entropy_rate", "mutual_information_rate"])


@query("synthetic_catalogue")
def synthetic(spark, d):
    return rounded(wide_measures(models.to_innovations(ensembles.synthetic_catalogue(ship(spark))), ["spectral_radius", "predictive_information", "o_information_rate"]))


@query("simulate_var")
def simulate(spark, d):
    x = ensembles.simulate(ensembles.synthetic_catalogue(ship(spark), 3, (0.5,), (0.0,)), 50, seed=1)
    return x.select("series_id", "t", r(F.col("x")[0]).alias("x0"))


@query("bootstrap_ci_n2")
def bootstrap_ci(spark, d):
    dense = S.to_dense(hourly(spark, d), TYPES2)
    return rounded(ensembles.intervals(ensembles.bootstrap(dense, 2, 1, ["mutual_information_rate", "pairwise_temporal_mvgc"], members=64, seed=3)))


@query("bootstrap_state_space_n2")
def bootstrap_state_space(spark, d):
    dense = S.to_dense(hourly(spark, d), TYPES2)
    return rounded(ensembles.intervals(ensembles.bootstrap_state_space(dense, 2, 1, 3, ["entropy_rate", "mutual_information_rate"], members=16, seed=3)))


@query("var_cv_nll")
def var_cv_nll(spark, d):
    w = hourly(spark, d)
    return rounded(checks.var_cross_validation(w, TYPES2, [1, 2], folds_of(w), "one_se", "nll"), 4)


@query("numit_n2")
def numit(spark, d):
    fit = models.fit_var(hourly(spark, d), TYPES2).select("coef", "sigma").first()  # one model
    return rounded(ensembles.numit(spark, np.reshape(fit.coef, (1, 2, 2)), np.reshape(fit.sigma, (2, 2)), [0], [1], members=32, seed=2))


@query("dependence_search_n5")
def dependence_search(spark, d):
    mask = np.eye(5) + np.eye(5, k=-1)
    got = ensembles.dependence_search(ship(spark), systems.masked_model(mask), 2, runs=8, seed=1, points=65, max_iter=300)
    return got.select("run", "size", r("objective", 4).alias("objective"))


@query("candidate_search")
def candidates(spark, d):
    return rounded(ensembles.candidate_search(ship(spark), systems.masked_model(np.eye(4) + np.eye(4, k=-1)), 2, candidates=32).select("run", "value"))


# Straight from observations.


@query("coefficient_table", BASE + " select 'all' as model_id, 1 as lag, target, source, round(value, 6) + 0.0 as value from (select 0 as target, 0 as source, a11 as value from var1 union all select 0, 1, a12 from var1 union all select 1, 0, a21 from var1 union all select 1, 1, a22 from var1)")
def coefficient_table(spark, d):
    return rounded(empirical.coefficient_table(models.fit_var(hourly(spark, d), TYPES2)))


@query("mvgc_empirical", BASE + """, one as (select 'all' as model_id, count(*) as n, covar_samp(click, click) * (count(*) - 1) as syy, covar_samp(click, click_l1) * (count(*) - 1) as syz, covar_samp(click_l1, click_l1) * (count(*) - 1) as szz from lagged)
select model_id, round(ln((syy - syz * syz / szz) / (n - 2) / s22), 6) + 0.0 as value from one join var1 using (model_id)""")
def mvgc_empirical(spark, d):
    return rounded(empirical.empirical_mvgc(hourly(spark, d), 1, ["purchase"], ["click"]))


@query("mvgc_empirical_spectral")
def mvgc_empirical_spectral(spark, d):
    return rounded(empirical.empirical_spectral_mvgc(hourly(spark, d, TYPES3), 2, ["purchase"], ["click"], np.linspace(0, 0.5, 33), ["view"]))


@query("var_lwr_n2")
def var_lwr(spark, d):
    return rounded(empirical.coefficient_table(empirical.fit_lwr(hourly(spark, d), TYPES2, 2)))


@query("whiteness")
def whiteness(spark, d):
    return rounded(empirical.whiteness(hourly(spark, d), TYPES2, 1))


@query("innovation_diagnostics")
def innovation_diagnostics(spark, d):
    return rounded(empirical.innovation_diagnostics(_predicted(spark, d), 2, 5), 4)


@query("larimore_cv")
def larimore_cv(spark, d):
    w = hourly(spark, d)
    return rounded(statespace.cross_validation(w, TYPES2, [1, 2, 3], 3, folds_of(w)), 4)


@query("var_cv_recursive")
def var_cv_recursive(spark, d):
    w = hourly(spark, d)
    f = checks.folds(steps(w), w.sparkSession, k=3, test=60, gap=12)
    return rounded(checks.var_cross_validation(w, TYPES2, [1, 2, 3], f, evaluation="recursive", gap="embargo"), 4)


@query("n4sid_cv")
def n4sid_cv(spark, d):
    w = hourly(spark, d)
    return rounded(statespace.cross_validation(w, TYPES2, [1, 2, 3], 3, folds_of(w), "one_se", "n4sid"), 4)


@query("states_out_of_sample")
def states_out_of_sample(spark, d):
    w = hourly(spark, d)
    return rounded(statespace.out_of_sample(w, TYPES2, 2, 3, folds_of(w)), 4)


@query("system_parameters")
def system_parameters(spark, d):
    return ensembles.system_parameters(ship(spark))


@query("search_paths")
def search_paths(spark, d):
    model = systems.masked_model(systems.network("tnet5"), seed=1)
    return rounded(ensembles.search_paths(ship(spark), model, 2, "spectral", runs=4, seed=1, points=65, max_iter=100, optimizer="armijo"), 4)


@query("macro_sweep")
def macro_sweep(spark, d):
    return empirical.macro_sweep(ship(spark), systems.masked_model(np.eye(4) + np.eye(4, k=-1)), runs=2, points=65, max_iter=150).select("m", "run", r("objective", 4).alias("objective"))


@query("frame_distances")
def frame_distances(spark, d):
    got = ensembles.dependence_search(ship(spark), systems.masked_model(np.eye(4) + np.eye(4, k=-1)), 2, runs=4, seed=1, points=65, max_iter=150)
    return rounded(empirical.frame_distances(got, 2, 4), 4)


def entry(spark: SparkSession, d: str = "/root/testdata/sf0.001") -> DataFrame:
    """Which event type Granger-causes which, in hourly sums of all five types."""
    types = ("purchase", "click", "view", "signup", "error")
    m = models.to_innovations(models.fit_var(hourly(spark, d, types), types))
    names = F.array(*[F.lit(c) for c in types])
    got = plan.measures(m, ["pairwise_temporal_mvgc"]).where("i <> j")
    return got.select(F.element_at(names, F.col("i") + 1).alias("source"), F.element_at(names, F.col("j") + 1).alias("target"), r("value").alias("value"))


from . import identities, sql  # noqa: E402  They need the queries above.

sql.attach(SQL, BASE, LYAPUNOV, SPECTRUM, _RES)
identities.register(query)
