"""Queries of identities between measures: what must be equal, as differences, whose SQL is a table of zeros.

They take measures that SQL cannot express through relations that their
definitions imply, on models of the tables.  Every row is (identity, value).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import sources as S
from ..functions import systems
from ..operators import checks, empirical, ensembles, lags, models, statespace
from ..session import ship
from . import measures as plan
from . import queries as Qs

POINTS = 65
KINDS = ("mmi", "ccs", "idep_a", "idep_b")


def take(measure: str, *where: str) -> Column:
    """Sum of a measure's values on some rows."""
    cond = F.col("measure") == measure
    for w in where:
        cond = cond & F.expr(w)
    return F.sum(F.when(cond, F.col("value")))


def mean(measure: str, *where: str) -> Column:
    """Trapezoid mean over the frequencies of a measure's values."""
    cond = F.col("measure") == measure
    for w in where:
        cond = cond & F.expr(w)
    weight = F.when((F.col("f") == 0) | (F.col("f") == 0.5), 0.5).otherwise(1.0) / (POINTS - 1)
    return F.sum(F.when(cond, weight * F.col("value")))


def differences(got: DataFrame, **pairs: Column) -> DataFrame:
    """(identity, value) of aggregates over one table, rounded; a missing value shows as null."""
    own = got.agg(*[(F.round(e, 6) + 0.0).alias(k) for k, e in pairs.items()])
    return own.unpivot([], list(pairs), "identity", "value")


def config(**options) -> plan.Config:
    return plan.Config(points=POINTS, **options)


def both(m: DataFrame, names, first: plan.Config, second: plan.Config) -> DataFrame:
    """Measures under two configurations, those of the second with a prime."""
    return plan.measures(m, names, first).unionByName(plan.measures(m, names, second).withColumn("measure", F.concat("measure", F.lit("'"))))


def rates(spark, d):
    names = ["mutual_information_rate", "transfer_entropy_rate", "instantaneous_rate", "spectral_mutual_information_rate", "spectral_transfer_entropy_rate", "pairwise_mutual_information_rate", "mean_pairwise_rate", "te_conditional", "pairwise_temporal_mvgc", "marginal_entropy_rate", "marginal_entropy_rate_spectral"]
    got = both(Qs.model3(spark, d), names, config(source=(0,), target=(1,)), config(source=(1,), target=(0,)))
    return differences(
        got,
        both_ways=take("mutual_information_rate") - take("transfer_entropy_rate") - take("transfer_entropy_rate'") - take("instantaneous_rate"),
        symmetric=take("mutual_information_rate") - take("mutual_information_rate'"),
        spectral_mir=mean("spectral_mutual_information_rate") - take("mutual_information_rate"),
        spectral_te=mean("spectral_transfer_entropy_rate") - take("transfer_entropy_rate"),
        pairwise=take("pairwise_mutual_information_rate", "i = 0", "j = 1") - take("mutual_information_rate"),
        mean_pairwise=take("mean_pairwise_rate") - take("pairwise_mutual_information_rate", "i < j") / 3,
        half_causality=2 * take("te_conditional", "i <> j") - take("pairwise_temporal_mvgc", "i <> j"),
        entropy_rates=take("marginal_entropy_rate") - take("marginal_entropy_rate_spectral"),
    )


def mvgc(spark, d):
    names = ["temporal_mvgc", "spectral_mvgc", "integrated_spectral_mvgc", "pairwise_temporal_mvgc", "maximum_temporal_mvgc", "pairwise_spectral_gc"]
    got = both(Qs.model3(spark, d), names, config(source=(0,), target=(2,)), config(source=(0,), target=(2,), conditional=()))
    most = F.max(F.when((F.col("measure") == "pairwise_temporal_mvgc") & F.expr("i <> j"), F.col("value")))
    return differences(
        got,
        spectral=mean("spectral_mvgc") - take("temporal_mvgc"), integrated=take("integrated_spectral_mvgc") - take("temporal_mvgc"), unconditional=take("integrated_spectral_mvgc'") - take("temporal_mvgc'"),
        pairwise=take("pairwise_temporal_mvgc", "i = 0", "j = 2") - take("temporal_mvgc"), greatest=take("maximum_temporal_mvgc") - most,
        bivariate=mean("pairwise_spectral_gc", "i = 0", "j = 2") - take("temporal_mvgc'"),
    )


def oir(spark, d):
    m = Qs.model3(spark, d)
    names = ["o_information_rate", "spectral_o_information_rate", "delta_o_information_rate", "spectral_delta_o_information_rate"]
    got = both(m, names, config(group=1), config(group=2))
    return differences(
        got, spectral=mean("spectral_o_information_rate") - take("o_information_rate"), change=take("delta_o_information_rate") - take("o_information_rate"), change_of_another=take("delta_o_information_rate'") - take("o_information_rate"),
        spectral_change=mean("spectral_delta_o_information_rate'") - take("delta_o_information_rate'"),
    )


def rate_decompositions(spark, d):
    names = ["pird", "spectral_pird", "pdgc", "spectral_pdgc", "pird_parts", "pdgc_parts", "spectral_pird_parts", "spectral_pdgc_parts", "mutual_information_rate", "temporal_mvgc"]
    got = plan.measures(Qs.model3(spark, d), names, config(source=(0, 1), target=(2,), conditional=()))
    out = {}
    for kind, total in (("pird", "mutual_information_rate"), ("pdgc", "temporal_mvgc")):
        part = lambda a, k=kind: take(f"{k}_parts", f"atom = '{a}'")
        out |= {
            f"{kind}_atoms": take(kind) - take(total), f"{kind}_integral": mean(f"spectral_{kind}") - take(kind), f"{kind}_parts": part("Rd") + part("Sy") + part("U0") + part("U1") - take(kind),
            f"{kind}_delta": part("delta") - part("Rd") + part("Sy"), f"{kind}_spectral_parts": mean(f"spectral_{kind}_parts", "atom = 'delta'") - part("delta"), f"{kind}_unique": part("U0") - take(kind, "atom = '{0}'"),
        }
    return differences(got, **out)


def memory(spark, d):
    got = plan.measures(Qs.model3(spark, d), ["cmem", "predictive_information", "active_information_storage", "total_correlation"], config(memory_lag=12, ais_lag=1))
    return differences(
        got, all_lags=take("cmem3_decomposition") - take("cmem3_total"), first_lag=take("cmem3_decomposition", "lag = 1") - take("cmem3_curve", "lag = 1"),
        own_past=take("cmem1_total") - take("predictive_information") + take("active_information_storage"), first_pair=take("cmem1_curve", "lag = 1") - take("cmem1_total"),
    )


def phi(spark, d):
    got = plan.measures(Qs.model2(spark, d), ["phi_id", "active_information_storage"], config(redundancy=KINDS, qmc=512))
    kind = lambda k, *w: take("phi_id", f"atom like '{k}.%'", *w)
    single = "atom rlike '(red|unq0)_to_(red|unq0)$'"
    out = {f"total_{k}": kind(k) - kind("mmi") for k in KINDS[1:]}
    out |= {f"storage_{k}": kind(k, single) - take("active_information_storage", "i = 0") for k in KINDS}
    return differences(got, **out)


def pid(spark, d):
    got = Qs.pid_var(spark, d)
    at = lambda k, *atoms: F.sum(F.when((F.col("redundancy") == k) & F.col("atom").isin(*atoms), F.col("value")))
    out = {}
    for k in ("ccs", "dep"):
        out |= {f"total_{k}": at(k, "redundant", "unique0", "unique1", "synergistic") - at("mmi", "redundant", "unique0", "unique1", "synergistic"), f"first_{k}": at(k, "redundant", "unique0") - at("mmi", "redundant", "unique0")}
    rounded = differences(got, **out)
    return rounded.withColumn("value", F.round("value", 4) + 0.0)


def emergence(spark, d):
    got = plan.measures(Qs.model3(spark, d), ["emergence", "emergence_full_past", "predictive_information"], config(macro=((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))))
    out = {}
    for k in ("emergence", "emergence_full_past"):
        at = lambda a, k=k: take(k, f"atom = '{a}'")
        out[f"{k}_psi"] = at("psi") - at("macro") + at("micro_to_macro")
    return differences(got, **out, full_past=take("emergence_full_past", "atom = 'macro'") - take("predictive_information"), first_order=take("emergence", "atom = 'macro'") - take("emergence_full_past", "atom = 'macro'"))


def transformations(spark, d):
    m = Qs.model3(spark, d)
    names = ["autocovariance", "entropy_rate", "predictive_information", "covariance", "spectral_radius"]
    c = plan.Config(max_lag=3)
    tagged = lambda t, df: plan.measures(df, names, c).withColumn("measure", F.concat("measure", F.lit(t)))
    var = models.fit_var(Qs.hourly(spark, d, Qs.TYPES3), Qs.TYPES3)
    parts = [plan.measures(m, names, c), tagged("|reduced", models.reduce(m, [2])), tagged("|rows", models.project(m, np.eye(3).tolist())), tagged("|third", models.downsample(m, 3)), tagged("|still", models.scale_grid(m, [0.0])), tagged("|same", models.scale_grid(m, [1.0])), tagged("|general", models.state_space_to_innovations(models.to_state_space(var)))]
    got = parts[0]
    for p in parts[1:]:
        got = got.unionByName(p)
    return differences(
        got, marginal=(take("covariance|reduced") - take("covariance", "i = 2", "j = 2")) / 1e4, rows=take("entropy_rate|rows") - take("entropy_rate"), third=(take("autocovariance|third", "lag = 1", "i = 0", "j = 1") - take("autocovariance", "lag = 3", "i = 0", "j = 1")) / 1e4,
        still=take("spectral_radius|still"), same=take("predictive_information|same") - take("predictive_information"), general=take("entropy_rate|general") - take("entropy_rate"), same_variance=(take("covariance|third", "i = j") - take("covariance", "i = j")) / 1e4,
    )


def moving_averages(spark, d):
    rows = [("ma", 1, 0, 1, [], [0.5], [2.0], "ok"), ("ar", 2, 1, 0, [0.5, 0.1, 0.0, 0.4], [], [1.0, 0.2, 0.2, 1.0], "ok"), ("arma", 1, 1, 1, [0.5], [0.3], [1.0], "ok")]
    table = ship(spark).createDataFrame(rows, "model_id string, n int, p int, q int, ar array<double>, ma array<double>, sigma array<double>, status string")
    got = plan.measures(models.varma_to_innovations(table), ["covariance", "autocovariance"], plan.Config(max_lag=2))
    at = lambda i, *w: F.sum(F.when((F.col("model_id") == i) & F.expr(" and ".join(w)), F.col("value")))
    # Variance of an ARMA(1, 1): (1 + 2 a b + b^2) / (1 - a^2), and its covariance at lag 2 is a times that at lag 1.
    return differences(
        got, ma_variance=at("ma", "measure = 'covariance'") - 2.5, ma_first=at("ma", "measure = 'autocovariance'", "lag = 1") - 1.0, ma_second=at("ma", "measure = 'autocovariance'", "lag = 2"),
        ar_row=at("ar", "measure = 'autocovariance'", "lag = 1", "i = 1", "j = 1") - 0.4 * at("ar", "measure = 'covariance'", "i = 1", "j = 1"),
        arma_variance=at("arma", "measure = 'covariance'") - (1 + 0.3 + 0.09) / 0.75, arma_second=at("arma", "measure = 'autocovariance'", "lag = 2") - 0.5 * at("arma", "measure = 'autocovariance'", "lag = 1"),
    )


def estimators(spark, d):
    """Orthogonality of least squares, growth of the likelihood, stable estimates, consistent selections: counts of violations."""
    w = Qs.hourly(spark, d)
    fit = models.predictions(w, models.fit_var(w, Qs.TYPES2, 2), Qs.TYPES2, 2)
    lagged = lags.lagged(w, Qs.TYPES2, 2).join(fit.select("series_id", "t", "residual"), ["series_id", "t"])
    normal = [F.sum(F.col("residual")[i] * F.col(c)) / F.sum(F.abs(F.col("residual")[i] * F.col(c))) for i in (0, 1) for c in lags.design_columns(Qs.TYPES2, 2)[2:]]
    worst = lagged.agg(F.greatest(*[F.abs(e) for e in normal]).alias("v")).select(F.lit("normal_equations").alias("identity"), (F.round("v", 6) + 0.0).alias("value"))
    y = w.withColumn("y", F.col("purchase") / 1000)
    _, seen = statespace.expectation_maximisation(S.to_dense(y, ["y"]), ([[0.5]], [[1.0]], [[0.5]], [[1.0]]), 3)
    falls = sum(b < a - 1e-6 for a, b in zip(seen, seen[1:]))
    lwr = empirical.fit_lwr(w, Qs.TYPES2, 1).select((F.col("radius") >= 1).cast("int").alias("v"))
    found = models.state_space_to_innovations(statespace.n4sid(S.to_dense(w, Qs.TYPES2), 2, 1, 3)).unionByName(statespace.larimore(w, Qs.TYPES2, 1, 3))
    wild = plan.measures(found, ["spectral_radius"]).agg(F.count_if(F.expr("value >= 1 or value is null")).alias("v"))
    scores = checks.var_criteria(w, Qs.TYPES2, [1, 2], small_sample=True).join(checks.var_criteria(w, Qs.TYPES2, [1, 2]).select("order", F.col("aic").alias("plain")), "order")
    small = scores.agg(F.sum(F.col("aic") - F.col("plain") - 2 * F.col("k") * (F.col("k") + 1) / (F.col("n") - F.col("k") - 1)).alias("v"))
    row = lambda name, df: df.select(F.lit(name).alias("identity"), (F.round(F.col("v").cast("double"), 6) + 0.0).alias("value"))
    chosen = checks.var_cross_validation(w, Qs.TYPES2, [1, 2], Qs.folds_of(w), "one_se", "nll").where("chosen").agg((F.countDistinct("order") - 1).alias("v"))
    state = statespace.cross_validation(w, Qs.TYPES2, [1, 2], 3, Qs.folds_of(w)).where("chosen").agg((F.countDistinct("states") - 1).alias("v"))
    order = statespace.bauer_order(w, Qs.TYPES2, 3).agg((F.count_if("chosen") - 1).alias("v"))
    out = worst
    for name, df in (("likelihood_falls", spark.createDataFrame([(float(falls),)], "v double")), ("unstable_lattice", lwr), ("unstable_states", wild), ("small_sample", small), ("one_order", chosen), ("one_state_order", state), ("one_rank", order)):
        out = out.unionByName(row(name, df))
    return out


def out_of_sample(spark, d):
    """The mean square over channels of each fold's test errors is the square of its cross-validation score."""
    w = Qs.hourly(spark, d)
    own = checks.out_of_sample(w, Qs.TYPES2, 1, Qs.folds_of(w)).groupBy("fold").agg(F.sqrt(F.avg(F.col("rmse") * F.col("rmse"))).alias("own"), F.max(F.abs(1 - F.col("nmse") - F.col("r2"))).alias("r2"))
    score = checks.var_cross_validation(w, Qs.TYPES2, [1], Qs.folds_of(w)).select("fold", "rmse")
    got = own.join(score, "fold").agg((F.round(F.max(F.abs(F.col("own") - F.col("rmse"))), 6) + 0.0).alias("score"), (F.round(F.max("r2"), 6) + 0.0).alias("shares"), (F.count("*") - 3.0).alias("folds"))
    return got.unpivot([], ["score", "shares", "folds"], "identity", "value")


def selection(spark, d):
    """Held-out predictions by other ways: forecasts from the end of training, native projections, a fold's own errors."""
    w, ch = Qs.hourly(spark, d), Qs.TYPES2
    first, n = w.agg(F.min("t")).first()[0], Qs.steps(w)
    fold = lambda test, gap: checks.folds(n, spark, k=1, test=test, gap=gap)
    score = lambda df, cond="true": df.where(cond).agg(F.avg("rmse").alias("v"))

    def by_forecast(ahead: int, since: int) -> DataFrame:
        train = w.where(F.col("t") < first + n - ahead)
        got = models.forecast(train, models.fit_var(train, ch, 2), ch, 2, ahead).where(F.col("t") >= first + n - ahead + since)
        e = [F.pow(F.col("x")[i] - F.col(c), 2) for i, c in enumerate(ch)]
        return got.join(w, ["series_id", "t"]).agg(F.sqrt(F.avg(sum(e) / len(ch))).alias("v"))

    cv = lambda f, **o: score(checks.var_cross_validation(w, ch, [2], f, **o))
    states = lambda f, kind="larimore", **o: score(statespace.cross_validation(w, ch, [2], 3, f, estimator=kind, **o))
    own = statespace.out_of_sample(w, ch, 2, 3, fold(60, 0), "n4sid").agg(F.sqrt(F.avg(F.pow("rmse", 2))).alias("v"))
    pairs = {
        "recursive": (cv(fold(60, 0), evaluation="recursive"), by_forecast(60, 0)),
        "embargo": (cv(fold(1, 5), gap="embargo"), by_forecast(6, 5)),
        "recursive_after_embargo": (cv(fold(20, 5), evaluation="recursive", gap="embargo"), by_forecast(25, 5)),
        "stepped": (cv(fold(60, 0), gap="embargo"), cv(fold(60, 0))),
        "one_state_step": (states(fold(1, 0), evaluation="recursive"), states(fold(1, 0))),
        "no_gap": (states(fold(60, 0), gap="embargo"), states(fold(60, 0))),
        "fold_errors": (states(fold(60, 0), "n4sid"), own),
    }
    out = None
    for name, (a, b) in pairs.items():
        both = a.crossJoin(b.withColumnRenamed("v", "u"))  # one row each
        row = both.select(F.lit(name).alias("identity"), (F.round(F.col("v") / F.col("u") - 1, 6) + 0.0).alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


def paths(spark, d):
    """A path ends where its search does, starts where its frame is and, with a line search, never rises."""
    ship(spark)
    model, planted = systems.paired_modules()
    opts = dict(runs=3, seed=1, points=POINTS, max_iter=60, optimizer="armijo")
    out = None
    for kind in ("proxy", "spectral"):
        path = ensembles.search_paths(spark, model, 3, kind, **opts)
        each = path.groupBy("run").agg(F.max_by("objective", "iteration").alias("last"), F.min("objective").alias("least"), F.min("iteration").alias("start"))
        end = each.join(ensembles.dependence_search(spark, model, 3, objective=kind, **opts).select("run", "objective"), "run")
        got = end.agg(F.max(F.abs(F.col("last") - F.col("objective"))).alias("end"), F.max(F.col("last") - F.col("least")).alias("rise"), F.max("start").cast("double").alias("start"))
        rows = got.unpivot([], ["end", "rise", "start"], "identity", "value").select(F.concat(F.lit(f"{kind}_"), "identity").alias("identity"), (F.round("value", 6) + 0.0).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    closed = models.write_innovations(["m"], model)
    table = spark.createDataFrame([(r.model_id, int(r.n), int(r.r), *[[float(v) for v in getattr(r, k)] for k in "ackv"], r.status) for r in closed.itertuples()], models.INNOVATIONS)
    got = plan.measures(table, ["dynamical_dependence"], plan.Config(macro=tuple(map(tuple, planted)))).select(F.lit("planted").alias("identity"), (F.round("value", 6) + 0.0).alias("value"))
    return out.unionByName(got)


def empirical_spectrum(spark, d):
    """A VAR with causality: the empirical spectral form integrates to the temporal one."""
    w = Qs.hourly(spark, d, Qs.TYPES3)
    f = np.linspace(0, 0.5, POINTS)
    spectral = empirical.empirical_spectral_mvgc(w, 1, ["purchase"], ["click"], f, ["view"]).withColumn("measure", F.lit("spectral"))
    own = spectral.select("measure", "f", "value").unionByName(empirical.empirical_mvgc(w, 1, ["purchase"], ["click"], ["view"]).select(F.lit("temporal").alias("measure"), F.lit(None).cast("double").alias("f"), "value"))
    # Two separate fits agree up to their sampling error, the order of rows ** -1.
    return differences(own, integral=F.round(mean("spectral") - take("temporal"), 2))


def ensembles_(spark, d):
    """Streams belong to members: nothing depends on partitions; intervals are ordered."""
    w = Qs.hourly(spark, d)
    m = models.fit_var(w, Qs.TYPES2)
    one = ensembles.simulate(m, 50, seed=1).select("t", F.col("x")[0].alias("a"))
    two = ensembles.simulate(m.repartition(7), 50, seed=1).select("t", F.col("x")[0].alias("b"))
    gap = one.join(two, "t").agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("v"))
    lost = ensembles.simulate(m, 50, seed=1).agg((50 - F.countDistinct("innovation")).alias("v"))
    ci = ensembles.intervals(ensembles.block_bootstrap(w, Qs.TYPES2, 1, ["entropy_rate", "predictive_information"], members=50)).agg(F.count_if(F.expr("low > mean or mean > high")).alias("v"))
    res = ensembles.intervals(ensembles.bootstrap(S.to_dense(w, Qs.TYPES2), 2, 1, ["entropy_rate"], members=20)).agg(F.count_if(F.expr("low > mean or mean > high or members <> 20")).alias("v"))
    general = ensembles.intervals(ensembles.bootstrap_state_space(S.to_dense(w, Qs.TYPES2), 2, 1, 3, ["entropy_rate"], members=4)).agg(F.count_if(F.expr("low > mean or mean > high")).alias("v"))
    null = Qs.numit(spark, d).agg(F.count_if(F.expr("quantile < 0 or quantile > 1 or quantile is null")).alias("v"))
    row = lambda name, df: df.select(F.lit(name).alias("identity"), (F.round(F.col("v").cast("double"), 6) + 0.0).alias("value"))
    out = row("partitions", gap)
    for name, df in (("shared_noise", lost), ("block_intervals", ci), ("residual_intervals", res), ("state_space_intervals", general), ("null_quantiles", null)):
        out = out.unionByName(row(name, df))
    return out


def dependence(spark, d):
    """What a search finds has the exact dependence that it reports; distances are a metric's; no candidate is below the best."""
    mask = np.eye(4) + np.eye(4, k=-1)
    model = systems.masked_model(mask)
    ship(spark)
    own = models.write_innovations(["m"], model)
    table = spark.createDataFrame([(r.model_id, int(r.n), int(r.r), *[[float(v) for v in getattr(r, k)] for k in "ackv"], r.status) for r in own.itertuples()], models.INNOVATIONS)
    out = None
    for optimizer in ("adaptive", "armijo"):
        found = ensembles.dependence_search(spark, model, 2, runs=3, seed=1, points=POINTS, max_iter=100, optimizer=optimizer)
        best = found.orderBy("objective").first()  # one projection
        exact = plan.measures(table, ["dynamical_dependence"], plan.Config(base=float(np.e), macro=tuple(map(tuple, np.reshape(best.rows, (2, 4)))))).select(F.lit(f"exact_{optimizer}").alias("identity"), (F.round(F.col("value") - best.objective, 4) + 0.0).alias("value"))
        out = exact if out is None else out.unionByName(exact)
    far = empirical.frame_distances(found, 2, 4)
    back = far.join(far.select(F.col("run_a").alias("run_b"), F.col("run_b").alias("run_a"), F.col("distance").alias("back")), ["run_a", "run_b"])
    ways = back.agg(F.max(F.abs(F.col("distance") - F.col("back"))).alias("v"))
    itself = far.where("run_a = run_b").agg(F.max("distance").alias("v"))
    few, many = (ensembles.candidate_search(spark, model, 2, candidates=k).select(F.col("value").alias(f"v{k}")) for k in (4, 16))
    better = few.crossJoin(many).select(F.greatest(F.col("v16") - F.col("v4"), F.lit(0.0)).alias("v"))  # one row each
    sweep = empirical.macro_sweep(spark, model, runs=1, points=POINTS, max_iter=50).agg(F.max(F.abs(F.aggregate("loadings", F.lit(0.0), lambda a, b: a + b) - F.col("m"))).alias("v"))
    for name, df in (("symmetric_distance", ways), ("own_distance", itself), ("more_candidates", better), ("loadings", sweep)):
        out = out.unionByName(df.select(F.lit(name).alias("identity"), (F.round(F.col("v").cast("double"), 5) + 0.0).alias("value")))
    return out


def synthetic(spark, d):
    """Every synthetic system has the radius of its name; uncoupled channels share nothing."""
    radii = (0.5, 0.8)
    m = models.to_innovations(ensembles.synthetic_catalogue(ship(spark), 5, radii, (0.0,)))
    got = plan.measures(m, ["spectral_radius", "predictive_information", "o_information_rate"])
    named = F.split("model_id", r"\|")
    radius = F.max(F.when(F.col("measure") == "spectral_radius", F.abs(F.col("value") - named[1].cast("double"))))
    alone = named[0] == "uncoupled"
    shared = F.max(F.when(alone & (F.col("measure") == "o_information_rate"), F.abs(F.col("value"))))
    memory_ = F.sum(F.when(alone & (F.col("measure") == "predictive_information"), F.col("value") + 2.5 * F.log2(1 - F.pow(named[1].cast("double"), 2))))
    return differences(got, radius=radius, uncoupled=shared, memory=memory_)


QUERIES = {
    "rates": (rates, "both_ways symmetric spectral_mir spectral_te pairwise mean_pairwise half_causality entropy_rates"),
    "mvgc": (mvgc, "spectral integrated unconditional pairwise greatest bivariate"),
    "oir": (oir, "spectral change change_of_another spectral_change"),
    "decompositions": (rate_decompositions, " ".join(f"{k}_{x}" for k in ("pird", "pdgc") for x in ("atoms", "integral", "parts", "delta", "spectral_parts", "unique"))),
    "memory": (memory, "all_lags first_lag own_past first_pair"),
    "phi": (phi, " ".join([f"total_{k}" for k in KINDS[1:]] + [f"storage_{k}" for k in KINDS])),
    "pid": (pid, "total_ccs first_ccs total_dep first_dep"),
    "emergence": (emergence, "emergence_psi emergence_full_past_psi full_past first_order"),
    "transformations": (transformations, "marginal rows third still same general same_variance"),
    "moving_averages": (moving_averages, "ma_variance ma_first ma_second ar_row arma_variance arma_second"),
    "estimators": (estimators, "normal_equations likelihood_falls unstable_lattice unstable_states small_sample one_order one_state_order one_rank"),
    "out_of_sample": (out_of_sample, "score shares folds"),
    "selection": (selection, "recursive embargo recursive_after_embargo stepped one_state_step no_gap fold_errors"),
    "paths": (paths, "proxy_end proxy_rise proxy_start spectral_end spectral_rise spectral_start planted"),
    "empirical_spectrum": (empirical_spectrum, "integral"),
    "ensembles": (ensembles_, "partitions shared_noise block_intervals residual_intervals state_space_intervals null_quantiles"),
    "dependence": (dependence, "exact_adaptive exact_armijo symmetric_distance own_distance more_candidates loadings"),
    "synthetic": (synthetic, "radius uncoupled memory"),
}


def register(query) -> None:
    for name, (run, identities) in QUERIES.items():
        rows = ", ".join(f"('{x}', 0.0::double)" for x in identities.split())
        query(f"identities_{name}", f"select * from (values {rows}) t(identity, value)")(run)
