"""Spark operators against kernels and plain computations."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagspark import sources as S
from lagspark.functions import ident
from lagspark.functions import models as M
from lagspark.operators import checks, empirical, ensembles, lags, models, static, statespace
from lagspark.plans import measures as plan
from lagspark.plans import queries


@pytest.fixture(scope="module")
def series():
    coef, sigma = np.array([[[[0.5, -0.2], [0.1, 0.4]]]] * 3), np.array([[[2, 0.6], [0.6, 1]]] * 3)
    return ident.simulate_var(coef, sigma, 150, seed=3)


@pytest.fixture(scope="module")
def wide(spark, series):
    rows = [(f"s{i}", t, float(v[0]), float(v[1])) for i, x in enumerate(series) for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id string, t long, a double, b double").cache()


def test_lags_do_not_cross_blocks_gaps_or_series(wide):
    full = lags.lagged(wide, ["a", "b"], 3).toPandas().sort_values(["series_id", "t"]).reset_index(drop=True)
    cut = lags.lagged(wide, ["a", "b"], 3, block=7).toPandas().sort_values(["series_id", "t"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(full, cut)
    assert len(full) == 3 * 147
    assert lags.lagged(wide.where("t <> 50"), ["a"], 2).where("series_id = 's0'").count() == 150 - 1 - 2 - 2


@pytest.mark.parametrize("pooled", [False, True])
def test_fit_from_moments_equals_least_squares(wide, series, pooled):
    got = models.fit_var(wide, ["a", "b"], 2, pooled=pooled).toPandas().sort_values("model_id")
    want = ident.fit_var(series, 2, pooled=pooled)
    assert np.allclose(np.stack(got["coef"]), want["coef"].reshape(len(got), -1), atol=1e-9)
    assert np.allclose(np.stack(got["sigma"]), want["sigma"].reshape(len(got), -1), atol=1e-9)
    assert np.allclose(np.stack(got["intercept"]), want["intercept"], atol=1e-9)


def test_short_series_keeps_a_status(spark):
    df = spark.createDataFrame([("s", 0, 1.0), ("s", 1, 2.0)], "series_id string, t long, a double")
    row = models.fit_var(df, ["a"]).first()
    assert row.status != "ok" and row.coef is None
    m = models.to_innovations(models.fit_var(df, ["a"]))
    assert [(r.model_id, r.a, r.status) for r in m.collect()] == [("s", None, row.status)]
    assert [(r.model_id, r.family, r.measure, r.value) for r in plan.measures(m, ["entropy_rate"]).collect()] == [("s", "status", row.status, None)]
    kept = [(r.model_id, r.status) for r in models.project(m, [[1.0]]).collect()]
    assert kept == [("s", row.status)]


def test_a_kernel_that_fails_marks_its_row_only(spark, wide):
    m = models.to_innovations(models.fit_var(wide, ["a", "b"]))

    def change(x, pdf):
        if "s1" in set(pdf["model_id"]):
            raise np.linalg.LinAlgError("no")
        return x

    assert sorted((r.model_id, r.status) for r in models.transform(m, change).collect()) == [("s0", "ok"), ("s1", "no"), ("s2", "ok")]


def test_bauer_and_larimore_mark_singular_windows(spark, wide):
    flat = wide.withColumn("b", F.col("a"))
    assert {r.chosen for r in statespace.bauer_order(flat, ["a", "b"], 3).collect()} <= {False, True}
    none = spark.createDataFrame([("s", 0, 1.0)], "series_id string, t long, a double")
    assert statespace.bauer_order(none, ["a"], 2).count() == 0
    bad = wide.withColumn("a", F.when(F.col("series_id") == "s1", F.lit(float("nan"))).otherwise(F.col("a")))
    got = {r.model_id: r.status for r in statespace.larimore(bad, ["a", "b"], 1, 2, pooled=False).collect()}
    assert got["s0"] == got["s2"] == "ok" and got["s1"] != "ok"
    orders = {(r.model_id, r.order is None) for r in statespace.bauer_order(bad, ["a", "b"], 2, pooled=False).collect()}
    assert ("s1", True) in orders and ("s0", False) in orders


def test_simulated_streams_belong_to_models(spark):
    m = ensembles.synthetic_catalogue(spark, 3, (0.5,), (0.0,))
    key = lambda df: sorted((r.series_id, r.t, tuple(r.x), tuple(r.innovation)) for r in df.collect())
    a, b = key(ensembles.simulate(m.coalesce(1), 20, seed=1)), key(ensembles.simulate(m.repartition(5, "model_id"), 20, seed=1))
    assert a == b and len({r[3] for r in a}) == len(a)
    own = [r for r in a if r[0] == "uncoupled|0.5|0.0"]
    assert np.allclose([r[2] for r in own[1:]], [0.5 * np.array(p[2]) + np.array(r[3]) for p, r in zip(own, own[1:])])


def test_moments_by_matrix_products(wide, monkeypatch):
    plain = lags.lag_moments(wide, ["a", "b"], 2).toPandas().sort_values("model_id")
    by_depth = lags.depth_moments(wide, ["a", "b"], 2).toPandas()
    assert by_depth.groupby("model_id")["depth"].apply(sorted).tolist() == [[0, 1, 2]] * 3
    monkeypatch.setattr(lags, "WIDE_DESIGN", 1)
    again = lags.lag_moments(wide, ["a", "b"], 2).toPandas().sort_values("model_id")
    assert np.allclose(np.stack(plain["cov"]), np.stack(again["cov"])) and plain["rows"].tolist() == again["rows"].tolist()


def test_whiteness_and_diagnostics_from_sums(wide, series):
    from lagspark.functions import special, testing

    w = empirical.whiteness(wide, ["a", "b"], 1, block=16).toPandas()
    fit = ident.fit_var(series, 1)
    for k, x in enumerate(series):
        e, design = fit["residuals"][k], (x - x.mean(0))[1:]
        d = np.diff(np.eye(len(e)), axis=0)
        law = testing.durbin_watson_law(design.T @ design, (d @ design).T @ d @ design, (d @ design)[1:].T @ (d @ design)[:-1], len(e))
        dw = ((d @ e) ** 2).sum(0) / (e**2).sum(0)
        own = w[w["series_id"] == f"s{k}"].sort_values("channel")
        assert np.allclose(own["dw"], dw) and np.allclose(own["pvalue"], 2 * special.norm_cdf(-abs((dw - law[0]) / law[1])))
    rows = models.predictions(wide, models.fit_var(wide, ["a", "b"]), ["a", "b"], 1)
    got = empirical.innovation_diagnostics(rows, 2, 3, block=16).where("series_id = 's2'").toPandas().set_index("measure")["value"]
    e, x = fit["residuals"][2], series[2][1:]
    sigma = fit["sigma"][2]
    z = np.linalg.solve(np.linalg.cholesky(sigma), e.T).T
    assert got["rmse[1]"] == pytest.approx(np.sqrt((e[:, 1] ** 2).mean())) and got["r2[0]"] == pytest.approx(1 - (e[:, 0] ** 2).mean() / x[:, 0].var())
    assert got["calibration"] == pytest.approx(np.linalg.norm(np.cov(z.T) - np.eye(2)) / np.sqrt(2))
    r = [(z[k:] - z[k:].mean(0)).T @ (z[:-k] - z[:-k].mean(0)) / (len(z) - k) for k in (1, 2, 3)]
    assert got[[f"energy[{k}]" for k in range(3)]].tolist() == pytest.approx([(m**2).sum() for m in r])
    assert got["ljung_box"] == pytest.approx(149 * 151 * sum((m**2).sum() / (149 - k) for k, m in zip((1, 2, 3), r)))
    assert got["nll"] == pytest.approx(0.5 * (z**2).sum(1).mean() + 0.5 * np.linalg.slogdet(sigma)[1] + np.log(2 * np.pi))


def test_block_bootstrap_of_several_series(spark, wide):
    got = ensembles.block_bootstrap(wide, ["a", "b"], 1, ["entropy_rate"], members=50, block=10)
    again = ensembles.block_bootstrap(wide.repartition(3), ["a", "b"], 1, ["entropy_rate"], members=50, block=10)
    key = lambda df: {r.model_id: round(r.value, 9) for r in df.collect()}
    assert key(got) == key(again) and len(key(got)) == 50
    whole = plan.measures(models.to_innovations(models.fit_var(wide, ["a", "b"], pooled=True)), ["entropy_rate"]).first().value
    ci = ensembles.intervals(got).first()
    assert ci.low < whole < ci.high and ci.high - ci.low < 1
    each = ensembles.block_bootstrap(wide, ["a", "b"], 1, ["entropy_rate"], members=4, block=10, pooled=False)
    assert {r.model_id for r in each.collect()} == {f"s{i}#{k}" for i in range(3) for k in range(4)}


def test_predictions_and_forecast(wide, series):
    fit = ident.fit_var(series, 1)
    m = models.fit_var(wide, ["a", "b"])
    got = models.predictions(wide, m, ["a", "b"], 1).toPandas().sort_values(["series_id", "t"])
    assert np.allclose(np.stack(got["residual"]), fit["residuals"].reshape(-1, 2), atol=1e-9)
    f = models.forecast(wide, m, ["a", "b"], 1, 4).toPandas().sort_values(["series_id", "t"])
    assert np.allclose(np.stack(f["x"]).reshape(3, 4, 2), ident.forecast(series, fit["coef"], fit["intercept"], 4))


def test_measures_table(wide, series):
    m = models.to_innovations(models.fit_var(wide, ["a", "b"]))
    got = plan.measures(m, ["rates", "gaussian.total_correlation"]).toPandas()
    assert set(got["model_id"]) == {"s0", "s1", "s2"} and np.isfinite(got["value"]).all()
    fit = ident.fit_var(series, 1)
    from lagspark.functions import causality as R

    want = R.mutual_information_rate(M.var_to_innovations(fit["coef"], fit["sigma"]), [0], [1])
    assert np.allclose(got[got["measure"] == "mutual_information_rate"].sort_values("model_id")["value"], want)
    with pytest.raises(ValueError):
        plan.resolve("nonsense")
    assert "dynamical_dependence" in plan.not_available(2)


def test_regularise_fills_gaps(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    ev = spark.createDataFrame([(at(0), "a", 1.0), (at(3), "a", 2.0), (at(3), "a", 0.5), (at(1), "b", 4.0), (at(2), None, 9.0), (None, "a", 1.0)], "ts timestamp_ntz, k string, v double")
    args = dict(time="ts", unit="HOUR", value="v", channel="k", channels=["a", "b"])
    got = S.regularise(ev, **args).orderBy("t").collect()
    assert [(r.a, r.b) for r in got] == [(1, 0), (0, 4), (0, 0), (2.5, 0)]
    got = S.regularise(ev, **args, fill="locf").orderBy("t").collect()
    assert [(r.a, r.b) for r in got] == [(1, None), (1, 4), (1, 4), (2.5, 4)]
    long = S.to_long(S.regularise(ev, **args), ["a", "b"])
    assert S.to_wide(S.from_channel_major(S.to_channel_major(long)), ["a", "b"]).count() == 4
    assert S.regularise(ev.where("false"), **args).count() == 0
    for fill in (0.0, "locf"):
        assert sorted(map(tuple, S.regularise(ev, **args, fill=fill, block=2).collect()), key=str) == sorted(map(tuple, S.regularise(ev, **args, fill=fill).collect()), key=str)


def test_hankel(wide, series):
    got = lags.hankel(wide, ["a", "b"], 2, 3).where("series_id = 's1'").orderBy("t").toPandas()
    p, f = ident.hankel(series[1:2], 2, 3)
    assert np.allclose(np.stack(got["past"]).T, p[0]) and np.allclose(np.stack(got["future"]).T, f[0])


def test_larimore_from_moments_is_near_the_windowed_estimate(wide, series):
    got = statespace.larimore(wide, ["a", "b"], 2, 4).toPandas()
    m = models.read_innovations(got)
    want = ident.larimore(series, 2, 4)["model"]
    assert np.allclose(M.autocovariances(m, 2), M.autocovariances(want, 2), atol=0.15)


def test_kalman_streams_and_smooths(spark, wide, series):
    dense = S.to_dense(wide, ["a"])
    sys_ = ([[0.5]], [[1.0]], [[0.4]], [[0.6]])
    got = statespace.kalman_filter(dense, *sys_).where("series_id = 's2'").orderBy("t").toPandas()
    want = ident.kalman(series[2, :, :1], *map(np.array, sys_))
    assert np.allclose(np.stack(got["mean"]), want["mean"]) and got["loglik"].iloc[-1] == pytest.approx(want["loglik"])
    s = statespace.kalman_smoother(dense, *sys_).where("series_id = 's2'").orderBy("t").toPandas()
    assert np.allclose(np.stack(s["mean"]), ident.smooth(series[2, :, :1], *map(np.array, sys_))["mean"])
    _, ll = statespace.expectation_maximisation(dense, sys_, 3)
    assert np.diff(ll).min() > -1e-6


def test_entropies_and_significance(spark):
    df = spark.createDataFrame([(i % 2, (i // 2) % 2) for i in range(200)], "x int, y int")
    assert static.discrete_entropy(df, ["x"]).first().entropy == pytest.approx(1)
    assert static.discrete_mutual_information(df, ["x"], ["y"]).first().mutual_information == pytest.approx(0, abs=1e-12)
    assert static.discrete_total_correlation(df.select("x", F.col("x").alias("z")), ["x", "z"]).first().total_correlation == pytest.approx(1)
    nulls = spark.createDataFrame([(None, 1), (None, 2), (1, 1), (1, None)], "x int, y int")
    assert [round(r.entropy, 6) for r in static.entropies(nulls, [["x"], ["x", "y"], ["y"], ["x"]]).orderBy("set").collect()] == [1.0, 2.0, 1.5, 1.0]
    many = spark.range(3000).select((F.pow(F.col("id") / 3000.0, 6) + 1e-12).alias("p"))
    assert checks.significance(many, bins=64).where("significant").count() == checks.significance(many, bins=4096).where("significant").count() > 1000
    p = spark.createDataFrame([(0.001,), (0.01,), (0.03,), (0.20,), (float("nan"),), (None,)], "p double")
    assert [r.significant for r in checks.significance(p).orderBy(F.col("p").asc_nulls_last()).collect()] == [True, True, True, False, False, False]


def test_ensembles_do_not_depend_on_partitions(spark, wide):
    dense = S.to_dense(wide.where("series_id = 's0'"), ["a", "b"])
    one = ensembles.bootstrap(dense, 2, 1, ["entropy_rate"], members=12, seed=1)
    a = {r.model_id: r.value for r in one.collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    b = {r.model_id: r.value for r in ensembles.bootstrap(dense.repartition(3), 2, 1, ["entropy_rate"], members=12, seed=1).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b and len(a) == 12
    ci = ensembles.intervals(one).first()
    assert ci.low <= ci.mean <= ci.high


def test_grid_stream_closes_windows(spark, tmp_path):
    from lagspark.streaming import grid_stream

    start = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(start + dt.timedelta(minutes=30 * h), "a" if h % 3 else "b", float(h)) for h in range(60)], "ts timestamp, k string, v double")
    ev.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    grid = grid_stream(stream, time="ts", width="1 hour", late="0 seconds", value="v", channels=["a", "b"], channel="k")
    q = grid.writeStream.format("memory").queryName("grid_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("grid_rows").orderBy("start").collect()
    assert len(got) == 29 and [(r.a, r.b) for r in got[:3]] == [(1, 0), (2, 3), (9, 0)]  # the last window is still open


def test_stream_filter_equals_batch_and_steps_over_gaps(spark, tmp_path):
    from lagspark.streaming import filter_stream

    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    values = {h: float(h * 7 % 5) for h in range(20) if h not in (6, 7)}
    rows = [("s", start + dt.timedelta(hours=h), v) for h, v in values.items()]
    schema = "series_id string, start timestamp, a double"
    spark.createDataFrame(rows[:9], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    m = M.var_to_innovations(np.array([[[[0.5]]]]), np.eye(1)[None])
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = filter_stream(stream, m, ["a"], 3600).writeStream.format("memory").queryName("filtered").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    spark.createDataFrame(rows[7:], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # two rows come late, again
    q.processAllAvailable()
    q.stop()
    got = [(r.step, r.innovation[0]) for r in spark.table("filtered").orderBy("step").collect()]
    first, x, want = int(start.timestamp() // 3600), 0.0, []
    for h in range(20):
        if h in values:
            want.append((first + h, values[h] - x))
            x = 0.5 * values[h]
        else:
            x = 0.5 * x
    assert [s for s, _ in got] == [s for s, _ in want] and np.allclose([e for _, e in got], [e for _, e in want])


def test_empirical_operators(spark, wide, series):
    from lagspark.operators import empirical

    table = empirical.coefficient_table(models.fit_var(wide, ["a", "b"], 2))
    back = empirical.from_coefficient_table(table, 2).toPandas().sort_values("model_id")
    assert np.allclose(np.stack(back["coef"]), ident.fit_var(series, 2)["coef"].reshape(3, -1))
    lwr = empirical.fit_lwr(wide, ["a", "b"], 2).toPandas().sort_values("model_id")
    assert np.allclose(np.stack(lwr["coef"]), ident.fit_lwr(series, 2)["coef"].reshape(3, -1))
    value = empirical.empirical_mvgc(wide, 1, ["b"], ["a"]).first().value
    f = np.linspace(0, 0.5, 65)
    spec = empirical.empirical_spectral_mvgc(wide, 1, ["b"], ["a"], f).orderBy("f").toPandas()
    assert value > -0.01 and M.integrate(spec["value"].to_numpy(), f) == pytest.approx(value, abs=0.01)
    w = empirical.whiteness(wide, ["a", "b"], 1).toPandas()
    assert ((w["pvalue"] >= 0) & (w["pvalue"] <= 1)).all() and (abs(w["dw"] - 2) < 0.6).all()
    cv = statespace.cross_validation(wide.where("series_id = 's0'"), ["a", "b"], [1, 2], 3, checks.folds(150, spark, k=2, test=20))
    assert cv.where("chosen").select("states").distinct().count() == 1 and cv.count() == 4


def test_orders_of_a_second_order_process(spark):
    coef = np.array([[[[0.05, 0], [0, 0.05]], [[0.72, 0.08], [-0.05, 0.68]]]] * 4)
    x = ident.simulate_var(coef, 0.15 * np.eye(2)[None], 400, seed=5)
    rows = [(f"s{i}", t, float(v[0]), float(v[1])) for i, s in enumerate(x) for t, v in enumerate(s)]
    wide = spark.createDataFrame(rows, "series_id string, t long, a double, b double")
    for criterion in ("aic", "bic", "hqc"):
        best = checks.var_criteria(wide, ["a", "b"], [1, 2, 3], criterion).where("chosen").collect()
        assert [r.order for r in best] == [2] or criterion == "aic"
    cv = checks.var_cross_validation(wide, ["a", "b"], [1, 2], checks.folds(400, spark, k=2, test=60, gap=5))
    assert {r.order for r in cv.where("chosen").collect()} == {2}


def test_transformations_of_model_tables(spark, wide):
    m = models.to_innovations(models.fit_var(wide, ["a", "b"]))
    scaled = models.scale_grid(m, [0.0, 1.0, 5.0]).toPandas()
    assert set(scaled.loc[scaled["model_id"].str.endswith("@5.0"), "status"]) == {"no stationary solution"}
    info = lambda t: {r.model_id: r.value for r in plan.measures(t, ["predictive_information"]).collect()}
    base, got = info(m), info(models.scale_grid(m, [0.0, 1.0]))
    assert got["s0@1.0"] == pytest.approx(base["s0"]) and 0 < got["s0@0.0"] < base["s0"]
    slow = info(models.downsample(m, 3))
    assert all(slow[k] < base[k] for k in base)
    both = plan.measures(models.project(m, [[1.0, 0.0], [0.0, 1.0]]), ["mutual_information_rate"]).toPandas()
    assert np.allclose(both.sort_values("model_id")["value"], plan.measures(m, ["mutual_information_rate"]).toPandas().sort_values("model_id")["value"])


def test_searches_are_ranked_and_repeatable(spark):
    from lagspark.functions import systems
    from lagspark.operators import empirical

    model = systems.masked_model(np.eye(4) + np.eye(4, k=-1))
    a = ensembles.dependence_search(spark, model, 2, runs=4, seed=1, points=33, max_iter=100)
    b = ensembles.dependence_search(spark, model, 2, runs=4, seed=1, points=33, max_iter=100)
    key = lambda t: sorted((r.run, round(r.objective, 9), r.size) for r in t.collect())
    assert key(a) == key(b) and sum(s for *_, s in key(a)) == 4
    sweep = empirical.macro_sweep(spark, model, runs=1, points=33, max_iter=50).collect()
    assert sorted(r.m for r in sweep) == [1, 2, 3] and all(sum(r.loadings) == pytest.approx(r.m) for r in sweep)
    null = ensembles.numit(spark, np.array([[[0.5, -0.2], [0.1, 0.4]]]), np.array([[2, 0.6], [0.6, 1]]), [0], [1], members=8, seed=2).collect()
    assert len(null) == 4 and all(0 <= r.quantile <= 1 for r in null)


def test_registered_queries_take_the_length_of_the_series(spark, tmp_path):
    x = ident.simulate_var(np.array([[[[0.4, 0.1], [-0.1, 0.3]]]]), np.eye(2)[None], 900, seed=8)[0]
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(hours=i), c, float(v[k])) for i, v in enumerate(x) for k, c in enumerate(queries.TYPES2)]
    spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    w = queries.hourly(spark, str(tmp_path))
    f = checks.folds(900, spark, k=3, test=60)
    assert [tuple(x) for x in f.orderBy("fold").collect()] == [(0, 720, 720, 780), (1, 780, 780, 840), (2, 840, 840, 900)]
    m = plan.measures(queries.model2(spark, str(tmp_path)), ["pairwise_temporal_mvgc"]).where("i <> j").select("i", "j", "value")
    want = {
        "var_cv": checks.var_cross_validation(w, queries.TYPES2, [1, 2, 3], f),
        "var_cv_nll": checks.var_cross_validation(w, queries.TYPES2, [1, 2], f, "one_se", "nll"),
        "larimore_cv": statespace.cross_validation(w, queries.TYPES2, [1, 2, 3], 3, f),
        "mvgc_pvalues": checks.significance(checks.mvgc_pvalues(m, (1, 1, 0), 1, 899)),
    }
    for name, rows in want.items():
        own = queries.rounded(rows, 8 if name == "mvgc_pvalues" else 4)
        assert sorted(map(tuple, queries.Q[name](spark, str(tmp_path)).collect())) == sorted(map(tuple, own.collect())), name


def test_wide_models_need_sources():
    assert plan._few_sources(4, plan.Config()) is None and plan._few_sources(5, plan.Config()) == "not two or three sources"
    assert plan._few_sources(5, plan.Config(sources=((0,), (2, 3, 4)))) is None


def test_bootstrap_rejects_several_series(wide):
    for call in (lambda d: ensembles.bootstrap(d, 2, 1, ["entropy_rate"], members=2), lambda d: ensembles.bootstrap_state_space(d, 2, 1, 3, ["entropy_rate"], members=2)):
        with pytest.raises(ValueError, match="one series"):
            call(S.to_dense(wide, ["a", "b"]))


def by_hand(x, coef, const, ends, seen):
    """Held-out predictions of one series, a step at a time; None and unseen steps go on with their prediction."""
    train, start, end = ends
    past, out = [x[t] for t in range(train - len(coef), train)], {}
    for t in range(train, end):
        guess = const + sum(a @ past[-k - 1] for k, a in enumerate(coef))
        here = "gap" if t < start else "test"
        if here == "test" and x[t] is not None:
            out[t] = guess
        past.append(x[t] if x[t] is not None and here in seen else guess)
    return out


@pytest.mark.parametrize("evaluation", ["rolling", "recursive"])
@pytest.mark.parametrize("gap", ["warmup", "embargo"])
def test_stepwise_predictions_of_folds(spark, wide, evaluation, gap):
    f = checks.folds(150, spark, k=2, test=20, gap=4)
    holes = wide.where("t <> 120").withColumn("a", F.when(F.col("t") != 141, F.col("a")))
    train, test = checks.fold_rows(holes, ["a", "b"], f, 2)
    fits = models.fit_var(train, ["a", "b"], 2)
    seen = checks.seen_phases(evaluation, gap)
    got = {(r.series_id, r.t): r.prediction for r in checks.stepped(test.repartition(5), fits, ["a", "b"], 2, seen).collect()}
    rows = {(r.series_id, r.t): np.array([r.a, r.b]) for r in holes.collect() if r.a is not None}
    want = {}
    for m in fits.collect():
        series_id, k = m.model_id.split("#")
        x = [rows.get((series_id, t)) for t in range(150)]
        ends = f.where(f"fold = {k}").first()[1:]
        for t, v in by_hand(x, np.reshape(m.coef, (2, 2, 2)), np.array(m.intercept), ends, seen).items():
            want[m.model_id, t] = v
    assert got.keys() == want.keys() and len(got) == 3 * 38
    assert all(np.allclose(got[k], want[k]) for k in want)


def test_modes_of_cross_validation_agree_where_they_must(spark, wide):
    f = checks.folds(150, spark, k=3, test=15)
    native = checks.var_cross_validation(wide, ["a", "b"], [1, 2], f).orderBy("order", "fold").toPandas()
    stream = checks.var_cross_validation(wide, ["a", "b"], [1, 2], f, gap="embargo").orderBy("order", "fold").toPandas()
    pd.testing.assert_frame_equal(native, stream[native.columns.tolist()], check_exact=False)
    least = native.groupby("order")["rmse"].mean().idxmin()
    assert set(native.loc[native["chosen"], "order"]) == {least}
    with pytest.raises(ValueError, match="rolling or recursive"):
        checks.var_cross_validation(wide, ["a", "b"], [1], f, evaluation="once")


def test_choice_passes_over_missing_scores(spark):
    rows = [(1, 0, 3.0), (1, 1, 3.2), (2, 0, 2.0), (2, 1, 4.0), (3, 0, None), (4, 0, float("nan"))]
    table = spark.createDataFrame(rows, "o int, fold int, rmse double")
    pick = lambda rule: {r.o for r in checks.choose(table, "o", "rmse", rule).where("chosen").collect()}
    assert pick("best") == {2} and pick("one_se") == {1}
    assert checks.choose(table.where("o = 3"), "o", "rmse", "best").where("chosen").count() == 0


@pytest.mark.parametrize("estimator", ["larimore", "n4sid"])
def test_state_space_folds_keep_series_apart(spark, wide, series, estimator):
    f = checks.folds(150, spark, k=2, test=20, gap=3)
    got = statespace.fold_errors(wide, ["a", "b"], [1, 2], 3, f, estimator).toPandas()
    assert len(got) == 3 * 2 * 2 * 20
    one = statespace.fold_errors(wide.where("series_id = 's1'"), ["a", "b"], [2], 3, f, estimator).toPandas()
    same = got[(got["series_id"].str.startswith("s1#")) & (got["r"] == 2)]
    key = lambda t: np.stack(t.sort_values(["series_id", "t"])["residual"])
    assert np.allclose(key(one), key(same))
    if estimator == "n4sid":
        end = f.where("fold = 0").first()
        x = series[1] - series[1][: end.train_end].mean(0)
        m = M.innovations_form(*[v[None] for v in ident.n4sid(series[1][None, : end.train_end], 2, 3)["system"]])
        assert np.allclose(ident.innovations(x[None], m)[0][end.test_start : end.test_end], key(same[same["series_id"] == "s1#0"]))
    each = statespace.out_of_sample(wide, ["a", "b"], 2, 3, f, estimator).toPandas()
    cv = statespace.cross_validation(wide, ["a", "b"], [2], 3, f, estimator=estimator).toPandas()
    assert len(each) == 3 * 2 * 2
    for k, own in each.groupby("fold"):
        assert cv.loc[cv["fold"] == k, "rmse"].item() == pytest.approx(np.sqrt((own["rmse"] ** 2).mean()))


def test_a_series_too_short_for_a_fold_has_no_errors(spark, wide):
    f = checks.folds(150, spark, k=1, test=20)
    short = wide.where("series_id <> 's0' or t >= 128")
    got = statespace.fold_errors(short, ["a", "b"], [1], 3, f).select("series_id").distinct().collect()
    assert {r.series_id for r in got} == {"s1#0", "s2#0"}


def test_search_paths_and_stages(spark):
    from lagspark.functions import dependence as X
    from lagspark.functions import systems

    model = systems.masked_model(systems.network("tnet5"), seed=3)
    for optimizer, options in (("adaptive", {"variant": 1, "step": 0.01}), ("armijo", {"back": 0.25})):
        opts = dict(runs=3, seed=2, points=33, max_iter=30, optimizer=optimizer, options=options)
        path = ensembles.search_paths(spark, model, 2, "proxy", **opts).toPandas()
        found = ensembles.dependence_search(spark, model, 2, objective="proxy", **opts).toPandas().set_index("run")
        for run, own in path.groupby("run"):
            own = own.sort_values("iteration")
            assert list(own["iteration"]) == list(range(len(own))) and (np.diff(own["objective"]) <= 1e-15).all()
            assert own["objective"].iloc[-1] == pytest.approx(found.loc[run, "objective"]) and found.loc[run, "size"] == 1
    seq = X.proxy_sequence(X.whiten(model)[0])
    assert np.allclose(path[path["iteration"] == 0].sort_values("run")["objective"], X.proxy(X.orthonormal(X.random_frames(3, 2, 5, 2)), seq))


def test_named_networks_and_parameters(spark):
    from lagspark.functions import systems

    assert systems.network("tnet5").shape == (5, 5) and systems.network("tnet9").sum() == 19
    block = systems.modular_mask(3, 4, 1.0, 0.0)
    assert (block == np.kron(np.eye(3), np.ones((4, 4)))).all()
    assert (systems.random_mask(6, 0.0) == np.eye(6)).all() and (np.diag(systems.random_mask(6, 0.5, 4)) == 1).all()
    m = systems.masked_model(systems.random_mask(6, 0.4, 1), seed=2)
    assert np.abs(np.linalg.eigvals(m.a[0])).max() == pytest.approx(0.72) and ((m.a[0] != 0) <= (systems.random_mask(6, 0.4, 1) != 0)).all()
    with pytest.raises(ValueError, match="no feedback"):
        systems.masked_model(np.eye(3, k=-1))
    assert systems.named("Star-Broadcast") == "hub_broadcast"
    with pytest.raises(ValueError, match="no system"):
        systems.named("star")
    table = ensembles.system_parameters(spark).toPandas().groupby("system")["parameter"].apply(set)
    for name in systems.SYSTEMS:
        assert set(systems.parameters(name)) == table[name]
        values = {p: {"n_modules": 3, "seed": 5, "density": 0.6, "hub": 2}.get(p, 0.5) for p in table[name]}
        assert np.abs(np.linalg.eigvals(systems.transition(name, 6, **values))).max() == pytest.approx(1)
