"""Golden values and identities of the numeric kernels."""

import math

import numpy as np
import pytest

from lagspark.functions import causality as R
from lagspark.functions import decomposition as P
from lagspark.functions import dependence as X
from lagspark.functions import discrete, ident, special, systems, testing
from lagspark.functions import dynamics as D
from lagspark.functions import gaussian as G
from lagspark.functions import linalg as L
from lagspark.functions import models as M

FREQS = np.linspace(0, 0.5, 1025)
SIGMA4 = np.array([[1, 0.15, 0.30, 0.10], [0.15, 1, 0.05, 0.25], [0.30, 0.05, 1, 0.20], [0.10, 0.25, 0.20, 1]])[None]


@pytest.fixture(scope="module")
def rates3():
    rng = np.random.default_rng(41)
    coef = systems.decay_to(rng.standard_normal((1, 2, 3, 3)), 0.7)
    sigma = systems.random_covariance(3, 1, 42)
    return coef, sigma, M.var_to_innovations(coef, sigma)


def test_projected_dependence_golden():
    m = M.Innovations(*(np.array([x]) for x in ([[0.45, 0.10], [0, 0.30]], [[1, 0.2], [0.25, 0.8]], [[0.35, 0.08], [0.05, 0.28]], [[1, 0.2], [0.2, 0.7]])))
    assert R.dynamical_dependence(m, [[1, 0.35]], math.e)[0] == pytest.approx(0.00284786356182265, abs=1e-10)
    assert R.dynamical_dependence(m, np.eye(2))[0] == pytest.approx(0, abs=1e-12)


@pytest.mark.parametrize("radius", [0.5, 0.95, 0.999, 1.01, 1.2])
def test_riccati_residual_also_for_unstable_dynamics(radius):
    rng = np.random.default_rng(43)
    a, c = rng.standard_normal((1, 3, 3)), rng.standard_normal((1, 2, 3))
    a *= radius / L.spectral_radius(a)
    q, r = systems.random_covariance(3, 1, 44), systems.random_covariance(2, 1, 45)
    p = L.dare(a, c, q, r)
    gain = a @ p @ L.t(c)
    assert np.abs(a @ p @ L.t(a) + q - gain @ np.linalg.solve(c @ p @ L.t(c) + r, L.t(gain)) - p).max() < 1e-9


def test_downsampled_scalar_closed_form():
    m = M.Innovations(*(np.array([[[x]]], float) for x in (0.5, 0.5, 1, 2)))
    d = M.downsample(m, 3)
    assert (d.a[0, 0, 0], d.v[0, 0, 0]) == pytest.approx((0.125, 2.625))


def test_lyapunov_methods_agree_and_mark_instability():
    a = np.array([[[0.5, 0.2], [0.1, 0.3]], [[1.1, 0], [0, 0.2]]])
    q = np.broadcast_to(np.eye(2), (2, 2, 2))
    x, y = L.lyapunov(a, q), L.lyapunov(a, q, method="direct")
    assert np.allclose(x[0], y[0]) and np.isnan(x[1]).all() and np.isnan(y[1]).all()


def test_companion_and_scaling(rates3):
    coef = np.array([[[[0.2, 0.1], [0, 0.3]], [[0.4, 0], [0.2, 0.1]]]])
    assert M.companion(coef)[0].tolist() == [[0.2, 0.1, 0.4, 0], [0, 0.3, 0.2, 0.1], [1, 0, 0, 0], [0, 1, 0, 0]]
    m = rates3[2]
    assert np.allclose(M.scale(m, 1.0).v, m.v)
    assert np.isnan(M.scale(m, 5.0).v).all()


def test_varma_without_moving_average_is_var(rates3):
    coef, sigma, m = rates3
    v = M.varma_to_innovations(coef, np.zeros((1, 0, 3, 3)), sigma)
    assert np.allclose(M.autocovariances(v, 3), M.autocovariances(m, 3))
    ma = M.varma_to_innovations(np.zeros((1, 0, 1, 1)), np.array([[[[0.5]]]]), np.array([[[2.0]]]))
    assert M.autocovariances(ma, 2)[0].ravel() == pytest.approx([2.5, 1.0, 0.0])


def test_spectral_integrals_equal_temporal_rates(rates3):
    m = rates3[2]
    s = M.spectrum(m, FREQS)
    assert M.integrate(R.spectral_mutual_information_rate(s, [0], [1]), FREQS) == pytest.approx(R.mutual_information_rate(m, [0], [1]), abs=1e-12)
    assert M.integrate(R.spectral_transfer_entropy_rate(m, [0], [2], FREQS), FREQS) == pytest.approx(R.transfer_entropy_rate(m, [0], [2]), abs=1e-12)
    assert M.integrate(R.spectral_mvgc(m, [0], [2], FREQS), FREQS) == pytest.approx(R.temporal_mvgc(m, [0], [2]), abs=1e-12)
    assert M.integrate(R.spectral_o_information_rate(s), FREQS) == pytest.approx(R.o_information_rate(m), abs=1e-12)
    assert R.pairwise_temporal_mvgc(m)[0, 0, 2] == pytest.approx(R.temporal_mvgc(m, [0], [2])[0])
    te = R.transfer_entropy_rate(m, [0], [1]) + R.transfer_entropy_rate(m, [1], [0]) + R.instantaneous_rate(m, [0], [1])
    assert te == pytest.approx(R.mutual_information_rate(m, [0], [1]))
    assert R.o_information_rate(m, [[0], [1]])[0] == pytest.approx(0, abs=1e-12)


def test_integration_contract():
    f = np.linspace(0, 100, 1001)
    assert M.integrate(np.full(1001, 2.75), f, 200) == pytest.approx(2.75)
    half = np.arange(512) * 200 / 1024
    assert M.integrate(half, half, 200, True) == pytest.approx(half.mean())
    with pytest.raises(ValueError):
        M.integrate(f, f + 1, 200, True)


def test_static_measures_closed_forms():
    for rho in (0.8, -0.8, 0.25, -0.25):
        c = np.array([[[1, rho], [rho, 1]]])
        want = -0.5 * math.log2(1 - rho * rho)
        assert G.total_correlation(c)[0] == pytest.approx(want) and G.dual_total_correlation(c)[0] == pytest.approx(want)
        assert G.pairwise_mutual_information(c)[0, 0, 1] == pytest.approx(want)
    ring = np.array([[[1, 0.55, 0.55], [0.55, 1, 0.55], [0.55, 0.55, 1]], [[1, 0, 1], [0, 1, 1], [1, 1, 2.5]]])
    o = G.o_information(ring)
    assert o[0] > 0.05 and o[1] < -0.1
    e = np.array([[[1.0, -1], [0, 2]]])
    assert G.log_likelihood(e, np.eye(2)[None])[0] == pytest.approx(-0.5 * (6 + 4 * math.log(2 * math.pi)))
    x = np.random.default_rng(0).standard_normal((1, 200_000, 2)) @ np.linalg.cholesky([[1, 0.6], [0.6, 1]]).T
    assert G.local_mutual_information(x, np.array([[[1, 0.6], [0.6, 1]]]), 1).mean() == pytest.approx(-0.5 * math.log2(0.64), abs=0.01)


def test_memory_identities(rates3):
    coef, sigma, m = rates3
    g = M.autocovariances(m, 20)
    assert D.cmem3_decomposition(g, 20).sum() == pytest.approx(D.cmem3_total(g[:, 0], sigma)[0])
    s = M.spectrum(m, FREQS)
    assert D.cmem1_full_past(m, s, FREQS) == pytest.approx(D.cmem1_full_past(m), abs=1e-10)
    iid = M.var_to_innovations(np.diag([0.45, 0.35, 0.25])[None, None], np.eye(3)[None])
    gi = M.autocovariances(iid, 2)
    assert D.cmem3_total(gi[:, 0], iid.v)[0] == pytest.approx(0, abs=1e-12) and D.cmem1_total(gi, iid.v, 1)[0] == pytest.approx(0, abs=1e-12)


def test_lattices_and_inversion():
    assert [len(P.lattice(k).nodes) for k in (1, 2, 3, 4)] == [1, 4, 18, 166]
    of = P.lattice(3)
    x = np.random.default_rng(1).standard_normal((2, 18))
    assert np.allclose(P.redundancies(P.atoms(x, of), of), x)


def test_integrated_decomposition_golden():
    want = [0.001805626776189453, 0, 0.005444158071368070, 0.039304917348183185, 0.005444158071368070, 0.060780989940456680, -0.005444158071368069, -0.037982556720401336, 0, 0, 0.039304917348183160, -0.039304917348183160, 0.042386286922428795, -0.042366013246665600, -0.039304917348183160, 0.082782318822364070]
    assert P.phi_id(SIGMA4)[0] == pytest.approx(want, abs=2e-10)
    a = P.phi_id(SIGMA4, kind="ccs", points=512)[0]
    assert (a[0], a[0] + a[1], a[0] + a[2]) == pytest.approx((0.0070837770283652245, 0.006236336055257821, 0.010983992296046484), abs=2e-11)
    a = P.phi_id(SIGMA4, kind="idep_a")[0]
    assert (a[0] + a[1], a[0] + a[2]) == pytest.approx((0.001785353100426254, 0.004168415273311892), abs=1e-10)


def test_rate_atoms_reconstruct(rates3):
    s = M.spectrum(rates3[2], FREQS)
    red, of = P.spectral_pird(s, [[0], [1]], [2])
    top = M.integrate(red[..., -1], FREQS)
    assert top == pytest.approx(R.mutual_information_rate(rates3[2], [0, 1], [2]), abs=1e-10)
    assert M.integrate(P.atoms(red, of), FREQS, axis=1).sum() == pytest.approx(top[0], abs=1e-10)


@pytest.mark.parametrize("kind", ["proxy", "spectral"])
def test_dependence_gradients(rates3, kind):
    rows = X.random_frames(3, 2, 3, 1)
    arg = X.proxy_sequence(rates3[2], 4) if kind == "proxy" else M.transfer(rates3[2], FREQS[::8])[0]
    f, g = (X.proxy, X.proxy_gradient) if kind == "proxy" else (X.spectral, X.spectral_gradient)
    d = X._tangent(rows, np.random.default_rng(0).standard_normal(rows.shape))
    eps = 1e-6
    num = (f(X.orthonormal(rows + eps * d), arg) - f(X.orthonormal(rows - eps * d), arg)) / (2 * eps)
    assert num == pytest.approx((g(rows, arg) * d).sum((-2, -1)), abs=1e-7)


@pytest.mark.parametrize("optimizer", ["adaptive", "armijo"])
def test_dependence_search_descends(rates3, optimizer):
    got = X.search(rates3[2], 1, runs=6, seed=1, points=65, max_iter=200, optimizer=optimizer)
    assert (np.diff(got["objective"]) >= 0).all()
    assert R.dynamical_dependence(rates3[2], got["rows"][0])[0] * math.log(2) == pytest.approx(got["objective"][0], abs=1e-3)


def test_clusters_and_distances():
    assert X.cluster(np.array([[0, 0.005, 1, 1], [0.005, 0, 1, 1], [1, 1, 0, 0.004], [1, 1, 0.004, 0]])) == ([0, 2], [2, 2])
    d = X.grassmann_distances(np.eye(3)[[0, 1, 0]][:, None])
    assert (d[0, 1], d[0, 2]) == pytest.approx((1, 0))


def test_emergence_of_all_channels_is_plain(rates3):
    g = M.autocovariances(rates3[2], 1)
    e = P.emergence(g[:, 0], g[:, 1], np.eye(3))
    assert e["macro"][0] == pytest.approx(G.mutual_information(P.past_future(g, [0, 1, 2]), 3)[0])
    assert P.emergence_full_past(rates3[2], np.eye(3))["macro"][0] == pytest.approx(D.predictive_information(rates3[2])[0])


def test_tests_and_selection():
    assert testing.significance([0.001, 0.01, 0.03, 0.20, np.nan]).tolist() == [True, True, True, False, False]
    assert testing.splits(200, folds=3, test=20, min_train=100, gap=5) == [(135, 140, 160), (155, 160, 180), (175, 180, 200)]
    assert testing.causality_pvalue(0.07, (2, 1, 1), 3, 400) == pytest.approx(special.f_sf(0.07 * 388 / 6, 6, 388))
    assert testing.causality_pvalue(0.07, (2, 1, 1), 3, 400, "chi2") == pytest.approx(special.chi2_sf(28, 6))
    with pytest.raises(ValueError):
        testing.causality_pvalue(0.07, (2, 1, 1), 3, 12)
    rho = np.array([0.9, 0.6, 0.05])
    best, svc = testing.bauer_order(rho, 2, 300)
    assert best == 2 and svc == pytest.approx([0.81, 0.36 + 4 * math.log(300) / 300, 0.0025 + 8 * math.log(300) / 300, 12 * math.log(300) / 300])
    assert testing.bauer_order(np.zeros(3), 2, 300)[0] == 1 and testing.bauer_order(np.zeros(3), 2, 300, 0)[0] == 0
    total, mean = testing.information_criteria(-60, 3, 20), testing.information_criteria(-3, 3, 20, likelihood="mean")
    assert total == mean and testing.information_criteria(-60, 3, 20, per_observation=True)["bic"] * 20 == pytest.approx(total["bic"])
    assert testing.pick_order([1, 2, 3], [1.0, 0.9, 0.89], [0.1, 0.1, 0.1], "one_se") == 2


def test_durbin_watson_law_is_that_of_the_difference_operator():
    rng = np.random.default_rng(46)
    x = rng.standard_normal((30, 2))
    d = np.diff(np.eye(30), axis=0)
    a = d.T @ d
    away = np.eye(30) - x @ np.linalg.solve(x.T @ x, x.T)
    mean = np.trace(away @ a) / 28
    second = 2 * (np.trace(away @ a @ away @ a) - 28 * mean**2) / (28 * 30)
    dx = d @ x
    got = testing.durbin_watson_law(x.T @ x, dx.T @ dx, dx[1:].T @ dx[:-1], 30)
    assert got == pytest.approx((mean, math.sqrt(second)))
    e = away @ rng.standard_normal((30, 20_000))
    dw = ((d @ e) ** 2).sum(0) / (e**2).sum(0)
    assert (dw.mean(), dw.std()) == pytest.approx(got, rel=0.02)
    assert testing.two_sided(mean, *got) == pytest.approx(1)


def test_dependency_redundancy_is_the_least_edge():
    """Against covariances that meet the constraints, found by fitting; and bounds that any redundancy keeps."""
    for seed in range(4):
        cov = systems.random_covariance(4, 1, 50 + seed)
        a, b, t = [0], [1], [2, 3]
        got = P.redundancy(cov, a, b, t, "dep")[0]
        mi = lambda c, x: G.mutual_information_of(c, x, t)[0]
        split = P._unlinked(cov, a, b, t)
        inv = np.linalg.inv(split[0])
        assert inv[0, 1] == pytest.approx(0, abs=1e-10)  # independent given t
        assert np.allclose(split[0][np.ix_([0, 2, 3], [0, 2, 3])], cov[0][np.ix_([0, 2, 3], [0, 2, 3])])
        unique = min(mi(cov, a), mi(cov, [0, 1]) - mi(cov, b), mi(split, [0, 1]) - mi(cov, b))
        assert got == pytest.approx(mi(cov, a) - unique) and -1e-12 <= got <= min(mi(cov, a), mi(cov, b)) + 1e-12


def test_iterations_that_do_not_converge_are_marked():
    a, q = np.array([[[0.99]], [[0.5]]]), np.ones((2, 1, 1))
    x = L.lyapunov(a, q, max_iter=3)
    assert np.isnan(x[0, 0, 0]) and x[1, 0, 0] == pytest.approx(4 / 3, rel=1e-3) or np.isnan(x).all()
    one = np.ones((1, 1, 1))
    assert np.isnan(L.dare(0.999 * one, 1e-6 * one, one, one, max_iter=2)).all()


def test_special_functions():
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05) and special.f_sf(4.102821015, 2, 10) == pytest.approx(0.05, abs=1e-7)
    assert special.norm_ppf(0.975) == pytest.approx(1.959963985)
    assert special.sobol(3, 2).tolist() == [[0.5, 0.5], [0.75, 0.25], [0.25, 0.75]]


def test_lempel_ziv():
    assert discrete.lempel_ziv("0001101001000101") == 6 and discrete.lempel_ziv("") == 0
    assert discrete.lempel_ziv([0] * 100) < discrete.lempel_ziv([0, 1] * 50)
    rng = np.random.default_rng(0)
    for _ in range(50):
        s = "".join(rng.choice(list("ab"), rng.integers(1, 40)))
        i = n = 0
        while i < len(s):
            k = 1
            while i + k <= len(s) and s[i : i + k] in s[: i + k - 1]:
                k += 1
            i, n = i + k, n + 1
        assert discrete.lempel_ziv(s) == n, s


def test_estimators():
    coef, sigma = np.array([[[[0.5, -0.2], [0.1, 0.4]]]]), np.array([[[2, 0.6], [0.6, 1]]])
    x = ident.simulate_var(coef, sigma, 4000, seed=3)
    ols, lwr = ident.fit_var(x, 1), ident.fit_lwr(x, 1)
    assert np.allclose(ols["coef"], coef, atol=0.05) and np.allclose(ols["coef"], lwr["coef"], atol=2e-3)
    line = np.array([[0, 1, 2, 3], [100, 101, 102, 103]], float)[..., None]
    pooled = ident.fit_var(line, 1, pooled=True)
    assert pooled["coef"].ravel() == pytest.approx([1]) and pooled["sigma"].ravel() == pytest.approx([0], abs=1e-20)
    a, c, q, r = ([[0.8]], [[1.0]], [[0.5]], [[1.0]])
    sys_ = [np.array(v) for v in (a, c, q, r)]
    y = ident.run_innovations(M.innovations_form(*(v[None] for v in sys_)), np.random.default_rng(0).standard_normal((1, 400, 1)))[0]
    cov, seen = np.eye(1), []
    for _ in range(8):
        e = ident.expectation(y, *sys_, cov)
        seen.append(e["loglik"])
        *sys_, cov = ident.maximisation(e)
    assert np.diff(seen).min() > -1e-6
    lar = ident.larimore(x, 2, 5)["model"]
    assert np.allclose(M.autocovariances(lar, 1), M.autocovariances(M.var_to_innovations(coef, sigma), 1), atol=0.12)


def test_systems():
    for s in systems.SYSTEMS:
        assert M.var_radius(systems.synthetic_var(s, 5, 0.7)[0])[0] == pytest.approx(0.7)
    c = systems.random_correlation(4, 3, 1)
    assert np.allclose(np.diagonal(c, axis1=1, axis2=2), 1) and (np.linalg.eigvalsh(c) > 0).all()
    matched = systems.match_information(*systems.random_var(3, 2, 2), 0.4)
    assert systems.total_information(matched, np.eye(2)[None].repeat(3, 0)) == pytest.approx([0.4] * 3)
    assert systems.mid_quantile(np.array([0, 1, 1, 2.0]), 1) == 0.5
    with pytest.raises(ValueError):
        systems.equicorrelated(3, -0.9)
