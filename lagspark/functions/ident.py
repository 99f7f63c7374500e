"""Estimation from arrays (series, time, channel), and filtering of single series.

`pooled` estimates one model from all series, otherwise each has its own; no
lag, window or transition ever crosses from one series into another.
"""

from __future__ import annotations

import math

import numpy as np

from . import linalg as L
from . import models as M
from . import systems


def lagged(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(design, targets): x_{t-1}, .., x_{t-p} per row, and x_t."""
    t = x.shape[1]
    return np.concatenate([x[:, order - k : t - k] for k in range(1, order + 1)], -1), x[:, order:]


def fit_var(x: np.ndarray, order: int, *, alpha: float = 0.0, intercept: bool = True, pooled: bool = False, unbiased: bool = True) -> dict:
    """Least squares or ridge (the intercept isn't penalised): coef, intercept, sigma, residuals."""
    s, _, n = x.shape
    z, y = lagged(x, order)
    if pooled:
        z, y = z.reshape(1, -1, n * order), y.reshape(1, -1, n)
    mz, my = (z.mean(1, keepdims=True), y.mean(1, keepdims=True)) if intercept else (np.zeros((1, 1, n * order)), np.zeros((1, 1, n)))
    zc, yc = z - mz, y - my
    if alpha:
        b = L.spd_solve(L.t(zc) @ zc + alpha * np.eye(n * order), L.t(zc) @ yc)
    else:
        b = np.stack([np.linalg.lstsq(p, q, rcond=None)[0] for p, q in zip(zc, yc)])
    res = yc - zc @ b
    rows = res.shape[1]
    sigma = L.symmetrise(L.t(res) @ res) / (rows - n * order - intercept if unbiased else rows)
    const = (my - mz @ b)[:, 0] if intercept else np.zeros((len(b), n))
    return {"coef": np.moveaxis(L.t(b).reshape(-1, n, order, n), 2, 1), "intercept": const, "sigma": sigma, "residuals": res.reshape(s, -1, n), "rows": rows}


def fit_lwr(x: np.ndarray, order: int, *, pooled: bool = False, unbiased: bool = True) -> dict:
    """Lattice estimate: forward and backward errors are whitened lag by lag.

    Windows run over zero-padded edges only in the first covariance; the
    covariance of residuals divides by one less than their number if unbiased.
    """
    groups = [x] if pooled else [x[i : i + 1] for i in range(len(x))]
    out = [_lwr(g, order, unbiased) for g in groups]
    return {k: np.concatenate([o[k] for o in out]) for k in out[0]}


def _lwr(x: np.ndarray, order: int, unbiased: bool) -> dict:
    s, t, n = x.shape
    mean = x.mean((0, 1))
    c = x - mean
    # past[k] holds x_{t-k} at times k..t-1.
    inv = np.linalg.inv(np.linalg.cholesky(np.einsum("sti,stj->ij", c, c)))
    fw, bw = [inv], [inv]  # weights of x_t, x_{t-1}, ..; those of the backward error end at the oldest
    lag = lambda k, a, b: c[:, a - k : b - k]
    flat = lambda e: e.reshape(-1, n).T
    for k in range(1, order + 1):
        f = sum(flat(lag(i, k, t)) .T @ w.T for i, w in enumerate(fw))
        b = sum(flat(lag(i + 1, k, t)).T @ w.T for i, w in enumerate(bw))
        lf, lb = np.linalg.cholesky(f.T @ f), np.linalg.cholesky(b.T @ b)
        r = np.linalg.solve(lf, f.T) @ np.linalg.solve(lb, b.T).T
        nf, nb = np.linalg.cholesky(np.eye(n) - r @ r.T), np.linalg.cholesky(np.eye(n) - r.T @ r)
        zero = np.zeros((n, n))
        f_old, b_old = [*fw, zero], [zero, *bw]
        fw = [np.linalg.solve(nf, p - r @ q) for p, q in zip(f_old, b_old)]
        bw = [np.linalg.solve(nb, q - r.T @ p) for p, q in zip(f_old, b_old)]
    head = fw[0]
    coef = np.stack([-np.linalg.solve(head, w) for w in fw[1:]])
    res = c[:, order:] - sum(lag(k + 1, order, t) @ a.T for k, a in enumerate(coef))
    rows = s * (t - order)
    sigma = np.einsum("sti,stj->ij", res, res) / (rows - 1 if unbiased else rows)
    return {"coef": coef[None], "intercept": (mean - coef.sum(0) @ mean)[None], "sigma": sigma[None], "residuals": res}


def predict(x: np.ndarray, coef: np.ndarray, intercept: np.ndarray) -> np.ndarray:
    """One-step predictions of x_t for t > p; one model for all series, or one each."""
    order = coef.shape[1]
    z, _ = lagged(x, order)
    return z @ L.t(np.moveaxis(coef, 1, 2).reshape(len(coef), coef.shape[-1], -1)) + intercept[:, None]


def forecast(history: np.ndarray, coef: np.ndarray, intercept: np.ndarray, steps: int) -> np.ndarray:
    order, past = coef.shape[1], list(np.moveaxis(history, 1, 0))
    for _ in range(steps):
        past.append(intercept + sum(np.einsum("bij,bj->bi", np.broadcast_to(coef[:, k], (len(history), *coef.shape[2:])), past[-1 - k]) for k in range(order)))
    return np.stack(past[-steps:], 1)


def kalman(y: np.ndarray, a, c, q, r, mean=None, cov=None) -> dict:
    """Filter one series (time, channel); the first step predicts from the initial state."""
    d, n = a.shape[-1], y.shape[-1]
    m = np.zeros(d) if mean is None else mean
    p = np.eye(d) if cov is None else cov
    out = {k: [] for k in ("pred_mean", "pred_cov", "mean", "cov", "innovation")}
    loglik = 0.0
    for v in y:
        m, p = a @ m, L.symmetrise(a @ p @ a.T + q)
        s = L.symmetrise(c @ p @ c.T + r)
        e = v - c @ m
        gain = L.spd_solve(s, c @ p).T
        out["pred_mean"].append(m)
        out["pred_cov"].append(p)
        out["innovation"].append(e)
        loglik -= 0.5 * float(e @ L.spd_solve(s, e[:, None])[:, 0] + L.logdet(s) + n * math.log(2 * math.pi))
        m = m + gain @ e
        left = np.eye(d) - gain @ c
        p = L.symmetrise(left @ p @ left.T + gain @ r @ gain.T)
        out["mean"].append(m)
        out["cov"].append(p)
    return {k: np.stack(v) for k, v in out.items()} | {"loglik": loglik}


def smooth(y: np.ndarray, a, c, q, r, mean=None, cov=None) -> dict:
    """Rauch-Tung-Striebel pass: smoothed means, covariances and lag-one covariances."""
    f = kalman(y, a, c, q, r, mean, cov)
    t = len(y)
    m, p = f["mean"].copy(), f["cov"].copy()
    cross = np.zeros((max(t - 1, 0), *p.shape[1:]))
    for i in range(t - 2, -1, -1):
        g = np.linalg.solve(f["pred_cov"][i + 1], a @ f["cov"][i]).T
        m[i] = f["mean"][i] + g @ (m[i + 1] - f["pred_mean"][i + 1])
        p[i] = L.symmetrise(f["cov"][i] + g @ (p[i + 1] - f["pred_cov"][i + 1]) @ g.T)
        cross[i] = p[i + 1] @ g.T
    return {"mean": m, "cov": p, "cross": cross, "loglik": f["loglik"]}


def expectation(y: np.ndarray, a, c, q, r, cov) -> dict:
    """Sums that the maximisation step of one series needs."""
    s = smooth(y, a, c, q, r, None, cov)
    second = s["cov"] + np.einsum("ti,tj->tij", s["mean"], s["mean"])
    cross = s["cross"] + np.einsum("ti,tj->tij", s["mean"][1:], s["mean"][:-1])
    return {"all": second.sum(0), "before": second[:-1].sum(0), "after": second[1:].sum(0), "cross": cross.sum(0), "yz": y.T @ s["mean"], "yy": y.T @ y, "rows": len(y), "series": 1, "loglik": s["loglik"]}


def _floor(cov: np.ndarray, least: float) -> np.ndarray:
    w, v = np.linalg.eigh(L.symmetrise(cov))
    return (v * np.maximum(w, least)) @ v.T


def maximisation(e: dict, least: float = 1e-8) -> tuple:
    """(A, C, Q, R, state covariance) from sums of expectations over series."""
    a = e["cross"] @ np.linalg.pinv(e["before"])
    c = e["yz"] @ np.linalg.pinv(e["all"])
    q = (e["after"] - a @ e["cross"].T - e["cross"] @ a.T + a @ e["before"] @ a.T) / (e["rows"] - e["series"])
    r = (e["yy"] - c @ e["yz"].T - e["yz"] @ c.T + c @ e["all"] @ c.T) / e["rows"]
    return a, c, _floor(q, least), _floor(r, least), e["all"] / e["rows"]


def hankel(x: np.ndarray, past: int, future: int) -> tuple[np.ndarray, np.ndarray]:
    """(series, past * n, columns), newest past first, and (series, future * n, columns)."""
    t = x.shape[1]
    cols = range(past, t - future + 1)
    p = np.stack([np.concatenate([x[:, i - k] for k in range(1, past + 1)], -1) for i in cols], -1)
    f = np.stack([np.concatenate([x[:, i + k] for k in range(future)], -1) for i in cols], -1)
    return p, f


def _centre(x: np.ndarray) -> np.ndarray:
    return x - x.mean(1, keepdims=True)


def _join(p: np.ndarray) -> np.ndarray:
    return np.moveaxis(p, 0, 1).reshape(p.shape[1], -1)


def canonical(past: np.ndarray, future: np.ndarray, ridge: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """Canonical correlations of future and past, and the map from past to scaled states."""
    n = past.shape[-1]
    lp = np.linalg.cholesky(past @ past.T / n + ridge * np.eye(len(past)))
    lf = np.linalg.cholesky(future @ future.T / n + ridge * np.eye(len(future)))
    cross = np.linalg.solve(lp, np.linalg.solve(lf, future @ past.T / n).T).T
    _, rho, v = np.linalg.svd(cross, full_matrices=False)
    return rho, rho[:, None] * np.linalg.solve(lp.T, v.T).T


def larimore(x: np.ndarray, states: int, past: int, future: int | None = None, ridge: float = 1e-12, floor: float = 1e-12) -> dict:
    """Canonical variate estimate pooled over series: an innovations model and the correlations."""
    x = _centre(x)
    p, f = hankel(x, past, future or past)
    rho, to_state = canonical(_join(p), _join(f), ridge)
    if states > len(rho):
        raise ValueError("more states than the windows identify")
    z = np.einsum("rp,spc->scr", to_state[:states], p)
    y = x[:, past : past + z.shape[1]]
    fit = lambda u, v: np.linalg.lstsq(u.reshape(-1, u.shape[-1]), v.reshape(-1, v.shape[-1]), rcond=None)[0].T
    c = fit(z, y)
    e = y - z @ c.T
    a = fit(z[:, :-1], z[:, 1:])
    k = fit(e[:, :-1], z[:, 1:] - z[:, :-1] @ a.T)
    flat = e.reshape(-1, e.shape[-1])
    return {"model": M.Innovations(a[None], c[None], k[None], _floor(flat.T @ flat / len(flat), floor)[None]), "correlations": rho, "columns": z.shape[0] * z.shape[1]}


def n4sid(x: np.ndarray, states: int, rows: int, ridge: float = 1e-10) -> dict:
    """Subspace estimate pooled over series: (A, C, Q, R) and singular values."""
    x = _centre(x)
    p, f = hankel(x, rows, rows)
    pj, fj = _join(p), _join(f)
    # The singular values of F P' (P P' + r I)^+ P come from a small matrix, not one with all columns.
    gram = pj @ pj.T
    map_ = fj @ pj.T @ np.linalg.pinv(gram + ridge * np.eye(len(gram)))
    w, u = np.linalg.eigh(L.symmetrise(map_ @ gram @ map_.T))
    s, u = np.sqrt(np.maximum(w[::-1], 0)), u[:, ::-1]
    obs = u[:, :states] * np.sqrt(s[:states])
    z = np.einsum("rf,sfc->scr", np.linalg.pinv(obs), f)
    y = x[:, rows : rows + z.shape[1]]
    fit = lambda q, v: np.linalg.lstsq(q.reshape(-1, q.shape[-1]), v.reshape(-1, v.shape[-1]), rcond=None)[0].T
    a, c = fit(z[:, :-1], z[:, 1:]), fit(z, y)
    cov = lambda e: np.cov(e.reshape(-1, e.shape[-1]), rowvar=False).reshape(e.shape[-1], -1)
    q, r = cov(z[:, 1:] - z[:, :-1] @ a.T), cov(y - z @ c.T)
    least = max(ridge, 1e-12)
    return {"system": (a, c, _floor(q, least), _floor(r, least)), "singular_values": s, "state_covariance": cov(z)}


def innovations(y: np.ndarray, m: M.Innovations) -> np.ndarray:
    """Steady-state one-step errors of series (series, time, channel) from a zero state."""
    a, c, k = m.a[0], m.c[0], m.k[0]
    x, out = np.zeros((len(y), a.shape[-1])), []
    for v in np.moveaxis(y, 1, 0):
        e = v - x @ c.T
        out.append(e)
        x = x @ a.T + e @ k.T
    return np.stack(out, 1)


def simulate_var(coef: np.ndarray, sigma: np.ndarray, times: int, *, burn: int | None = 500, seed: int = 0, intercept: np.ndarray | None = None, keys=None, shocks: bool = False):
    """(batch, times, n) Gaussian trajectories, and with shocks their innovations.

    Every item has a stream of its own, by seed and its key (its number if
    none).  burn None takes as many steps as a model needs to forget its start.
    """
    b, p, n, _ = coef.shape
    low = L.stable_cholesky(np.broadcast_to(sigma, (b, n, n)))
    x, e = np.empty((b, times, n)), np.empty((b, times, n))
    for i, key in enumerate(range(b) if keys is None else keys):
        first = systems.automatic_burnin(coef[i : i + 1]) if burn is None else burn
        noise = np.random.Generator(np.random.Philox(key=[seed, key])).standard_normal((1, times + first, n)) @ L.t(low[i])
        x[i] = run_var(coef[i : i + 1], np.zeros((1, p, n)), noise, None if intercept is None else intercept[i])[0, p + first :]
        e[i] = noise[0, first:]
    return (x, e) if shocks else x


def run_var(coef: np.ndarray, start: np.ndarray, shocks: np.ndarray, intercept: np.ndarray | None = None) -> np.ndarray:
    """Recursion from the first p rows; returns them and what follows."""
    b, p, n, _ = coef.shape
    x = np.concatenate([start, shocks], 1)
    for t in range(p, x.shape[1]):
        for k in range(p):
            x[:, t] += np.einsum("bij,bj->bi", coef[:, k], x[:, t - 1 - k])
        if intercept is not None:
            x[:, t] += intercept
    return x


def run_innovations(m: M.Innovations, shocks: np.ndarray) -> np.ndarray:
    x, out = np.zeros((len(shocks), m.a.shape[-1])), []
    for e in np.moveaxis(shocks, 1, 0):
        out.append(np.einsum("bij,bj->bi", np.broadcast_to(m.c, (len(shocks), *m.c.shape[1:])), x) + e)
        x = np.einsum("bij,bj->bi", np.broadcast_to(m.a, (len(shocks), *m.a.shape[1:])), x) + np.einsum("bij,bj->bi", np.broadcast_to(m.k, (len(shocks), *m.k.shape[1:])), e)
    return np.stack(out, 1)
