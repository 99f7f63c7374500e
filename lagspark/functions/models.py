"""Linear Gaussian models and conversions between their forms, batch first.

A VAR has coefficients (batch, lag, target, source) and an innovation
covariance; a state-space model has (A, C, Q, R); the innovations form
x+ = Ax + Ke, y = Cx + e with covariance V is what nearly all measures take.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import linalg as L


@dataclass(frozen=True)
class Innovations:
    a: np.ndarray
    c: np.ndarray
    k: np.ndarray
    v: np.ndarray

    @property
    def n(self) -> int:
        return self.c.shape[-2]

    def state_covariance(self) -> np.ndarray:
        return L.lyapunov(self.a, self.k @ self.v @ L.t(self.k))

    def take(self, mask) -> "Innovations":
        return Innovations(self.a[mask], self.c[mask], self.k[mask], self.v[mask])


def companion(coef: np.ndarray) -> np.ndarray:
    """(batch, p, n, n) to the companion matrices (batch, np, np)."""
    b, p, n, _ = coef.shape
    out = np.zeros((b, n * p, n * p))
    out[:, :n] = np.moveaxis(coef, 1, 2).reshape(b, n, n * p)
    out[:, np.arange(n, n * p), np.arange(n * (p - 1))] = 1
    return out


def var_radius(coef: np.ndarray) -> np.ndarray:
    return L.spectral_radius(companion(coef))


def var_state_covariance(coef: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    n = coef.shape[-1]
    a = companion(coef)
    q = np.zeros_like(a)
    q[:, :n, :n] = sigma
    return L.lyapunov(a, q)


def var_to_innovations(coef: np.ndarray, sigma: np.ndarray) -> Innovations:
    """Exact: the state is the last p observations, so no Riccati equation."""
    b, p, n, _ = coef.shape
    a = companion(coef)
    k = np.zeros((b, n * p, n))
    k[:, :n] = np.eye(n)
    return Innovations(a, a[:, :n].copy(), k, np.broadcast_to(sigma, (b, n, n)))


def var_to_state_space(coef: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, ...]:
    """(A, C, Q, R) with no observation noise: y_t is the head of the state."""
    b, p, n, _ = coef.shape
    a = companion(coef)
    c = np.zeros((b, n, n * p))
    c[:, :, :n] = np.eye(n)
    q = np.zeros_like(a)
    q[:, :n, :n] = sigma
    return a, c, q, np.zeros((b, n, n))


def innovations_form(a: np.ndarray, c: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray | None = None) -> Innovations:
    p = L.dare(a, c, q, r, s)
    v = L.symmetrise(c @ p @ L.t(c) + r)
    gain = a @ p @ L.t(c) + (0 if s is None else s)
    return Innovations(np.broadcast_to(a, (*p.shape[:-2], *a.shape[-2:])), np.broadcast_to(c, (*p.shape[:-2], *c.shape[-2:])), L.t(L.spd_solve(v, L.t(gain))), v)


def project(m: Innovations, rows: np.ndarray) -> Innovations:
    """Innovations form of the projected process L y: one Riccati equation with cross-covariance."""
    rows = np.asarray(rows, float)
    if not np.isfinite(rows).all() or np.linalg.matrix_rank(rows).min() < rows.shape[-2]:
        raise ValueError("a projection needs finite entries and full row rank")
    kv = m.k @ m.v
    return innovations_form(m.a, rows @ m.c, L.symmetrise(kv @ L.t(m.k)), L.symmetrise(rows @ m.v @ L.t(rows)), kv @ L.t(rows))


def reduce(m: Innovations, keep) -> Innovations:
    """Marginal model of some channels."""
    keep = list(keep)
    return m if keep == list(range(m.n)) else project(m, np.eye(m.n)[keep])


def scale(m: Innovations, factor: np.ndarray | float) -> Innovations:
    """A times factor with the same driving noise; rows at or beyond a radius of one are NaN."""
    factor = np.broadcast_to(np.asarray(factor, float), m.a.shape[:1])
    if (factor < 0).any():
        raise ValueError("a factor is at least 0")
    a = m.a * factor[:, None, None]
    kv = m.k @ m.v
    out = innovations_form(a, m.c, L.symmetrise(kv @ L.t(m.k)), m.v, kv)
    bad = (L.spectral_radius(a) >= 1)[:, None, None]
    return Innovations(*(np.where(bad, np.nan, x) for x in (out.a, out.c, out.k, out.v)))


def downsample(m: Innovations, step: int) -> Innovations:
    """Exact model of every step-th sample."""
    if step < 1:
        raise ValueError("a step is at least 1")
    if step == 1:
        return m
    kv = m.k @ m.v
    one = L.symmetrise(kv @ L.t(m.k))
    power, q = np.broadcast_to(np.eye(m.a.shape[-1]), m.a.shape), np.zeros_like(one)
    for i in range(step):
        q = q + power @ one @ L.t(power)
        before, power = power, m.a @ power
    return innovations_form(power, m.c, L.symmetrise(q), m.v, before @ kv)


def varma_to_innovations(ar: np.ndarray, ma: np.ndarray, sigma: np.ndarray, zero_lag: np.ndarray | None = None) -> Innovations:
    """VARMA (batch, p, n, n), (batch, q, n, n): the state holds p outputs and q shocks."""
    b, p, n, _ = ar.shape
    q = ma.shape[1]
    b0 = np.broadcast_to(np.eye(n) if zero_lag is None else zero_lag, (b, n, n))
    size = n * (p + q)
    a, c, k = np.zeros((b, size, size)), np.zeros((b, n, size)), np.zeros((b, size, n))
    inv = np.linalg.inv(b0)
    c[:, :, : n * p] = np.moveaxis(ar, 1, 2).reshape(b, n, n * p)
    # Shocks are kept as innovations b0 e, so moving-average terms act on b0^-1 of them.
    c[:, :, n * p :] = np.moveaxis(ma @ inv[:, None], 1, 2).reshape(b, n, n * q)
    if p:
        a[:, :n] = c
        k[:, :n] = np.eye(n)
        a[:, np.arange(n, n * p), np.arange(n * (p - 1))] = 1
    if q:
        k[:, n * p : n * (p + 1)] = np.eye(n)
        a[:, np.arange(n * (p + 1), size), np.arange(n * p, size - n)] = 1
    return Innovations(a, c, k, L.symmetrise(b0 @ sigma @ L.t(b0)))


def autocovariances(m: Innovations, max_lag: int) -> np.ndarray:
    """(batch, max_lag + 1, n, n): cov(y_t, y_{t - lag})."""
    p = m.state_covariance()
    out = [L.symmetrise(m.c @ p @ L.t(m.c) + m.v)]
    cross = m.a @ p @ L.t(m.c) + m.k @ m.v
    for _ in range(max_lag):
        out.append(m.c @ cross)
        cross = m.a @ cross
    return np.stack(out, 1)


def transfer(m: Innovations, freqs: np.ndarray) -> np.ndarray:
    """(batch, freq, n, n) transfer function at normalised frequencies."""
    z = np.exp(2j * np.pi * np.asarray(freqs))[:, None, None]
    left = z * np.eye(m.a.shape[-1]) - m.a[:, None]
    return np.eye(m.n) + m.c[:, None] @ np.linalg.solve(left, np.broadcast_to(m.k[:, None].astype(complex), (*left.shape[:-1], m.n)))


def inverse_transfer(m: Innovations, freqs: np.ndarray) -> np.ndarray:
    """The inverse, from the model that maps outputs to innovations."""
    z = np.exp(2j * np.pi * np.asarray(freqs))[:, None, None]
    left = z * np.eye(m.a.shape[-1]) - (m.a - m.k @ m.c)[:, None]
    return np.eye(m.n) - m.c[:, None] @ np.linalg.solve(left, np.broadcast_to(m.k[:, None].astype(complex), (*left.shape[:-1], m.n)))


def var_inverse_transfer(coef: np.ndarray, freqs: np.ndarray) -> np.ndarray:
    lags = np.arange(1, coef.shape[1] + 1)
    phase = np.exp(-2j * np.pi * np.outer(np.asarray(freqs), lags))
    return np.eye(coef.shape[-1]) - np.einsum("fl,blij->bfij", phase, coef)


def spectrum(m: Innovations, freqs: np.ndarray, fs: float = 1.0) -> np.ndarray:
    """(batch, freq, n, n) cross-spectral density at physical frequencies in [0, fs / 2]."""
    freqs = np.asarray(freqs, float)
    if freqs.ndim != 1 or not len(freqs) or freqs.min() < 0 or freqs.max() > fs / 2 * (1 + 1e-12):
        raise ValueError("frequencies lie in [0, fs / 2]")
    hf = transfer(m, freqs / fs)
    return L.hermitian_part(hf @ m.v[:, None] @ L.h(hf)) / fs


def integrate(values: np.ndarray, freqs: np.ndarray, fs: float = 1.0, half_open: bool = False, axis: int = -1) -> np.ndarray:
    """Mean over frequency of a rate: trapezoid over [0, fs / 2], or the mean over a half-open uniform grid."""
    freqs = np.asarray(freqs, float)
    values = np.moveaxis(np.asarray(values), axis, -1)
    if half_open:
        n = len(freqs)
        if not np.allclose(freqs, np.arange(n) * fs / (2 * n)):
            raise ValueError("a half-open grid is uniform from 0 with spacing fs / 2n")
        return values.mean(-1)
    return ((values[..., 1:] + values[..., :-1]) / 2 * np.diff(freqs)).sum(-1) * 2 / fs
