"""Dynamics, spectra and predictive memory of innovations models."""

from __future__ import annotations

import math

import numpy as np

from . import gaussian as G
from . import linalg as L
from . import models as M


def entropy_rate(m: M.Innovations, base: float = 2.0) -> np.ndarray:
    return G.entropy(m.v, base)


def predictive_information(m: M.Innovations, base: float = 2.0, gamma0: np.ndarray | None = None) -> np.ndarray:
    gamma0 = M.autocovariances(m, 0)[:, 0] if gamma0 is None else gamma0
    return 0.5 * (L.logdet(gamma0) - L.logdet(m.v)) / math.log(base)


def covariance_amplification(m: M.Innovations) -> np.ndarray:
    return np.trace(M.autocovariances(m, 0)[:, 0], axis1=-2, axis2=-1) / np.trace(m.v, axis1=-2, axis2=-1)


def stability_margin(radius: np.ndarray) -> np.ndarray:
    return 1 - radius


def dominant_timescale(radius: np.ndarray, dt: float = 1.0) -> np.ndarray:
    tiny = np.finfo(float).tiny
    r = np.clip(radius, tiny, 1 - np.finfo(float).eps)
    return np.where(radius <= tiny, 0.0, -dt / np.log(r))


def history_covariance(gamma: np.ndarray, lags: int) -> np.ndarray:
    """Block Toeplitz covariance of (x_t, x_{t-1}, .., x_{t-lags}) from gamma (batch, lag, n, n)."""
    blocks = [[gamma[:, j - i] if j >= i else L.t(gamma[:, i - j]) for j in range(lags + 1)] for i in range(lags + 1)]
    return L.symmetrise(np.concatenate([np.concatenate(row, -1) for row in blocks], -2))


def finite_lag_ais(gamma: np.ndarray, lag: int = 1, base: float = 2.0) -> np.ndarray:
    """(batch, n): each channel's information about itself from its last `lag` values."""
    own = np.moveaxis(np.diagonal(gamma, axis1=-2, axis2=-1), -1, 1)  # batch, n, lag
    b, n, _ = own.shape
    cov = history_covariance(own.reshape(b * n, -1, 1, 1), lag)
    return G.mutual_information(cov, 1, base).reshape(b, n)


def spectral_entropy(spectrum: np.ndarray, normalise: bool = True) -> np.ndarray:
    """(batch, n) entropy in bits of each channel's normalised power over the grid."""
    power = np.diagonal(spectrum, axis1=-2, axis2=-1).real
    p = power / power.sum(-2, keepdims=True)
    h = -np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0).sum(-2)
    return h / math.log2(spectrum.shape[-3]) if normalise else h


def spectral_entropy_rate(spectrum: np.ndarray, fs: float = 1.0, base: float = 2.0) -> np.ndarray:
    n = spectrum.shape[-1]
    return 0.5 * (n * math.log(2 * math.pi * math.e * fs) + L.logdet(spectrum)) / math.log(base)


def marginal_innovation_variance(m: M.Innovations, channel: int, spectrum: np.ndarray | None = None, freqs=None, fs: float = 1.0, half_open: bool = False) -> np.ndarray:
    """Innovation variance of one channel alone: by a Riccati equation, or from its spectrum (Szego)."""
    if spectrum is None:
        return M.reduce(m, [channel]).v[:, 0, 0]
    return np.exp(M.integrate(np.log(spectrum[..., channel, channel].real * fs), freqs, fs, half_open))


def marginal_entropy_rate(m: M.Innovations, base: float = 2.0, spectrum: np.ndarray | None = None, freqs=None, fs: float = 1.0, half_open: bool = False) -> np.ndarray:
    v = np.stack([marginal_innovation_variance(m, i, spectrum, freqs, fs, half_open) for i in range(m.n)], -1)
    return 0.5 * np.log(2 * math.pi * math.e * v) / math.log(base)


# Predictive memory, always in bits.


def cmem3_total(gamma0: np.ndarray, v: np.ndarray) -> np.ndarray:
    return G.total_correlation(v) - G.total_correlation(gamma0)


def cmem1_total(gamma: np.ndarray, v: np.ndarray, history: int) -> np.ndarray:
    full = 0.5 * (L.logdet(gamma[:, 0]) - L.logdet(v)) / math.log(2)
    return full - finite_lag_ais(gamma, history).sum(-1)


def cmem1_full_past(m: M.Innovations, spectrum: np.ndarray | None = None, freqs=None, fs: float = 1.0, half_open: bool = False, base: float = 2.0) -> np.ndarray:
    gamma0 = M.autocovariances(m, 0)[:, 0]
    var = np.diagonal(gamma0, axis1=-2, axis2=-1)
    own = 0.5 * np.log(2 * math.pi * math.e * var) / math.log(base) - marginal_entropy_rate(m, base, spectrum, freqs, fs, half_open)
    return predictive_information(m, base, gamma0) - own.sum(-1)


def cmem3_curve(gamma: np.ndarray, most: int) -> np.ndarray:
    """(batch, most): total correlation given the state tau steps back, less the total correlation."""
    g0 = gamma[:, 0]
    out = []
    for tau in range(1, most + 1):
        g = gamma[:, tau]
        out.append(G.total_correlation(L.symmetrise(g0 - g @ L.spd_solve(g0, L.t(g)))) - G.total_correlation(g0))
    return np.stack(out, -1)


def cmem1_curve(gamma: np.ndarray, most: int) -> np.ndarray:
    g0, n = gamma[:, 0], gamma.shape[-1]
    out = []
    for tau in range(1, most + 1):
        g = gamma[:, tau]
        joint = np.concatenate([np.concatenate([g0, g], -1), np.concatenate([L.t(g), g0], -1)], -2)
        rho = np.diagonal(g, axis1=-2, axis2=-1) / np.diagonal(g0, axis1=-2, axis2=-1)
        out.append(G.mutual_information(joint, n) + 0.5 * np.log2(1 - rho * rho).sum(-1))
    return np.stack(out, -1)


def cmem3_decomposition(gamma: np.ndarray, most: int) -> np.ndarray:
    """(batch, most) contributions of each lag given the nearer ones; they sum to the total over these lags."""
    n = gamma.shape[-1]
    before, out = G.total_correlation(gamma[:, 0]), []
    for lag in range(1, most + 1):
        now = G.total_correlation(G.conditional_covariance(history_covariance(gamma, lag), n))
        out.append(now - before)
        before = now
    return np.stack(out, -1)
