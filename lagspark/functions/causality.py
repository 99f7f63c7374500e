"""Granger causality and information rates of innovations models; nats unless another base is given."""

from __future__ import annotations

import math

import numpy as np

from . import gaussian as G
from . import linalg as L
from . import models as M


def _others(n: int, *groups) -> list[int]:
    used = {i for g in groups for i in g}
    return [i for i in range(n) if i not in used]


def temporal_mvgc(m: M.Innovations, source, target, conditional=None, base: float = math.e) -> np.ndarray:
    """log of target innovation determinants without and with the source; None: given all other channels."""
    source, target = list(source), list(target)
    given = _others(m.n, source, target) if conditional is None else list(conditional)
    full, less = M.reduce(m, [*target, *given, *source]), M.reduce(m, [*target, *given])
    head = list(range(len(target)))
    return (L.logdet(L.sub(less.v, head)) - L.logdet(L.sub(full.v, head))) / math.log(base)


def pairwise_temporal_mvgc(m: M.Innovations, base: float = math.e) -> np.ndarray:
    """(batch, source, target), one reduction for each source; zero diagonal."""
    n = m.n
    out = np.zeros((m.v.shape[0], n, n))
    full = np.log(np.diagonal(m.v, axis1=-2, axis2=-1))
    for s in range(n if n > 1 else 0):
        keep = [i for i in range(n) if i != s]
        out[:, s, keep] = np.log(np.diagonal(M.reduce(m, keep).v, axis1=-2, axis2=-1)) - full[:, keep]
    return out / math.log(base)


def maximum_temporal_mvgc(m: M.Innovations, base: float = math.e) -> np.ndarray:
    return pairwise_temporal_mvgc(m, base).max((-2, -1))


def spectral_mvgc(m: M.Innovations, source, target, freqs, conditional=None, base: float = math.e) -> np.ndarray:
    """(batch, freq) conditional spectral causality at normalised frequencies."""
    source, target = list(source), list(target)
    given = _others(m.n, source, target) if conditional is None else list(conditional)
    nt, nc, ns = len(target), len(given), len(source)
    full, less = M.reduce(m, [*target, *given, *source]), M.reduce(m, [*target, *given])
    drivers = [*range(nt + nc, nt + nc + ns), *range(nt, nt + nc)]
    part = G.schur(full.v, drivers, list(range(nt)))
    row = M.inverse_transfer(less, freqs)[..., :nt, :]
    cols = M.transfer(full, freqs)[..., : nt + nc, :][..., drivers]
    q = row @ cols @ L.stable_cholesky(part)[:, None]
    base_v = L.sub(less.v, list(range(nt)))
    return (L.logdet(base_v)[:, None] - L.logdet(base_v[:, None] - q @ L.h(q))) / math.log(base)


def pairwise_spectral_gc(m: M.Innovations, source, target, freqs, base: float = math.e) -> np.ndarray:
    """(batch, freq) bivariate Geweke causality between two groups."""
    return spectral_mvgc(m, source, target, freqs, conditional=(), base=base)


def mutual_information_rate(m: M.Innovations, left, right, base: float = math.e) -> np.ndarray:
    left, right = list(left), list(right)
    parts = [M.reduce(m, g).v for g in (left, right, [*left, *right])]
    return 0.5 * (L.logdet(parts[0]) + L.logdet(parts[1]) - L.logdet(parts[2])) / math.log(base)


def transfer_entropy_rate(m: M.Innovations, source, target, base: float = math.e) -> np.ndarray:
    return 0.5 * temporal_mvgc(m, source, target, conditional=(), base=base)


def instantaneous_rate(m: M.Innovations, left, right, base: float = math.e) -> np.ndarray:
    joint = M.reduce(m, [*left, *right]).v
    return G.mutual_information(joint, len(list(left)), base)


def spectral_mutual_information_rate(spectrum: np.ndarray, left, right, base: float = math.e) -> np.ndarray:
    left, right = list(left), list(right)
    return 0.5 * (L.logdet(L.sub(spectrum, left)) + L.logdet(L.sub(spectrum, right)) - L.logdet(L.sub(spectrum, [*left, *right]))) / math.log(base)


def spectral_transfer_entropy_rate(m: M.Innovations, source, target, freqs, fs: float = 1.0, base: float = math.e) -> np.ndarray:
    """(batch, freq); innovations aren't orthogonalised."""
    source, target = list(source), list(target)
    pair = M.reduce(m, [*target, *source])
    head = list(range(len(target)))
    s = L.sub(M.spectrum(pair, freqs, fs), head)
    own = L.sub(M.transfer(pair, np.asarray(freqs) / fs), head)
    alone = own @ L.sub(pair.v, head)[:, None] @ L.h(own) / fs
    return 0.5 * (L.logdet(s) - L.logdet(alone)) / math.log(base)


def pairwise_mutual_information_rate(m: M.Innovations, base: float = math.e, spectrum=None, freqs=None, fs: float = 1.0, half_open: bool = False) -> np.ndarray:
    n = m.n
    out = np.zeros((m.v.shape[0], n, n))
    for i in range(n):
        for j in range(i + 1, n):
            if spectrum is None:
                v = mutual_information_rate(m, [i], [j], base)
            else:
                v = M.integrate(spectral_mutual_information_rate(spectrum, [i], [j], base), freqs, fs, half_open)
            out[:, i, j] = out[:, j, i] = v
    return out


def mean_pairwise_rate(matrix: np.ndarray) -> np.ndarray:
    n = matrix.shape[-1]
    i, j = np.triu_indices(n, 1)
    return matrix[..., i, j].mean(-1) if n > 1 else np.zeros(matrix.shape[:-2])


def _groups(n: int, groups) -> list[list[int]]:
    out = [[i] for i in range(n)] if groups is None else [list(g) for g in groups]
    flat = [i for g in out for i in g]
    if len(out) < 2 or not all(out) or len(set(flat)) != len(flat) or not set(flat) <= set(range(n)):
        raise ValueError("two or more disjoint groups of channels that aren't empty")
    return out


def _o_information(value, groups) -> np.ndarray:
    """value(indices) is a log determinant."""
    everything = [i for g in groups for i in g]
    out = (len(groups) - 2) * value(everything)
    for g in groups:
        out = out + value(g) - value([i for i in everything if i not in g])
    return 0.5 * out


def o_information_rate(m: M.Innovations, groups=None, base: float = math.e) -> np.ndarray:
    groups = _groups(m.n, groups)
    return _o_information(lambda g: L.logdet(M.reduce(m, sorted(g)).v), groups) / math.log(base)


def spectral_o_information_rate(spectrum: np.ndarray, groups=None, base: float = math.e) -> np.ndarray:
    groups = _groups(spectrum.shape[-1], groups)
    return _o_information(lambda g: L.logdet(L.sub(spectrum, sorted(g))), groups) / math.log(base)


def _delta(mi, target: int, groups) -> np.ndarray:
    if len(groups) < 3:
        raise ValueError("three or more groups")
    rest = [g for k, g in enumerate(groups) if k != target]
    join = lambda gs: sorted(i for g in gs for i in g)
    out = (2 - len(groups)) * mi(groups[target], join(rest))
    for j in range(len(rest)):
        out = out + mi(groups[target], join(rest[:j] + rest[j + 1 :]))
    return out


def delta_o_information_rate(m: M.Innovations, target: int, groups=None, base: float = math.e) -> np.ndarray:
    return _delta(lambda a, b: mutual_information_rate(m, a, b, base), target, _groups(m.n, groups))


def spectral_delta_o_information_rate(spectrum: np.ndarray, target: int, groups=None, base: float = math.e) -> np.ndarray:
    return _delta(lambda a, b: spectral_mutual_information_rate(spectrum, a, b, base), target, _groups(spectrum.shape[-1], groups))


def stochastic_interaction(m: M.Innovations, groups=None, base: float = 2.0) -> np.ndarray:
    groups = _groups(m.n, groups)
    return (sum(L.logdet(M.reduce(m, g).v) for g in groups) - L.logdet(m.v)) / math.log(base)


def dynamical_dependence(m: M.Innovations, rows: np.ndarray, base: float = 2.0) -> np.ndarray:
    rows = np.asarray(rows, float)
    return (L.logdet(M.project(m, rows).v) - L.logdet(rows @ m.v @ L.t(rows))) / math.log(base)
