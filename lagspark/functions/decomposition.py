"""Redundancy lattices and the decompositions built on them."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np

from . import causality as R
from . import gaussian as G
from . import linalg as L
from . import models as M
from . import special


def below(a: frozenset, b: frozenset) -> bool:
    """Order of antichains: every element of b contains one of a."""
    return all(any(x <= y for x in a) for y in b)


@dataclass(frozen=True)
class Lattice:
    sources: int
    nodes: tuple[frozenset, ...]
    zeta: np.ndarray
    mobius: np.ndarray

    def label(self, k: int) -> str:
        return "".join("{" + ",".join(map(str, sorted(x))) + "}" for x in sorted(self.nodes[k], key=lambda x: (len(x), sorted(x))))


@lru_cache
def lattice(sources: int) -> Lattice:
    """Antichains of non-empty source subsets (1, 4, 18, 166), bottom first."""
    if not 1 <= sources <= 4:
        raise ValueError("1 to 4 sources")
    subsets = [frozenset(c) for k in range(1, sources + 1) for c in combinations(range(sources), k)]
    found: list[frozenset] = []

    def grow(chosen: tuple, start: int) -> None:
        if chosen:
            found.append(frozenset(chosen))
        for i in range(start, len(subsets)):
            if not any(subsets[i] <= x or x <= subsets[i] for x in chosen):
                grow((*chosen, subsets[i]), i + 1)

    grow((), 0)
    order = sorted(found, key=lambda a: (sum(below(b, a) for b in found), sorted(sorted(x) for x in a)))
    zeta = np.array([[int(below(b, a)) for b in order] for a in order])
    return Lattice(sources, tuple(order), zeta, np.rint(np.linalg.inv(zeta)).astype(int))


def atoms(redundancy: np.ndarray, of: Lattice) -> np.ndarray:
    """Moebius inversion over the last axis."""
    return redundancy @ of.mobius.T


def redundancies(values: np.ndarray, of: Lattice) -> np.ndarray:
    return values @ of.zeta.T


def coarse_label(node: frozenset) -> str:
    """U<i>, Rd or Sy of an atom of two or three sources.

    A node with several single sources is redundant, one with a single source
    is unique to it, and one without any is synergistic.
    """
    single = sorted(next(iter(x)) for x in node if len(x) == 1)
    return "Rd" if len(single) > 1 else f"U{single[0]}" if single else "Sy"


# Gaussian redundancies of two sources about one target.


def _local(x: np.ndarray, cov: np.ndarray, a, b, base: float) -> np.ndarray:
    idx = [*a, *b]
    return G.local_mutual_information(x[..., idx], L.sub(cov, idx), len(a), None, base)


def nodes_for(cov: np.ndarray, n: int) -> np.ndarray:
    """(batch, n, d) quasi-random normal points with covariance cov."""
    if n < 32:
        raise ValueError("at least 32 nodes")
    u = np.clip(special.sobol(n, cov.shape[-1]), np.finfo(float).eps, 1 - np.finfo(float).eps)
    return special.norm_ppf(u) @ L.t(L.stable_cholesky(cov))


def _common_change(x, cov, a, b, t, base) -> np.ndarray:
    one, two, both = _local(x, cov, a, t, base), _local(x, cov, b, t, base), _local(x, cov, [*a, *b], t, base)
    common = one + two - both
    s = np.sign(common)
    return np.where((np.sign(one) == s) & (np.sign(two) == s) & (np.sign(both) == s), common, 0.0)


def _unlinked(cov, a, b, t) -> np.ndarray:
    """cov with a and b independent given t, and their other covariances as they are."""
    out = np.array(cov, copy=True)
    through = L.sub(cov, a, t) @ L.spd_solve(L.sub(cov, t), L.sub(cov, t, b))
    out[..., np.array(a)[:, None], np.array(b)] = through
    out[..., np.array(b)[:, None], np.array(a)] = L.t(through)
    return out


def _dependency(cov, a, b, t, base) -> np.ndarray:
    """I_dep of Kay and Ince: what a and t share less the unique information of a.

    The latter is the least that the constraint on (a, t) adds to the
    information about t, over the dependency lattice.  For Gaussians three
    edges can be least: onto independent sources, onto (b, t) alone, and onto
    (b, t) and (a, b), the last giving the distribution itself.
    """
    own, other = G.mutual_information_of(cov, a, t, base), G.mutual_information_of(cov, b, t, base)
    whole = [G.mutual_information_of(c, [*a, *b], t, base) for c in (_unlinked(cov, a, b, t), cov)]
    unique = np.minimum(own, np.minimum(*whole) - other)
    return own - unique


def redundancy(cov: np.ndarray, a, b, t, kind: str = "mmi", base: float = 2.0, points: np.ndarray | None = None) -> np.ndarray:
    a, b, t = list(a), list(b), list(t)
    if kind == "mmi":
        return np.minimum(G.mutual_information_of(cov, a, t, base), G.mutual_information_of(cov, b, t, base))
    if kind == "ccs":
        return _common_change(points, cov, a, b, t, base).mean(-1)
    if kind in ("dep", "idep", "idep_a", "idep_b"):
        return _dependency(cov, a, b, t, base)
    raise ValueError(f"unknown redundancy {kind!r}")


PID_ATOMS = ("redundant", "unique0", "unique1", "synergistic")


def pid(cov: np.ndarray, n0: int, n1: int, kind: str = "mmi", base: float = 2.0, points: int = 4096) -> np.ndarray:
    """(batch, 4) PID_ATOMS of [source 0, source 1, target]."""
    a, b, t = list(range(n0)), list(range(n0, n0 + n1)), list(range(n0 + n1, cov.shape[-1]))
    x = nodes_for(cov, points) if kind == "ccs" else None
    red = redundancy(cov, a, b, t, kind, base, x)
    i0, i1, both = G.mutual_information_of(cov, a, t, base), G.mutual_information_of(cov, b, t, base), G.mutual_information_of(cov, [*a, *b], t, base)
    return np.stack([red, i0 - red, i1 - red, both - i0 - i1 + red], -1)


def var_past_future(coef: np.ndarray, sigma: np.ndarray, source0, source1) -> np.ndarray:
    """Covariance of [histories of source 0, of source 1, the joint present] of a VAR."""
    b, p, n, _ = coef.shape
    state = M.var_state_covariance(coef, sigma)
    a = M.companion(coef)[:, :n]
    now = a @ state @ L.t(a) + sigma
    cross = state @ L.t(a)
    past = [i + k * n for g in (source0, source1) for i in g for k in range(p)]
    top = np.concatenate([L.sub(state, past), cross[:, past]], -1)
    return L.symmetrise(np.concatenate([top, np.concatenate([L.t(cross[:, past]), now], -1)], -2))


def pid_of_var(coef, sigma, source0, source1, kind: str = "mmi", base: float = 2.0, points: int = 4096) -> np.ndarray:
    p = coef.shape[1]
    return pid(var_past_future(coef, sigma, source0, source1), len(source0) * p, len(source1) * p, kind, base, points)


# Integrated information decomposition: a lattice of two sources for the past times one for the future.

_PAST = ("red", "unq0", "unq1", "syn")
PHI_ATOMS = tuple(f"{a}_to_{b}" for a in _PAST for b in _PAST)
_ZETA = np.array([[1, 0, 0, 0], [1, 1, 0, 0], [1, 0, 1, 0], [1, 1, 1, 1]])
_MOBIUS = np.linalg.inv(_ZETA)


def _double_common_change(x, cov, past, future, base) -> np.ndarray:
    (a, b), (c, d) = past, future
    mi = lambda s, t: _local(x, cov, s, t, base)
    cc = lambda s, t, u: _common_change(x, cov, s, t, u, base)
    single = [mi(a, c), mi(a, d), mi(b, c), mi(b, d)]
    total = -sum(single) + mi(a, c + d) + mi(b, c + d) + mi(a + b, c) + mi(a + b, d) - mi(a + b, c + d)
    total = total + cc(a, b, c) + cc(a, b, d) - cc(a, b, c + d) + cc(c, d, a) + cc(c, d, b) - cc(c, d, a + b)
    s = np.sign(total)
    agree = np.logical_and.reduce([np.sign(v) == s for v in single])
    return np.where(agree, total, 0.0).mean(-1)


def phi_id(cov: np.ndarray, block: int = 1, kind: str = "mmi", base: float = 2.0, points: int = 4096) -> np.ndarray:
    """(batch, 16) PHI_ATOMS from the covariance of [past 0, past 1, future 0, future 1].

    Cumulative quantities are indexed by a past and a future node: redundancy,
    either part, or both together; two Moebius inversions give the atoms.
    """
    a, b, c, d = (list(range(k * block, (k + 1) * block)) for k in range(4))
    x = nodes_for(cov, points) if kind == "ccs" else None
    mi = lambda s, t: G.mutual_information_of(cov, s, t, base)
    red = lambda s, t, u: redundancy(cov, s, t, u, kind, base, x)
    if kind == "mmi":
        bottom = np.min([mi(a, c), mi(a, d), mi(b, c), mi(b, d)], axis=0)
    elif kind == "ccs":
        bottom = _double_common_change(x, cov, (a, b), (c, d), base)
    elif kind == "idep_a":
        bottom = np.minimum(red(a, b, c), red(a, b, d))
    elif kind == "idep_b":
        bottom = np.minimum(red(c, d, a), red(c, d, b))
    else:
        raise ValueError(f"unknown redundancy {kind!r}")
    future = (c, d, c + d)
    rows = [[bottom, *(red(a, b, f) for f in future)]]
    rows += [[red(c, d, s), *(mi(s, f) for f in future)] for s in (a, b, a + b)]
    known = np.stack([np.stack(r, -1) for r in rows], -2)
    out = _MOBIUS @ known @ _MOBIUS.T
    return out.reshape(*out.shape[:-2], 16)


def past_future(gamma: np.ndarray, channels, lag: int = 1) -> np.ndarray:
    """Covariance of [past, future] of some channels at a lag."""
    g0, g = L.sub(gamma[:, 0], channels), L.sub(gamma[:, lag], channels)
    return np.concatenate([np.concatenate([g0, L.t(g)], -1), np.concatenate([g, g0], -1)], -2)


def phi_mmi(cov: np.ndarray, n_past: int = 1, n_future: int = 1, base: float = 2.0) -> np.ndarray:
    """(batch, 4): redundant, unique0, unique1, synergistic sums of the atoms by their past node."""
    return phi_id(cov, n_past, "mmi", base).reshape(*cov.shape[:-2], 4, 4).sum(-1)


# Rate decompositions by frequency.


def _minima(values: dict, of: Lattice) -> np.ndarray:
    """Redundancy of each antichain: the least value of its subsets."""
    return np.stack([np.min([values[x] for x in node], axis=0) for node in of.nodes], -1)


def _join(sources, subset) -> list[int]:
    return [i for k in sorted(subset) for i in sources[k]]


def spectral_pird(spectrum: np.ndarray, sources, target, base: float = math.e) -> tuple[np.ndarray, Lattice]:
    """(batch, freq, node) redundancies of the mutual information rate about a target."""
    of = lattice(len(sources))
    subsets = {x for node in of.nodes for x in node}
    return _minima({x: R.spectral_mutual_information_rate(spectrum, _join(sources, x), target, base) for x in subsets}, of), of


def spectral_pdgc(m: M.Innovations, sources, target, freqs, fs: float = 1.0, base: float = math.e) -> tuple[np.ndarray, Lattice]:
    """The same for unconditional spectral Granger causality."""
    of = lattice(len(sources))
    subsets = {x for node in of.nodes for x in node}
    return _minima({x: R.spectral_mvgc(m, _join(sources, x), target, np.asarray(freqs) / fs, (), base) for x in subsets}, of), of


def coarse(values: np.ndarray, of: Lattice) -> dict[str, np.ndarray]:
    """Atoms summed to unique, redundant and synergistic parts; delta is redundant less synergistic."""
    out: dict[str, np.ndarray] = {}
    for k, node in enumerate(of.nodes):
        name = coarse_label(node)
        out[name] = out.get(name, 0) + values[..., k]
    out["delta"] = out["Rd"] - out["Sy"]
    return out


# Emergence.


def emergence(gamma0: np.ndarray, gamma: np.ndarray, rows: np.ndarray, base: float = 2.0) -> dict[str, np.ndarray]:
    """psi, delta and gamma of a macro Y = LX from lagged covariances, with their parts."""
    rows = np.asarray(rows, float)
    rows = np.broadcast_to(rows, (gamma0.shape[0], *rows.shape[-2:]))
    n, m = gamma0.shape[-1], rows.shape[-2]

    def mi(a, b, cross):
        return 0.5 * (L.logdet(a) + L.logdet(b) - L.logdet(np.concatenate([np.concatenate([a, cross], -1), np.concatenate([L.t(cross), b], -1)], -2))) / math.log(base)

    y0 = L.symmetrise(rows @ gamma0 @ L.t(rows))
    macro = mi(y0, y0, rows @ gamma @ L.t(rows))
    each = lambda i: gamma0[:, i : i + 1, i : i + 1]
    # Micro past about macro future, and macro past about micro future.
    micro_to_macro = np.stack([mi(y0, each(i), rows @ gamma[:, :, i : i + 1]) for i in range(n)], -1)
    macro_to_micro = np.stack([mi(each(i), y0, gamma[:, i : i + 1] @ L.t(rows)) for i in range(n)], -1)
    micro = np.stack([np.stack([mi(each(j), each(i), gamma[:, j : j + 1, i : i + 1]) for i in range(n)], -1) for j in range(n)], -2)
    return {
        "psi": macro - micro_to_macro.sum(-1),
        "delta": (macro_to_micro - micro.sum(-1)).max(-1),
        "gamma": macro_to_micro.max(-1),
        "macro": macro,
        "micro_to_macro": micro_to_macro.sum(-1),
        "macro_to_micro": macro_to_micro.sum(-1),
        "micro_to_micro": micro.sum((-2, -1)),
    }


def emergence_full_past(m: M.Innovations, rows: np.ndarray, base: float = 2.0) -> dict[str, np.ndarray]:
    """The same criteria with whole pasts: what a projected predictor leaves of the micro state."""
    rows = np.asarray(rows, float)
    gamma0 = M.autocovariances(m, 0)[:, 0]
    state = m.state_covariance()

    def left(by: np.ndarray) -> np.ndarray:
        return L.symmetrise(m.c @ (state - M.project(m, by).state_covariance()) @ L.t(m.c) + m.v)

    scale = 0.5 / math.log(base)
    from_macro = left(rows)
    macro = scale * (L.logdet(rows @ gamma0 @ L.t(rows)) - L.logdet(rows @ from_macro @ L.t(rows)))
    var = np.diagonal(gamma0, axis1=-2, axis2=-1)
    macro_to_micro = scale * np.log(var / np.diagonal(from_macro, axis1=-2, axis2=-1))
    from_micro = [left(np.eye(m.n)[i : i + 1]) for i in range(m.n)]
    micro_to_macro = np.stack([scale * (L.logdet(rows @ gamma0 @ L.t(rows)) - L.logdet(rows @ f @ L.t(rows))) for f in from_micro], -1)
    micro = np.stack([scale * np.log(var / np.diagonal(f, axis1=-2, axis2=-1)) for f in from_micro], -1)  # future, past
    return {
        "psi": macro - micro_to_macro.sum(-1),
        "delta": (macro_to_micro - micro.sum(-1)).max(-1),
        "gamma": macro_to_micro.max(-1),
        "macro": macro,
        "micro_to_macro": micro_to_macro.sum(-1),
        "macro_to_micro": macro_to_micro.sum(-1),
        "micro_to_micro": micro.sum((-2, -1)),
    }
