"""Synthetic systems, random models, and decay of a VAR to a spectral radius."""

from __future__ import annotations

import inspect
import math

import numpy as np

from . import dynamics as D
from . import linalg as L
from . import models as M


def _rng(seed: int, *stream: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=[seed, stream[0] if stream else 0]))


def _eye(n):
    return np.eye(n)


def _chain(n):
    return np.eye(n, k=-1)


def _ring(n):
    a = np.eye(n, k=-1)
    a[0, -1] += 1
    return a


def _weighted(a, self_coupling=1.0, coupling=1.0):
    return self_coupling * np.eye(len(a)) + coupling * a


def _modules(n: int, k: int) -> np.ndarray:
    return np.arange(n) * k // n


def _modular(n, n_modules=2, self_coupling=1.0, within_coupling=1.0, between_coupling=0.05):
    m = _modules(n, n_modules)
    same = (m[:, None] == m[None]) & ~np.eye(n, dtype=bool)
    return self_coupling * np.eye(n) + within_coupling * same + between_coupling * (m[:, None] != m[None])


def _random(n, density, seed, symmetric):
    g = _rng(seed).random((n, n)) < density
    a = np.triu(g, 1) if symmetric else g & ~np.eye(n, dtype=bool)
    return (a | a.T if symmetric else a).astype(float)


def _hub(n, broadcast, hub=0):
    a = np.zeros((n, n))
    a[:, hub] = np.arange(n) != hub
    return a if broadcast else a.T


def _frustrated(n, self_coupling=1.0, coupling=1.0):
    a = _ring(n)
    a[0, -1] = -1
    return _weighted(a, self_coupling, coupling)


_BUILD = {
    "uncoupled": lambda n, self_coupling=1.0: self_coupling * np.eye(n),
    "directed_chain": lambda n, **k: _weighted(_chain(n), **k),
    "nonnormal_feedforward": lambda n, **k: _weighted(np.tril(np.ones((n, n)), -1), **k),
    "directed_ring": lambda n, **k: _weighted(_ring(n), **k),
    "frustrated_ring": _frustrated,
    "fully_connected": lambda n, **k: _weighted(np.ones((n, n)) - np.eye(n), **k),
    "modular": _modular,
    "planted_modular": lambda n, **k: _modular(n, between_coupling=0.0, **k),
    "erdos_renyi": lambda n, density=0.3, seed=0, **k: _weighted(_random(n, density, seed, True), **k),
    "random_directed": lambda n, density=0.3, seed=0, **k: _weighted(_random(n, density, seed, False), **k),
    "hub_broadcast": lambda n, hub=0, **k: _weighted(_hub(n, True, hub), **k),
    "hub_convergent": lambda n, hub=0, **k: _weighted(_hub(n, False, hub), **k),
}
SYSTEMS = tuple(_BUILD)

# Other names of the systems above, the parameters of the modular
# ones, and the connections (row: target, column: source) of two published
# demonstration networks.
ALIASES = {
    "chain": "directed_chain",
    "feedforward": "nonnormal_feedforward",
    "ring": "directed_ring",
    "cycle": "directed_ring",
    "signed_ring": "frustrated_ring",
    "random_network": "random_directed",
    "star_broadcast": "hub_broadcast",
    "star_convergent": "hub_convergent",
}
MODULAR = ("n_modules", "self_coupling", "within_coupling", "between_coupling")
TNET5 = """
1 0 0 0 0
1 1 0 0 0
1 0 1 0 0
1 0 0 1 1
0 0 0 1 1
"""
TNET9 = """
1 0 1 1 0 0 0 0 0
0 1 0 1 0 0 0 0 0
0 0 1 1 0 0 0 0 0
0 1 0 1 0 0 0 0 0
0 0 1 0 1 0 0 0 0
0 0 0 0 1 1 0 0 0
0 0 0 0 0 1 1 0 0
0 0 0 0 0 0 0 1 1
0 0 0 0 0 0 1 0 1
"""


def named(system: str) -> str:
    """The system's own name, from any spelling or another name of it."""
    name = system.lower().replace("-", "_").replace(" ", "_")
    name = ALIASES.get(name, name)
    if name not in _BUILD:
        raise ValueError(f"no system {system!r}; there are {', '.join(SYSTEMS)}")
    return name


def parameters(system: str) -> tuple[str, ...]:
    """Names of what a topology takes besides its size: its builder's own, and the couplings that it passes on."""
    name = named(system)
    if "modular" in name:
        return MODULAR if name == "modular" else MODULAR[:-1]
    own = list(inspect.signature(_BUILD[name]).parameters.values())[1:]
    couplings = ("self_coupling", "coupling") if any(p.kind == p.VAR_KEYWORD for p in own) else ()
    return tuple(p.name for p in own if p.kind != p.VAR_KEYWORD) + couplings


def transition(system: str, n: int, **parameters) -> np.ndarray:
    """The named topology with a spectral radius of one."""
    if n < 2:
        raise ValueError("at least two channels")
    a = _BUILD[named(system)](n, **parameters)
    return a / L.spectral_radius(a)


def equicorrelated(n: int, correlation: float = 0.0, variance: float = 1.0) -> np.ndarray:
    if not -1 / (n - 1) < correlation < 1:
        raise ValueError("the correlation leaves no positive definite matrix")
    return variance * ((1 - correlation) * np.eye(n) + correlation)


def synthetic_var(system: str, n: int, radius: float = 0.8, correlation: float = 0.0, variance: float = 1.0, **parameters) -> tuple[np.ndarray, np.ndarray]:
    return (radius * transition(system, n, **parameters))[None, None], equicorrelated(n, correlation, variance)[None]


def module_projection(n: int, k: int = 2) -> np.ndarray:
    own = (_modules(n, k)[None] == np.arange(k)[:, None]).astype(float)
    return own / np.linalg.norm(own, axis=1, keepdims=True)


def network(name: str) -> np.ndarray:
    """Mask (target, source) of a published demonstration network: tnet5 or tnet9."""
    text = {"tnet5": TNET5, "tnet9": TNET9}[name]
    return np.array([line.split() for line in text.strip().splitlines()], float)


def random_mask(n: int, density: float, seed: int = 0) -> np.ndarray:
    """A directed mask whose connections are drawn singly; every channel has its own past."""
    mask = (_rng(seed).random((n, n)) < density).astype(float)
    np.fill_diagonal(mask, 1)
    return mask


def modular_mask(modules: int, size: int, within: float, between: float, seed: int = 0) -> np.ndarray:
    """A directed mask of blocks, with one density inside blocks and another between them."""
    m = _modules(modules * size, modules)
    mask = (_rng(seed).random((len(m), len(m))) < np.where(m[:, None] == m[None], within, between)).astype(float)
    np.fill_diagonal(mask, 1)
    return mask


def masked_model(mask: np.ndarray, radius: float = 0.72, gain: float = 0.16, seed: int | None = None) -> M.Innovations:
    """An innovations model from a directed mask (target, source), scaled to a radius; with a seed, its weights are normal."""
    a = np.asarray(mask, float)
    n = len(a)
    if seed is not None:
        a = a * _rng(seed, 1).standard_normal((n, n))
    size = L.spectral_radius(a)
    if not size > 0:
        raise ValueError("the mask leaves no feedback")
    return M.Innovations((radius * a / size)[None], np.eye(n)[None], gain * np.eye(n)[None], np.eye(n)[None])


def paired_modules(modules: int = 3, within: float = 0.15, own: float = 0.45, gain: float = 0.12) -> tuple[M.Innovations, np.ndarray]:
    """Pairs of channels that drive each other alike, and the projection on the pairs' means, which is closed under the dynamics."""
    n = 2 * modules
    a = own * np.eye(n) + within * np.kron(np.eye(modules), np.eye(2)[::-1])
    return M.Innovations(a[None], np.eye(n)[None], gain * np.eye(n)[None], np.eye(n)[None]), module_projection(n, modules)


def random_correlation(n: int, batch: int = 1, seed: int = 0) -> np.ndarray:
    """Correlation matrices with uniform density, grown by the onion method."""
    rng = _rng(seed)
    out = np.zeros((batch, n, n))
    for b in range(batch):
        r = np.eye(1)
        for k in range(1, n):
            beta = 1 + (n - 1 - k) / 2
            y = rng.beta(k / 2, beta)
            u = rng.standard_normal(k)
            z = np.linalg.cholesky(r) @ (math.sqrt(y) * u / np.linalg.norm(u))
            r = np.block([[r, z[:, None]], [z[None], np.ones((1, 1))]])
        out[b] = r
    return out


def random_covariance(n: int, batch: int = 1, seed: int = 0, low: float = 0.5, high: float = 1.5) -> np.ndarray:
    scale = _rng(seed, 1).uniform(low, high, (batch, n))
    return scale[:, :, None] * random_correlation(n, batch, seed) * scale[:, None]


def decay_to(coef: np.ndarray, radius) -> np.ndarray:
    """A_k (r / rho)^k: the same VAR with another spectral radius."""
    factor = np.asarray(radius) / M.var_radius(coef)
    return coef * np.broadcast_to(factor, coef.shape[:1])[:, None, None, None] ** np.arange(1, coef.shape[1] + 1)[None, :, None, None]


def random_var(batch: int, n: int, order: int, radius: float = 0.85, noise: float = 1.0, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    coef = np.stack([_rng(seed, i).standard_normal((order, n, n)) for i in range(batch)]) / math.sqrt(n * order)
    return decay_to(coef, radius), np.broadcast_to(noise * np.eye(n), (batch, n, n)).copy()


def demo_var(n: int = 3, order: int = 2, path: float = -0.95, gain: float = 0.9, correlation: float = -0.25, target: float = 0.98) -> tuple[np.ndarray, np.ndarray]:
    """A cycle in which each channel follows itself and its neighbour, with falling weights by lag."""
    w = np.arange(order, 0, -1) / np.arange(1, order + 1).sum()
    one = gain * np.eye(n) * (1 - abs(path)) + gain * path * np.roll(np.eye(n), 1, axis=0)
    coef = (w[:, None, None] * one)[None]
    return (decay_to(coef, target) if M.var_radius(coef)[0] >= target else coef), equicorrelated(n, correlation)[None]


def automatic_burnin(coef: np.ndarray, eps: float | None = None) -> int:
    radius = float(M.var_radius(coef).max())
    return 0 if radius <= 0 else max(0, math.ceil(math.log(eps or np.finfo(float).eps) / math.log(radius)))


# Null models matched in total mutual information.


def total_information(coef: np.ndarray, sigma: np.ndarray, base: float = 2.0) -> np.ndarray:
    return D.predictive_information(M.var_to_innovations(coef, sigma), base)


def match_information(coef: np.ndarray, sigma: np.ndarray, target: float, base: float = 2.0, steps: int = 64) -> np.ndarray:
    """The same VARs with the spectral radius at which their predictive information is target."""
    low, high = np.full(len(coef), 1e-6), np.full(len(coef), 1 - 1e-9)
    for _ in range(steps):
        mid = (low + high) / 2
        under = total_information(decay_to(coef, mid), sigma, base) < target
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return decay_to(coef, (low + high) / 2)


def mid_quantile(samples: np.ndarray, value: float, atol: float = 1e-8) -> float:
    equal = np.abs(samples - value) <= atol
    return float(((samples < value) & ~equal).mean() + 0.5 * equal.mean())
