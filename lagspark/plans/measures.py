"""A registry of measures over innovations models, and one planned pass over a model table.

A request names measures or families.  The planner evaluates shared primitives
(autocovariances up to the longest lag asked for, the spectrum on the grid) once
per Arrow batch and shape, and returns a long table with a row per number.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import causality as R
from ..functions import decomposition as P
from ..functions import dynamics as D
from ..functions import gaussian as G
from ..functions import linalg as L
from ..functions import models as M
from ..operators.models import kernel, read_innovations

MEASURES = "model_id string, family string, measure string, i int, j int, lag int, f double, atom string, value double"


@dataclass(frozen=True)
class Config:
    """What to measure.  base None keeps each family's own: bits for static measures,
    dynamics, memory, emergence and dependence, nats for causality and rates."""

    base: float | None = None
    points: int = 129
    fs: float = 1.0
    half_open: bool = False
    max_lag: int = 1
    ais_lag: int = 1
    memory_lag: int = 1
    source: tuple[int, ...] = (0,)
    target: tuple[int, ...] = (1,)
    conditional: tuple[int, ...] | None = None
    groups: tuple[tuple[int, ...], ...] | None = None
    group: int = 0
    macro: tuple[tuple[float, ...], ...] | None = None
    sources: tuple[tuple[int, ...], ...] | None = None
    phi_channels: tuple[int, int] = (0, 1)
    phi_lag: int = 1
    redundancy: tuple[str, ...] = ("mmi",)
    qmc: int = 512

    @cached_property
    def freqs(self) -> np.ndarray:
        if self.half_open:
            return np.arange(self.points) * self.fs / (2 * self.points)
        return np.linspace(0, self.fs / 2, self.points)

    def bits(self) -> float:
        return self.base or 2.0

    def nats(self) -> float:
        return self.base or math.e


@dataclass
class Context:
    """Primitives of one batch, each computed when first asked for."""

    model: M.Innovations
    config: Config
    lags: int = 1

    @cached_property
    def gamma(self) -> np.ndarray:
        return M.autocovariances(self.model, self.lags)

    @cached_property
    def gamma0(self) -> np.ndarray:
        return self.gamma[:, 0]

    @cached_property
    def spectrum(self) -> np.ndarray:
        return M.spectrum(self.model, self.config.freqs, self.config.fs)

    def mean(self, values: np.ndarray, axis: int = -1) -> np.ndarray:
        return M.integrate(values, self.config.freqs, self.config.fs, self.config.half_open, axis)


@dataclass(frozen=True)
class Measure:
    family: str
    run: Callable[[Context], np.ndarray]
    axes: tuple[str, ...] = ()
    atoms: Callable[[Context], Sequence[str]] | None = None
    lags: Callable[[Config], int] = field(default=lambda c: 1)
    needs: Callable[[int, Config], str | None] = field(default=lambda n, c: None)


REGISTRY: dict[str, Measure] = {}


def measure(name: str, family: str, axes: tuple[str, ...] = (), **options):
    def add(run):
        REGISTRY[name] = Measure(family, run, axes, **options)
        return run

    return add


def _more(least: int, what: str = "channels"):
    return lambda n, c: None if n >= least else f"fewer than {least} {what}"


def _macro(n: int, c: Config) -> str | None:
    return None if c.macro is not None else "no macro projection"


def _pair(n: int, c: Config) -> str | None:
    return None if n >= 2 and max(*c.source, *c.target) < n else "source and target outside the channels"


def _sources(c: Config, n: int):
    return [list(g) for g in c.sources] if c.sources else [[i] for i in range(n) if i not in c.target]


def _few_sources(n: int, c: Config) -> str | None:
    return None if 2 <= len(_sources(c, n)) <= 3 and max(c.target) < n else "not two or three sources"


def _complex(x: np.ndarray) -> np.ndarray:
    return np.stack([x.real, x.imag], -1)


def _pairwise_spectral(x: Context) -> np.ndarray:
    """Bivariate causality of every source i about every target j."""
    n, freqs = x.model.n, x.config.freqs / x.config.fs
    out = np.zeros((len(x.model.a), len(freqs), n, n))
    for i in range(n):
        for j in range(n):
            if i != j:
                out[..., i, j] = R.pairwise_spectral_gc(x.model, [i], [j], freqs, x.config.nats())
    return out


# Static.
measure("covariance", "gaussian", ("i", "j"))(lambda x: x.gamma0)
measure("gaussian_entropy", "gaussian")(lambda x: G.entropy(x.gamma0, x.config.bits()))
measure("pairwise_mutual_information", "gaussian", ("i", "j"))(lambda x: G.pairwise_mutual_information(x.gamma0, x.config.bits()))
measure("total_correlation", "gaussian")(lambda x: G.total_correlation(x.gamma0, x.config.bits()))
measure("dual_total_correlation", "gaussian")(lambda x: G.dual_total_correlation(x.gamma0, x.config.bits()))
measure("o_information", "gaussian")(lambda x: G.o_information(x.gamma0, x.config.bits()))
measure("s_information", "gaussian")(lambda x: G.s_information(x.gamma0, x.config.bits()))
# Dynamics.
measure("autocovariance", "dynamics", ("lag", "i", "j"), lags=lambda c: c.max_lag)(lambda x: x.gamma[:, : x.config.max_lag + 1])
measure("spectral_radius", "dynamics")(lambda x: L.spectral_radius(x.model.a))
measure("stability_margin", "dynamics")(lambda x: D.stability_margin(L.spectral_radius(x.model.a)))
measure("dominant_timescale", "dynamics")(lambda x: D.dominant_timescale(L.spectral_radius(x.model.a), 1 / x.config.fs))
measure("covariance_amplification", "dynamics")(lambda x: D.covariance_amplification(x.model))
measure("entropy_rate", "dynamics")(lambda x: D.entropy_rate(x.model, x.config.bits()))
measure("predictive_information", "dynamics")(lambda x: D.predictive_information(x.model, x.config.bits(), x.gamma0))
measure("active_information_storage", "dynamics", ("i",), lags=lambda c: c.ais_lag)(lambda x: D.finite_lag_ais(x.gamma, x.config.ais_lag, x.config.bits()))
measure("marginal_entropy_rate", "dynamics", ("i",))(lambda x: D.marginal_entropy_rate(x.model, x.config.bits()))
measure("marginal_entropy_rate_spectral", "dynamics", ("i",))(lambda x: D.marginal_entropy_rate(x.model, x.config.bits(), x.spectrum, x.config.freqs, x.config.fs, x.config.half_open))
measure("power", "spectral", ("f", "i"))(lambda x: np.diagonal(x.spectrum, axis1=-2, axis2=-1).real)
measure("coherence", "spectral", ("f", "i", "j"))(lambda x: np.abs(x.spectrum) ** 2 / (np.diagonal(x.spectrum, axis1=-2, axis2=-1).real[..., :, None] * np.diagonal(x.spectrum, axis1=-2, axis2=-1).real[..., None, :]))
measure("spectral_entropy", "spectral", ("i",))(lambda x: D.spectral_entropy(x.spectrum))
measure("spectral_entropy_rate", "spectral", ("f",))(lambda x: D.spectral_entropy_rate(x.spectrum, x.config.fs, x.config.bits()))
# Predictive memory.
measure("cmem1_total", "cmem", lags=lambda c: c.ais_lag)(lambda x: D.cmem1_total(x.gamma, x.model.v, x.config.ais_lag))
measure("cmem1_full_past", "cmem")(lambda x: D.cmem1_full_past(x.model))
measure("cmem3_total", "cmem")(lambda x: D.cmem3_total(x.gamma0, x.model.v))
measure("cmem1_curve", "cmem", ("lag1",), lags=lambda c: c.memory_lag)(lambda x: D.cmem1_curve(x.gamma, x.config.memory_lag))
measure("cmem3_curve", "cmem", ("lag1",), lags=lambda c: c.memory_lag)(lambda x: D.cmem3_curve(x.gamma, x.config.memory_lag))
measure("cmem3_decomposition", "cmem", ("lag1",), lags=lambda c: c.memory_lag)(lambda x: D.cmem3_decomposition(x.gamma, x.config.memory_lag))
# Causality and rates.
measure("temporal_mvgc", "mvgc", needs=_pair)(lambda x: R.temporal_mvgc(x.model, x.config.source, x.config.target, x.config.conditional, x.config.nats()))
measure("pairwise_temporal_mvgc", "mvgc", ("i", "j"), needs=_more(2))(lambda x: R.pairwise_temporal_mvgc(x.model, x.config.nats()))
measure("maximum_temporal_mvgc", "mvgc", needs=_more(2))(lambda x: R.maximum_temporal_mvgc(x.model, x.config.nats()))
measure("integrated_spectral_mvgc", "mvgc", needs=_pair)(lambda x: x.mean(R.spectral_mvgc(x.model, x.config.source, x.config.target, x.config.freqs / x.config.fs, x.config.conditional, x.config.nats())))
measure("pairwise_spectral_gc", "mvgc", ("f", "i", "j"), needs=_more(2))(_pairwise_spectral)
measure("inverse_transfer", "spectral", ("f", "i", "j", "atom"), atoms=lambda x: ("real", "imaginary"))(lambda x: _complex(M.inverse_transfer(x.model, x.config.freqs / x.config.fs)))
measure("cross_spectrum", "spectral", ("f", "i", "j", "atom"), atoms=lambda x: ("real", "imaginary"))(lambda x: _complex(x.spectrum))
measure("spectral_mvgc", "mvgc", ("f",), needs=_pair)(lambda x: R.spectral_mvgc(x.model, x.config.source, x.config.target, x.config.freqs / x.config.fs, x.config.conditional, x.config.nats()))
measure("mutual_information_rate", "rates", needs=_pair)(lambda x: R.mutual_information_rate(x.model, x.config.source, x.config.target, x.config.nats()))
measure("transfer_entropy_rate", "rates", needs=_pair)(lambda x: R.transfer_entropy_rate(x.model, x.config.source, x.config.target, x.config.nats()))
measure("te_conditional", "rates", ("i", "j"), needs=_more(2))(lambda x: 0.5 * R.pairwise_temporal_mvgc(x.model, x.config.nats()))
measure("instantaneous_rate", "rates", needs=_pair)(lambda x: R.instantaneous_rate(x.model, x.config.source, x.config.target, x.config.nats()))
measure("spectral_mutual_information_rate", "rates", ("f",), needs=_pair)(lambda x: R.spectral_mutual_information_rate(x.spectrum, x.config.source, x.config.target, x.config.nats()))
measure("spectral_transfer_entropy_rate", "rates", ("f",), needs=_pair)(lambda x: R.spectral_transfer_entropy_rate(x.model, x.config.source, x.config.target, x.config.freqs, x.config.fs, x.config.nats()))
measure("pairwise_mutual_information_rate", "rates", ("i", "j"), needs=_more(2))(lambda x: R.pairwise_mutual_information_rate(x.model, x.config.nats()))
measure("mean_pairwise_rate", "rates", needs=_more(2))(lambda x: R.mean_pairwise_rate(R.pairwise_mutual_information_rate(x.model, x.config.nats())))
measure("o_information_rate", "oir", needs=_more(2))(lambda x: R.o_information_rate(x.model, x.config.groups, x.config.nats()))
measure("spectral_o_information_rate", "oir", ("f",), needs=_more(2))(lambda x: R.spectral_o_information_rate(x.spectrum, x.config.groups, x.config.nats()))
measure("delta_o_information_rate", "oir", needs=_more(3))(lambda x: R.delta_o_information_rate(x.model, x.config.group, x.config.groups, x.config.nats()))
measure("spectral_delta_o_information_rate", "oir", ("f",), needs=_more(3))(lambda x: R.spectral_delta_o_information_rate(x.spectrum, x.config.group, x.config.groups, x.config.nats()))
measure("stochastic_interaction", "integration", needs=_more(2))(lambda x: R.stochastic_interaction(x.model, x.config.groups, x.config.bits()))
measure("dynamical_dependence", "dependence", needs=_macro)(lambda x: R.dynamical_dependence(x.model, x.config.macro, x.config.bits()))


def _rate_atoms(x: Context) -> Sequence[str]:
    of = P.lattice(len(_sources(x.config, x.model.n)))
    return [of.label(k) for k in range(len(of.nodes))]


def _spectral_pird(x: Context) -> np.ndarray:
    red, of = P.spectral_pird(x.spectrum, _sources(x.config, x.model.n), list(x.config.target), x.config.nats())
    return P.atoms(red, of)


def _spectral_pdgc(x: Context) -> np.ndarray:
    red, of = P.spectral_pdgc(x.model, _sources(x.config, x.model.n), list(x.config.target), x.config.freqs, x.config.fs, x.config.nats())
    return P.atoms(red, of)


measure("spectral_pird", "pird", ("f", "atom"), atoms=_rate_atoms, needs=_few_sources)(_spectral_pird)
measure("pird", "pird", ("atom",), atoms=_rate_atoms, needs=_few_sources)(lambda x: x.mean(_spectral_pird(x), axis=1))
measure("spectral_pdgc", "pdgc", ("f", "atom"), atoms=_rate_atoms, needs=_few_sources)(_spectral_pdgc)
measure("pdgc", "pdgc", ("atom",), atoms=_rate_atoms, needs=_few_sources)(lambda x: x.mean(_spectral_pdgc(x), axis=1))


def _coarse(values: Callable, integrated: bool = True):
    def run(x: Context) -> np.ndarray:
        of = P.lattice(len(_sources(x.config, x.model.n)))
        parts = P.coarse(x.mean(values(x), axis=1) if integrated else values(x), of)
        return np.stack([parts[k] for k in sorted(parts)], -1)

    return run


def _coarse_names(x: Context) -> Sequence[str]:
    return sorted({P.coarse_label(a) for a in P.lattice(len(_sources(x.config, x.model.n))).nodes} | {"delta"})


measure("pird_parts", "hop", ("atom",), atoms=_coarse_names, needs=_few_sources)(_coarse(_spectral_pird))
measure("pdgc_parts", "hop", ("atom",), atoms=_coarse_names, needs=_few_sources)(_coarse(_spectral_pdgc))
measure("spectral_pird_parts", "hop", ("f", "atom"), atoms=_coarse_names, needs=_few_sources)(_coarse(_spectral_pird, False))
measure("spectral_pdgc_parts", "hop", ("f", "atom"), atoms=_coarse_names, needs=_few_sources)(_coarse(_spectral_pdgc, False))


@measure("pird_extrema", "pird", ("atom",), atoms=lambda x: ["redundancy", "redundancy_triple", "synergy", "synergy_triple"], needs=_more(3))
def _extrema(x: Context) -> np.ndarray:
    """Largest integrated redundancy and synergy of a pair about a target, and the code of its (i, j, target)."""
    n, found = x.model.n, []
    for t in range(n):
        for i in range(n):
            for j in range(i + 1, n):
                if t not in (i, j):
                    red, of = P.spectral_pird(x.spectrum, [[i], [j]], [t], x.config.nats())
                    parts = P.coarse(x.mean(P.atoms(red, of), axis=1), of)
                    found.append(((i * n + j) * n + t, parts["Rd"], parts["Sy"]))
    codes = np.array([f[0] for f in found], float)
    out = []
    for k in (1, 2):
        v = np.stack([f[k] for f in found], -1)
        out += [v.max(-1), codes[v.argmax(-1)]]
    return np.stack(out, -1)


@measure("phi_id", "phi", ("redundancy", "atom"), atoms=lambda x: P.PHI_ATOMS, lags=lambda c: c.phi_lag, needs=_more(2))
def _phi(x: Context) -> np.ndarray:
    cov = P.past_future(x.gamma, list(x.config.phi_channels), x.config.phi_lag)
    return np.stack([P.phi_id(cov, 1, k, x.config.bits(), x.config.qmc) for k in x.config.redundancy], 1)


def _emergence(x: Context, full: bool) -> np.ndarray:
    macro = np.asarray(x.config.macro, float)
    e = P.emergence_full_past(x.model, macro, x.config.bits()) if full else P.emergence(x.gamma0, x.gamma[:, x.config.max_lag], macro, x.config.bits())
    return np.stack([e[k] for k in _EMERGENCE], -1)


_EMERGENCE = ("psi", "delta", "gamma", "macro", "micro_to_macro", "macro_to_micro", "micro_to_micro")
measure("emergence", "emergence", ("atom",), atoms=lambda x: _EMERGENCE, lags=lambda c: c.max_lag, needs=_macro)(lambda x: _emergence(x, False))
measure("emergence_full_past", "emergence", ("atom",), atoms=lambda x: _EMERGENCE, needs=_macro)(lambda x: _emergence(x, True))


def resolve(names: Sequence[str] | str = "all") -> list[str]:
    """Measure names from names, 'family.name' paths or families."""
    if names == "all":
        return list(REGISTRY)
    out = []
    for n in [names] if isinstance(names, str) else names:
        own = [k for k, m in REGISTRY.items() if n in (k, m.family, f"{m.family}.{k}")]
        if not own:
            raise ValueError(f"unknown measure {n!r}")
        out += own
    return list(dict.fromkeys(out))


def required_lag(names: Sequence[str], config: Config) -> int:
    return max([1, *(REGISTRY[n].lags(config) for n in names)])


def long_rows(ids: Sequence[str], name: str, values: np.ndarray, context: Context) -> pd.DataFrame:
    m = REGISTRY[name]
    shape = values.shape
    index = np.indices(shape).reshape(len(shape), -1)
    out = {"model_id": np.asarray(ids, object)[index[0]], "family": m.family, "measure": name, "i": None, "j": None, "lag": None, "f": None, "atom": None, "value": values.reshape(-1).astype(float)}
    kinds = {"redundancy": np.asarray(context.config.redundancy, object)}
    for axis, at in zip(m.axes, index[1:]):
        if axis == "f":
            out["f"] = context.config.freqs[at]
        elif axis == "atom":
            names = np.asarray(list(m.atoms(context)), object)[at]
            out["atom"] = names if out["atom"] is None else out["atom"] + "." + names
        elif axis == "redundancy":
            out["atom"] = kinds["redundancy"][at]
        elif axis == "lag1":
            out["lag"] = at + 1
        else:
            out[axis] = at
    pdf = pd.DataFrame(out)
    return pdf.astype({"i": "Int32", "j": "Int32", "lag": "Int32", "f": "Float64"})


def status_rows(ids: Sequence[str], statuses: Sequence[str]) -> pd.DataFrame:
    out = pd.DataFrame({"model_id": list(ids), "family": "status", "measure": list(statuses), "i": None, "j": None, "lag": None, "f": None, "atom": None, "value": np.nan})
    return out.astype({"i": "Int32", "j": "Int32", "lag": "Int32", "f": "Float64"})


def measures(models: DataFrame, names: Sequence[str] | str = "all", config: Config = Config()) -> DataFrame:
    """Long table (MEASURES) of every named measure that applies; narrow, one pass over the models.

    A model that can't be used has one row, of family status, whose measure is the status.
    """
    names = resolve(names)
    lags = required_lag(names, config)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = Context(read_innovations(pdf), config, lags)
        parts = [long_rows(pdf["model_id"], n, np.asarray(REGISTRY[n].run(x)), x) for n in names if REGISTRY[n].needs(x.model.n, config) is None]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()

    return kernel(models, MEASURES, run, lambda pdf, statuses: status_rows(pdf["model_id"], statuses))


def not_available(n: int, names: Sequence[str] | str = "all", config: Config = Config()) -> dict[str, str]:
    """Measures that don't apply to models of n channels, with the reason."""
    return {k: r for k in resolve(names) if (r := REGISTRY[k].needs(n, config))}
