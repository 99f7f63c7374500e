"""Search for projections with little dynamical dependence.

Projections are rows of an orthonormal frame, (runs, m, n).  The proxy objective
works on a sequence of coefficient matrices, the spectral one on a transfer
function; models with other innovations than white are whitened first.
"""

from __future__ import annotations

import numpy as np

from . import linalg as L
from . import models as M


def orthonormal(rows: np.ndarray) -> np.ndarray:
    """The frame of the same row space, from a singular value decomposition."""
    return np.linalg.svd(rows, full_matrices=False)[2]


def random_frames(runs: int, m: int, n: int, seed: int = 0) -> np.ndarray:
    rng = np.random.Generator(np.random.Philox(key=seed))
    return L.t(np.linalg.qr(rng.standard_normal((runs, n, m)))[0])


def proxy_sequence(model: M.Innovations, lags: int | None = None) -> np.ndarray:
    """(lags, n, n): C A^(k-1) K of one model; as many lags as states by default."""
    a, c, x = model.a[0], model.c[0], model.k[0]
    out = []
    for _ in range(lags or a.shape[-1]):
        out.append(c @ x)
        x = a @ x
    return np.stack(out)


def proxy(rows: np.ndarray, seq: np.ndarray) -> np.ndarray:
    mq = np.einsum("bmi,kij->bkmj", rows, seq)
    return (mq**2).sum((1, 2, 3)) - (np.einsum("bkmi,bni->bkmn", mq, rows) ** 2).sum((1, 2, 3))


def _tangent(rows: np.ndarray, raw: np.ndarray) -> np.ndarray:
    return raw - raw @ L.t(rows) @ rows


def proxy_gradient(rows: np.ndarray, seq: np.ndarray) -> np.ndarray:
    p = L.t(rows) @ rows
    out = rows @ np.einsum("kij,klj->il", seq, seq)
    for q in seq:
        out = out - rows @ q.T @ p @ q - rows @ q @ p @ q.T
    return _tangent(rows, 2 * out)


def _weights(points: int) -> np.ndarray:
    w = np.ones(points)
    w[[0, -1]] = 0.5
    return w / (points - 1)


def spectral(rows: np.ndarray, h: np.ndarray) -> np.ndarray:
    mh = np.einsum("bmi,fij->bfmj", rows, h)
    return L.logdet(mh @ L.h(mh)) @ _weights(len(h))


def spectral_gradient(rows: np.ndarray, h: np.ndarray) -> np.ndarray:
    mh = np.einsum("bmi,fij->bfmj", rows, h)
    inv = np.linalg.solve(mh @ L.h(mh), mh)
    grad = np.einsum("bfmj,fij,f->bmi", inv, h.conj(), _weights(len(h))).real
    return _tangent(rows, 2 * grad)


def adaptive(rows, objective, gradient, *, variant: int = 2, step: float = 1e-3, grow: float = 2.0, shrink: float = 0.5, tol: float = 1e-9, max_iter: int = 10_000, watch=None):
    """Descent whose step grows after an improvement and shrinks otherwise.

    variant 1 moves only on improvement, 2 always.  watch(iteration, runs,
    objectives, steps, gradient norms) sees the starts and what follows every iteration.  Returns frames, objectives
    and codes by rising objective: 1 small step, 2 small objective, 3 small
    gradient, 0 the limit of iterations.
    """
    x = orthonormal(rows)
    f = objective(x)
    g = gradient(x)
    norm = np.linalg.norm(g, axis=(-2, -1))
    step = np.full(len(x), step)
    code = np.where(norm < tol, 3, 0)
    if watch:
        watch(0, np.arange(len(x)), f, step, norm)
    for iteration in range(1, max_iter + 1):
        live = np.flatnonzero(code == 0)
        if not len(live):
            break
        new = orthonormal(x[live] - step[live, None, None] * g[live] / norm[live, None, None])
        value = objective(new)
        better = value < f[live]
        move = better if variant == 1 else np.ones(len(live), bool)
        moved = live[move]
        x[moved], f[moved] = new[move], value[move]
        if len(moved):
            g[moved] = gradient(x[moved])
            norm[moved] = np.linalg.norm(g[moved], axis=(-2, -1))
        step[live] *= np.where(better, grow, shrink)
        code[live] = np.select([step[live] < tol, np.abs(f[live]) < tol, norm[live] < tol], [1, 2, 3], 0)
        if watch:
            watch(iteration, live, f[live], step[live], norm[live])
    order = np.argsort(f, kind="stable")
    return x[order], f[order], code[order]


def armijo(rows, objective, gradient, *, step: float = 1.0, slope: float = 1e-4, back: float = 0.5, tries: int = 25, grad_tol: float = 1e-9, tol: float = 1e-12, max_iter: int = 1000, watch=None):
    """Descent with backtracking line search; codes 1 gradient, 2 objective, 3 no step found, 0 the limit.

    watch is as in adaptive, with the accepted steps (0: none) and the norms before them.
    """
    x = orthonormal(rows)
    f, code = objective(x), np.zeros(len(x), int)
    if watch:
        watch(0, np.arange(len(x)), f, np.full(len(x), step), np.linalg.norm(gradient(x), axis=(-2, -1)))
    for iteration in range(1, max_iter + 1):
        live = np.flatnonzero(code == 0)
        if not len(live):
            break
        g = gradient(x[live])
        square = (g**2).sum((-2, -1))
        code[live[np.sqrt(square) < grad_tol]] = 1
        size, todo = np.full(len(live), step), np.sqrt(square) >= grad_tol
        for _ in range(tries):
            at = np.flatnonzero(todo)
            if not len(at):
                break
            new = orthonormal(x[live[at]] - size[at, None, None] * g[at])
            value = objective(new)
            good = value <= f[live[at]] - slope * size[at] * square[at]
            done = live[at[good]]
            code[done[np.abs(f[done] - value[good]) <= tol * np.maximum(1, np.abs(f[done]))]] = 2
            x[done], f[done] = new[good], value[good]
            todo[at[good]] = False
            size[at[~good]] *= back
        code[live[todo]] = 3
        if watch:
            watch(iteration, live, f[live], np.where(todo | (code[live] == 1), 0.0, size), np.sqrt(square))
    order = np.argsort(f, kind="stable")
    return x[order], f[order], code[order]


def grassmann_distances(rows: np.ndarray) -> np.ndarray:
    """(runs, runs): largest principal angle between row spaces, 1 for a right angle."""
    s = np.linalg.svd(np.einsum("ami,bni->abmn", rows, rows), compute_uv=False)
    d = np.arccos(np.clip(s.min(-1), -1, 1)) / (np.pi / 2)
    d = (d + d.T) / 2
    np.fill_diagonal(d, 0)
    return d


def principal_angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(np.linalg.svd(a @ L.t(b), compute_uv=False), -1, 1))


def loadings(rows: np.ndarray) -> np.ndarray:
    """(runs, n): share of every channel in the row space; independent of its basis."""
    return (orthonormal(rows) ** 2).sum(-2)


def cluster(distances: np.ndarray, tolerance: float = 0.01) -> tuple[list[int], list[int]]:
    """(representatives, sizes): each takes what is nearer than the tolerance and still free, in order."""
    free, reps, sizes = np.ones(len(distances), bool), [], []
    for i in range(len(distances)):
        if free[i]:
            own = free & (distances[i] < tolerance)
            own[i] = True
            free &= ~own
            reps.append(i)
            sizes.append(int(own.sum()))
    return reps, sizes


def whiten(model: M.Innovations) -> tuple[M.Innovations, np.ndarray]:
    """The model of the outputs in which innovations are white, and the factor."""
    low = L.stable_cholesky(model.v)
    return M.Innovations(model.a, np.linalg.solve(low, model.c), model.k @ low, np.broadcast_to(np.eye(model.n), model.v.shape)), low[0]


def search(model: M.Innovations, m: int, *, runs: int = 32, seed: int = 0, initial: np.ndarray | None = None, objective: str | None = None, optimizer: str = "adaptive", lags: int | None = None, points: int = 513, tolerance: float = 0.01, max_iter: int = 10_000, var_coef: np.ndarray | None = None, options: dict | None = None) -> dict:
    """Many starts on the proxy, clusters, and spectral refinement of their representatives.

    objective: proxy or spectral runs that stage alone.  var_coef: a VAR's own
    coefficients serve as the proxy sequence of the staged search.  options:
    further arguments of the optimizer.
    """
    white, low = whiten(model)
    start = random_frames(runs, m, model.n, seed) if initial is None else np.asarray(initial, float)
    start = orthonormal(start @ low)
    run = {"adaptive": adaptive, "armijo": armijo}[optimizer]
    seq = proxy_sequence(white, lags) if var_coef is None or objective else np.linalg.solve(low, var_coef @ low)[:lags]
    h = M.transfer(white, np.linspace(0, 0.5, points))[0]
    stages = {"proxy": (lambda x: proxy(x, seq), lambda x: proxy_gradient(x, seq)), "spectral": (lambda x: spectral(x, h), lambda x: spectral_gradient(x, h))}
    x, f, code = run(start, *stages[objective or "proxy"], max_iter=max_iter, **(options or {}))
    sizes = [1] * len(x)
    if objective is None:
        reps, sizes = cluster(grassmann_distances(x), tolerance)
        x, f, code = run(x[reps], *stages["spectral"], max_iter=max_iter, **(options or {}))
    back = orthonormal(np.linalg.solve(low.T, L.t(x)).swapaxes(-1, -2))
    return {"rows": back, "white_rows": x, "objective": f, "code": code, "size": sizes}
