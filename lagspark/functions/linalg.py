"""Dense linear algebra over a leading batch axis."""

from __future__ import annotations

import numpy as np


class NotPositive(ValueError):
    """A matrix that should be positive definite isn't, whatever the jitter."""


def t(x: np.ndarray) -> np.ndarray:
    """Transpose of the last two axes."""
    return np.swapaxes(x, -1, -2)


def h(x: np.ndarray) -> np.ndarray:
    """Conjugate transpose of the last two axes."""
    return np.conj(t(x))


def symmetrise(x: np.ndarray) -> np.ndarray:
    return 0.5 * (x + t(x))


def hermitian_part(x: np.ndarray) -> np.ndarray:
    return 0.5 * (x + h(x))


def eye(n: int, like: np.ndarray | None = None) -> np.ndarray:
    i = np.eye(n)
    return i if like is None else np.broadcast_to(i, (*like.shape[:-2], n, n))


def stable_cholesky(x: np.ndarray, jitter: float = 1e-10, tries: int = 6) -> np.ndarray:
    """Lower factors; items that fail are tried again with growing jitter on their diagonal."""
    x = hermitian_part(np.asarray(x))
    try:
        return np.linalg.cholesky(x)
    except np.linalg.LinAlgError:
        pass
    flat = x.reshape(-1, *x.shape[-2:])
    out = np.empty_like(flat)
    for i, m in enumerate(flat):
        for k in range(-1, tries):
            try:
                out[i] = np.linalg.cholesky(m + (0 if k < 0 else jitter * 10**k) * np.eye(m.shape[-1]))
                break
            except np.linalg.LinAlgError:
                continue
        else:
            raise NotPositive(f"matrix {i} of the batch is not positive definite")
    return out.reshape(x.shape)


def logdet(x: np.ndarray) -> np.ndarray:
    """Log determinant of symmetric or Hermitian positive definite matrices; 0 for empty ones."""
    if x.shape[-1] == 0:
        return np.zeros(x.shape[:-2])
    return 2 * np.log(np.diagonal(stable_cholesky(x), axis1=-2, axis2=-1).real).sum(-1)


def spd_solve(x: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    low = stable_cholesky(x)
    return np.linalg.solve(h(low), np.linalg.solve(low, rhs))


def spectral_radius(x: np.ndarray) -> np.ndarray:
    return np.abs(np.linalg.eigvals(x)).max(-1)


def _small(step: np.ndarray, x: np.ndarray, rtol: float, atol: float) -> np.ndarray:
    """Which items of a batch a step has changed by no more than the tolerance."""
    size = lambda m: np.linalg.norm(m, axis=(-2, -1))
    return size(step) <= atol + rtol * np.maximum(1, size(x))


def lyapunov(a: np.ndarray, q: np.ndarray, *, method: str = "doubling", rtol: float = 1e-10, atol: float = 1e-12, max_iter: int = 100) -> np.ndarray:
    """P = A P A' + Q; items with a spectral radius of one or more, or that don't converge, are NaN."""
    a, q = np.asarray(a, float), np.asarray(q, float)
    bad = spectral_radius(a) >= 1
    if method == "direct":
        n = a.shape[-1]
        k = np.einsum("...ij,...kl->...ikjl", a, a).reshape(*a.shape[:-2], n * n, n * n)
        safe = np.where(bad[..., None, None], 0, k)
        p = np.linalg.solve(np.eye(n * n) - safe, q.reshape(*q.shape[:-2], n * n, 1)).reshape(q.shape)
    else:
        m, p = np.where(bad[..., None, None], 0, a), symmetrise(q)
        for _ in range(max_iter):
            step = m @ p @ t(m)
            p = p + step
            done = _small(step, p, rtol, atol)
            if done.all():
                break
            m = m @ m
        else:
            bad = bad | ~done
    return np.where(bad[..., None, None], np.nan, symmetrise(p))


def dare(a: np.ndarray, c: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray | None = None, *, rtol: float = 1e-12, atol: float = 1e-14, max_iter: int = 100) -> np.ndarray:
    """Filtering Riccati solution P = APA' + Q - (APC' + S)(CPC' + R)^-1(APC' + S)'.

    A cross-covariance S is first decorrelated; then structure-preserving
    doubling, which also converges for unstable A that can be detected.  Items
    that don't converge are NaN.
    """
    a, c, q, r = (np.asarray(x, float) for x in (a, c, q, r))
    r_c = spd_solve(r, c)
    if s is not None:
        rs = spd_solve(r, t(s))
        a, q = a - t(rs) @ c, symmetrise(q - s @ rs)
    n = a.shape[-1]
    f, g, x = t(a), t(c) @ r_c, q
    f, g, x = (np.broadcast_to(m, np.broadcast_shapes(f.shape, g.shape, x.shape)) for m in (f, g, x))
    one = np.eye(n)
    for _ in range(max_iter):
        w = np.linalg.solve(one + g @ x, f)
        z = np.linalg.solve(one + x @ g, t(f))
        new = symmetrise(x + t(f) @ x @ w)
        g = symmetrise(g + f @ g @ z)
        f = f @ w
        done, x = _small(new - x, new, rtol, atol), new
        if done.all():
            return x
    return np.where(done[..., None, None], x, np.nan)


def sub(x: np.ndarray, rows, cols=None) -> np.ndarray:
    """Sub-matrix by index lists."""
    rows = np.asarray(rows, int)
    cols = rows if cols is None else np.asarray(cols, int)
    return x[..., rows[:, None], cols[None, :]]
