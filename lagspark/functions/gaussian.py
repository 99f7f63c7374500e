"""Static Gaussian information measures; bits unless another base is given."""

from __future__ import annotations

import math

import numpy as np

from . import linalg as L


def entropy(cov: np.ndarray, base: float = 2.0) -> np.ndarray:
    d = cov.shape[-1]
    return 0.5 * (d * math.log(2 * math.pi * math.e) + L.logdet(cov)) / math.log(base)


def conditional_covariance(cov: np.ndarray, n_left: int) -> np.ndarray:
    left, right = list(range(n_left)), list(range(n_left, cov.shape[-1]))
    cross = L.sub(cov, left, right)
    return L.symmetrise(L.sub(cov, left) - cross @ L.spd_solve(L.sub(cov, right), L.t(cross)))


def schur(cov: np.ndarray, target, given) -> np.ndarray:
    """Covariance of target given other channels, by index lists."""
    return L.sub(cov, target) if not len(given) else conditional_covariance(L.sub(cov, [*target, *given]), len(target))


def mutual_information(cov: np.ndarray, n_left: int, base: float = 2.0) -> np.ndarray:
    left, right = list(range(n_left)), list(range(n_left, cov.shape[-1]))
    return 0.5 * (L.logdet(L.sub(cov, left)) + L.logdet(L.sub(cov, right)) - L.logdet(cov)) / math.log(base)


def mutual_information_of(cov: np.ndarray, left, right, base: float = 2.0) -> np.ndarray:
    return mutual_information(L.sub(cov, [*left, *right]), len(left), base)


def conditional_mutual_information(cov: np.ndarray, n_x: int, n_y: int, base: float = 2.0) -> np.ndarray:
    x, y, z = (list(range(a, b)) for a, b in ((0, n_x), (n_x, n_x + n_y), (n_x + n_y, cov.shape[-1])))
    if not (x and y and z):
        raise ValueError("X, Y and Z are not empty")
    return 0.5 * (L.logdet(L.sub(cov, x + z)) + L.logdet(L.sub(cov, y + z)) - L.logdet(L.sub(cov, z)) - L.logdet(cov)) / math.log(base)


def total_correlation(cov: np.ndarray, base: float = 2.0) -> np.ndarray:
    return 0.5 * (np.log(np.diagonal(cov, axis1=-2, axis2=-1)).sum(-1) - L.logdet(cov)) / math.log(base)


def dual_total_correlation(cov: np.ndarray, base: float = 2.0) -> np.ndarray:
    inv = L.spd_solve(cov, L.eye(cov.shape[-1], cov))
    return 0.5 * (L.logdet(cov) + np.log(np.diagonal(inv, axis1=-2, axis2=-1)).sum(-1)) / math.log(base)


def o_information(cov: np.ndarray, base: float = 2.0) -> np.ndarray:
    return total_correlation(cov, base) - dual_total_correlation(cov, base)


def s_information(cov: np.ndarray, base: float = 2.0) -> np.ndarray:
    return total_correlation(cov, base) + dual_total_correlation(cov, base)


def quadratic(x: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """x' cov^-1 x per row of x (batch, rows, d)."""
    w = np.linalg.solve(L.stable_cholesky(cov), L.t(x))
    return (w * w).sum(-2)


def local_mutual_information(samples: np.ndarray, cov: np.ndarray, n_left: int, mean: np.ndarray | None = None, base: float = 2.0) -> np.ndarray:
    """(batch, rows): log density ratio of joint and product at each sample."""
    x = samples - (0 if mean is None else mean[..., None, :])
    left, right = list(range(n_left)), list(range(n_left, cov.shape[-1]))
    mi = mutual_information(cov, n_left, math.e)
    q = quadratic(x[..., left], L.sub(cov, left)) + quadratic(x[..., right], L.sub(cov, right)) - quadratic(x, cov)
    return (mi[..., None] + 0.5 * q) / math.log(base)


def pairwise_mutual_information(cov: np.ndarray, base: float = 2.0) -> np.ndarray:
    sd = np.sqrt(np.diagonal(cov, axis1=-2, axis2=-1))
    rho = cov / (sd[..., :, None] * sd[..., None, :])
    n = cov.shape[-1]
    rho[..., np.arange(n), np.arange(n)] = 0
    return -0.5 * np.log1p(-rho * rho) / math.log(base)


def log_likelihood(errors: np.ndarray, cov: np.ndarray, reduction: str = "sum") -> np.ndarray:
    """Gaussian log-likelihood of errors (batch, rows, n)."""
    n = errors.shape[-1]
    each = -0.5 * (quadratic(errors, cov) + L.logdet(cov)[..., None] + n * math.log(2 * math.pi))
    return each if reduction == "none" else each.sum(-1) if reduction == "sum" else each.mean(-1)
