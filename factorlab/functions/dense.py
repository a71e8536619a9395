"""NumPy side of the matrix operations that the update steps are written in, and small dense numerics."""

from __future__ import annotations

import math

import numpy as np


class Dense:
    """Operations on arrays; sums keep their axes."""

    pos = staticmethod(lambda x: np.maximum(x, 0.0))
    log = staticmethod(np.log)
    power = staticmethod(np.power)

    @staticmethod
    def sum(x, axis=None):
        return np.sum(x, axis=axis, keepdims=True)

    @staticmethod
    def const(x):
        return np.asarray(x, float)

    @staticmethod
    def done(*xs):
        return xs


def offdiag(xp, n: int):
    return xp.const(1.0 - np.eye(n))


def path_neighbours(n: int) -> np.ndarray:
    """Adjacency of the path over n rows."""
    return np.eye(n, k=1) + np.eye(n, k=-1)


def upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def spectral_radius(m: np.ndarray) -> float:
    return float(np.abs(np.linalg.eigvals(m)).max()) if m.size else 0.0


def distances(points: np.ndarray) -> np.ndarray:
    """Euclidean distances between the columns of points."""
    sq = (points**2).sum(axis=0)
    return np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * points.T @ points, 0.0))


def cophenetic(d: np.ndarray, method: str) -> np.ndarray:
    """Cophenetic distances of agglomerative clustering with complete or average linkage; first of ties merges."""
    n = len(d)
    now, out = d.astype(float).copy(), np.zeros((n, n))
    np.fill_diagonal(now, np.inf)
    groups = {i: [i] for i in range(n)}
    for _ in range(n - 1):
        i, j = divmod(int(np.argmin(now)), n)
        i, j = min(i, j), max(i, j)
        height = now[i, j]
        for a in groups[i]:
            out[a, groups[j]] = out[groups[j], a] = height
        if method == "complete":
            row = np.maximum(now[i], now[j])
        else:
            p, q = len(groups[i]), len(groups[j])
            row = (p * now[i] + q * now[j]) / (p + q)
        now[i], now[:, i] = row, row
        now[j], now[:, j] = np.inf, np.inf
        now[i, i] = np.inf
        groups[i] += groups.pop(j)
    return out


def correlation(x: np.ndarray, y: np.ndarray) -> float | None:
    x, y = x - x.mean(), y - y.mean()
    den = math.sqrt(float((x**2).sum() * (y**2).sum()))
    return float((x * y).sum() / den) if den > 0 else None


def kmeans(points: np.ndarray, k: int, rng: np.random.Generator, plusplus: bool = False, steps: int = 100, weights: np.ndarray | None = None) -> np.ndarray:
    """Centroids (features x k) of the columns of points, by Lloyd's steps; empty clusters keep their centre. weights: of points."""
    n = points.shape[1]
    w = np.ones(n) if weights is None else weights
    if plusplus:
        chosen = [int(rng.integers(n)) if weights is None else int(rng.choice(n, p=w / w.sum()))]
        while len(chosen) < k:
            d2 = w * ((points[:, :, None] - points[:, None, chosen]) ** 2).sum(axis=0).min(axis=1)
            chosen.append(int(rng.choice(n, p=d2 / d2.sum())) if d2.sum() > 0 else int(rng.integers(n)))
    else:
        chosen = rng.choice(n, k, replace=False)
    centres = points[:, chosen].astype(float)
    for _ in range(steps):
        label = ((points**2).sum(axis=0)[:, None] - 2 * points.T @ centres + (centres**2).sum(axis=0)).argmin(axis=1)
        new = np.stack([np.average(points[:, label == j], axis=1, weights=w[label == j]) if w[label == j].sum() > 0 else centres[:, j] for j in range(k)], axis=1)
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def nndsvd_from_parts(values: np.ndarray, vectors: np.ndarray, positive: np.ndarray, negative: np.ndarray, k: int, mean: float, rng: np.random.Generator) -> np.ndarray:
    """Non-negative basis from the leading eigenpairs of YY' and the norms of the positive and negative parts of Y' u.

    For each vector the part (positive or negative) of more mass is kept; zeros become small random numbers around mean.
    """
    out = np.zeros((len(vectors), k))
    for q in range(min(k, len(values))):
        if values[q] <= 0:
            continue
        u, scale = vectors[:, q], math.sqrt(values[q])
        if q == 0:
            out[:, 0] = math.sqrt(scale) * np.abs(u)
            continue
        up, un = np.maximum(u, 0), np.maximum(-u, 0)
        mp, mn = np.linalg.norm(up) * positive[q] / scale, np.linalg.norm(un) * negative[q] / scale
        part, mass = (up, mp) if mp >= mn else (un, mn)
        if mass > 0:
            out[:, q] = math.sqrt(scale * mass) * part / max(np.linalg.norm(part), 1e-300)
    zero = out <= 0
    out[zero] = mean * rng.uniform(0, 0.01, int(zero.sum())) + 1e-12
    return out


def nndsvd(gram_left: np.ndarray, cross: np.ndarray, k: int, mean: float, rng: np.random.Generator) -> np.ndarray:
    """nndsvd_from_parts() of the P x P Gram matrix YY' and of cross, Y' (N x P)."""
    values, vectors = np.linalg.eigh(gram_left)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    v = cross @ vectors
    norm = lambda m: np.sqrt((np.maximum(m, 0) ** 2).sum(axis=0))
    return nndsvd_from_parts(values, vectors, norm(v), norm(-v), k, mean, rng)
