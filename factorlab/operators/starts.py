"""Starting bases from all samples (col, y ARRAY<DOUBLE>), by plans: the same basis whatever the partitioning.

nndsvd takes the left singular vectors from the P x P Gram of one pass and the norms of the right ones' signed parts from a
second. kmeans seeds by k-means||: in each round every sample becomes a candidate with a probability that grows with its
distance to the candidates so far, by a hash of its id; the few candidates, weighted by the samples nearest to them, are
clustered on the driver, and Lloyd's steps are a pass each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dense import kmeans, nndsvd_from_parts
from .algebra import _matrix, gram_numpy, whole


def _folded(rows: DataFrame, columns: list[str], fold, size: int) -> np.ndarray:
    """Sum over all batches of fold(*arrays), a vector of that size."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += fold(*(_matrix(c) if pa.types.is_list(c.type) else c.to_numpy() for c in batch.columns))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["k", "v"])

    found = rows.select(*columns).mapInArrow(run, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(size)
    out[found["k"].to_numpy()] = found["v"].to_numpy()
    return out


def nndsvd_samples(samples: DataFrame, rank: int, seed: int = 123) -> np.ndarray:
    """P x rank; of each singular pair the sign part of more mass, of left and right vector."""
    samples = samples.where(whole("y"))
    left = gram_numpy(samples, "y", "y")
    values, vectors = np.linalg.eigh(left)
    values, vectors = values[::-1][:rank], vectors[:, ::-1][:, :rank]
    p, q = vectors.shape

    def parts(y):
        v = y @ vectors
        return np.concatenate([(np.maximum(v, 0) ** 2).sum(axis=0), (np.maximum(-v, 0) ** 2).sum(axis=0), [y.sum(), y.size]])

    found = _folded(samples, ["y"], parts, 2 * q + 2)
    mean = found[-2] / max(found[-1], 1)
    return nndsvd_from_parts(values, vectors, np.sqrt(found[:q]), np.sqrt(found[q : 2 * q]), rank, float(mean), np.random.default_rng(seed))


def _squared(y: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((y**2).sum(axis=1)[:, None] - 2 * y @ centres.T + (centres**2).sum(axis=1), 0.0)


def kmeans_samples(samples: DataFrame, rank: int, seed: int = 123, rounds: int = 5, steps: int = 100) -> np.ndarray:
    """P x rank centroids. Samples are told apart by col; at most about 2 rank candidates a round come to the driver."""
    samples = samples.where(whole("y") & F.col("col").isNotNull())
    draw = lambda turn: (F.pmod(F.xxhash64("col", F.lit(seed), F.lit(turn)), F.lit(1 << 40)) / float(1 << 40)).alias("u")
    first = samples.select("y", draw(0)).orderBy("u", F.col("y")).limit(1).collect()
    if not first:
        raise ValueError("no samples to start from")
    candidates = np.array([first[0]["y"]], float)
    spread = _folded(samples, ["y"], lambda y: np.array([_squared(y, candidates).min(axis=1).sum()]), 1)[0]
    for turn in range(1, rounds + 1):
        if spread <= 0:
            break
        now, cost = candidates, spread

        def drawn(batches, now=now, cost=cost):
            for batch in batches:
                if batch.num_rows:
                    y, u = _matrix(batch.column(0)), batch.column(1).to_numpy()
                    yield batch.filter(pa.array(u < 2 * rank * _squared(y, now).min(axis=1) / cost))

        found = samples.select("y", draw(turn)).mapInArrow(drawn, "y array<double>, u double").orderBy("u").collect()
        candidates = np.concatenate([candidates, np.array([r["y"] for r in found], float).reshape(-1, candidates.shape[1])])
        spread = _folded(samples, ["y"], lambda y, c=candidates: np.array([_squared(y, c).min(axis=1).sum()]), 1)[0]
    candidates = np.unique(candidates, axis=0)
    rng = np.random.default_rng(seed)
    if len(candidates) <= rank:
        extra = candidates[rng.integers(0, len(candidates), rank - len(candidates))] * rng.uniform(0.5, 1.5, (rank - len(candidates), 1))
        return np.concatenate([candidates, extra]).T
    weight = _folded(samples, ["y"], lambda y: np.bincount(_squared(y, candidates).argmin(axis=1), minlength=len(candidates)).astype(float), len(candidates))
    tries = [kmeans(candidates.T, rank, rng, plusplus=True, weights=weight).T for _ in range(10)]
    centres = min(tries, key=lambda c: float((weight * _squared(candidates, c).min(axis=1)).sum()))
    p = centres.shape[1]
    for _ in range(steps):
        now = centres

        def sums(y, now=now):
            one = np.eye(rank)[_squared(y, now).argmin(axis=1)]
            return np.concatenate([(one.T @ y).ravel(), one.sum(axis=0)])

        found = _folded(samples, ["y"], sums, rank * p + rank)
        size = found[rank * p :]
        new = np.where(size[:, None] > 0, found[: rank * p].reshape(rank, p) / np.maximum(size, 1)[:, None], now)
        centres = new
        if np.allclose(new, now):
            break
    return centres.T


def start(samples: DataFrame, rank: int, how: str = "kmeans", seed: int = 123) -> np.ndarray:
    """A basis by name, as fit.initial_basis() makes it of arrays."""
    p = len(samples.select("y").first()[0])
    rng = np.random.default_rng(seed)
    if how == "deterministic":
        return 1.0 + (np.arange(1, p + 1)[:, None] * np.arange(1, rank + 1)[None, :] * 7) % 5
    if how == "runif":
        return rng.uniform(0, 1, (p, rank))
    if how == "nndsvd":
        return nndsvd_samples(samples, rank, seed)
    if how not in ("kmeans", "kmeans++", "kmeansar"):
        raise ValueError(f"unknown start {how!r}")
    x = kmeans_samples(samples, rank, seed)
    if how == "kmeansar":
        scale = math.fsum(x.ravel()) / x.size / 100
        x = np.where(x == 0, rng.uniform(0, 1, x.shape) * scale, x)
    return x
