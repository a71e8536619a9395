"""Resampling from sums over samples: a held-out fold or a bootstrap replicate costs no pass and no dense data of its own.

Squared error with covariates needs YA', AA', the squared norm of Y and the number of samples only. One pass gives these for
every fold: a training set is the total less its fold, and the held-out loss comes from the fold's own sums. A replicate's
counts or multipliers are a function of the sample's number and the replicate's, so one pass gives the sums of all replicates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dense import Dense
from ..sources.cells import rows_and_gaps, samples
from . import prep, steps
from .algebra import _matrix, gram_numpy
from .fit import Fit, _loop, _offdiag2, centroid_order, equilibrium, initial_basis
from .order import ranked
from .storage import freed, stored

#: Doubles of the block of outer products that a task holds at a time.
BLOCK = 1 << 21


@dataclass(frozen=True)
class Sums:
    """Of a set of samples: YA' (P x R), AA' (R x R), the squared norm of Y, and the number of samples."""

    ya: np.ndarray
    aa: np.ndarray
    yy: float
    n: float

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.ya - other.ya, self.aa - other.aa, self.yy - other.yy, self.n - other.n)

    def loss(self, m: np.ndarray) -> float:
        """Squared error of Y ~ M A."""
        return self.yy - 2 * float((m * self.ya).sum()) + float(((m.T @ m) * self.aa).sum())


def paired_samples(y: DataFrame, a: DataFrame, *, signed: bool = False) -> tuple[DataFrame, list, list]:
    """((col, y, a), rows, covariates) of the samples that are in both cells tables; the sums can't mask, so a missing value in
    either is an error, and so is a negative one unless signed."""
    (rows, gaps), (covariates, unknown) = rows_and_gaps(y), rows_and_gaps(a)
    if gaps or unknown:
        raise ValueError("sums over samples need complete Y and A")
    if not signed and (y.where("value < 0").limit(1).count() or a.where("value < 0").limit(1).count()):
        raise ValueError("Y and A must be non-negative")
    return samples(y, rows, "y").join(samples(a, covariates, "a"), "col"), rows, covariates


def placed_samples(both: DataFrame) -> DataFrame:
    """The samples, written down, with pos: their number by col, from 1."""
    both = stored(both)
    number = ranked(both.select("col"), ["col"]).select("col", (F.col("at") + 1).alias("pos"))
    return stored(both.join(number, "col"))


def fold_sums(placed: DataFrame, p: int, r: int, k: int, seed: int = 123, shuffle: bool = True) -> list[Sums]:
    """Sums of folds 1..k of the samples (col, pos, y, a), in one pass over them; folds are those of resample.column_folds."""
    size = p * r + r * r + 2

    def fold(batches):
        total = np.zeros((k, size))
        for batch in batches:
            if not batch.num_rows:
                continue
            of, y, a = batch.column(0).to_numpy(), _matrix(batch.column(1)), _matrix(batch.column(2))
            for f in np.unique(of):
                u, v = y[of == f], a[of == f]
                total[f - 1] += np.concatenate([(u.T @ v).ravel(), (v.T @ v).ravel(), [float((u**2).sum()), len(u)]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["k", "v"])

    known = prep.folds(placed.select("pos"), k, "pos", seed=seed, shuffle=shuffle)
    rows = placed.join(known, "pos").select("fold", "y", "a").mapInArrow(fold, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros(k * size)
    total[rows["k"].to_numpy()] = rows["v"].to_numpy()
    return [Sums(t[: p * r].reshape(p, r), t[p * r : -2].reshape(r, r), float(t[-2]), float(t[-1])) for t in total.reshape(k, size)]


def total(parts: list[Sums]) -> Sums:
    return Sums(sum(s.ya for s in parts), sum(s.aa for s in parts), sum(s.yy for s in parts), sum(s.n for s in parts))


def fit_sums(
    s: Sums, rank: int, family: str = "nmf", *, rank2: int | None = None, init="nndsvd", c_init=None, cn_init=None, x2_init=None, epsilon: float = 1e-4, maxit: int = 5000, seed: int = 123, restriction: str = "colSums", c_l1: float = 0.0, c_l2: float = 0.0, l2_ortho: float = 0.0,
    l2_smooth: float = 0.0, ortho2: float = 0.0, fixed_iterations: int | None = None,
) -> Fit:
    """A fit of family nmf, signed, rrr or rrr_signed from sums alone. init: a basis, or how one is made of YA' (whose columns
    are sums of all samples, weighted by their covariates); coefficients start at the least-squares ones, nmf's at 1."""
    x = initial_basis(np.maximum(s.ya, 0), rank, init, seed) if isinstance(init, str) else np.array(init, float)
    maxit, epsilon = (fixed_iterations, -1.0) if fixed_iterations else (maxit, epsilon)
    start = lambda right: np.linalg.pinv(x) @ s.ya @ np.linalg.pinv(s.aa) @ right
    given = lambda m, other: other if m is None else np.array(m, float)
    relative = {"first": 2, "floor": steps.EPS, "absolute": False}
    if family == "nmf":
        state = x, given(c_init, np.ones((rank, len(s.aa))))
        step = lambda x, c: steps.core_eu(Dense, x, c, s.ya, s.aa, c_l1, l2_ortho, l2_smooth, restriction)
        whole, relative = (lambda x, c: x @ c), {}
    elif family == "signed":
        c = start(np.eye(len(s.aa)))
        state = x, given(c_init, np.maximum(c, 0) + 1e-3), given(cn_init, np.maximum(-c, 0) + 1e-3)
        positive, negative = np.maximum(s.aa, 0), np.maximum(-s.aa, 0)
        step = lambda x, cp, cn: steps.signed(Dense, x, cp, cn, s.ya, positive, negative, c_l2, l2_ortho, restriction)
        whole = lambda x, cp, cn: x @ (cp - cn)
    elif family in ("rrr", "rrr_signed"):
        x2 = given(x2_init, initial_basis(s.aa, rank2 or rank, "nndsvd", seed).T)
        x2 = x2 if x2_init is not None else x2 / x2.sum(axis=1, keepdims=True)
        c = start(np.linalg.pinv(x2))
        if family == "rrr":
            state = x, given(c_init, np.maximum(c, 1e-8)), x2
            step = lambda x, c, x2: steps.reduced_rank(Dense, x, c, x2, s.ya, s.aa, c_l1, l2_ortho, ortho2)
            whole = lambda x, c, x2: x @ c @ x2
        else:
            state = x, given(c_init, np.maximum(c, 0) + 1e-3), given(cn_init, np.maximum(-c, 0) + 1e-3), x2
            step = lambda x, cp, cn, x2: steps.signed_reduced_rank(Dense, x, cp, cn, x2, s.ya, s.aa, c_l2, l2_ortho, ortho2)
            whole = lambda x, cp, cn, x2: x @ (cp - cn) @ x2
    else:
        raise ValueError("family is nmf, signed, rrr or rrr_signed")

    def value(*state):
        penalty = l2_ortho / 2 * _offdiag2(state[0]) + l2_smooth / 2 * float((np.diff(state[0], axis=0) ** 2).sum())
        penalty += c_l1 * float(state[1].sum()) if family in ("nmf", "rrr") else c_l2 * float((state[1] ** 2).sum() + (state[2] ** 2).sum()) / 2
        return s.loss(whole(*state)) + penalty + (ortho2 / 2 * _offdiag2(state[-1].T) if "rrr" in family else 0.0)

    state, trace, i, ok = _loop(step, value, state, maxit, epsilon, **relative)
    order = centroid_order(state[0]) if restriction != "fixed" else np.arange(state[0].shape[1])
    x, m = state[0][:, order], whole(*state)
    if family == "nmf":
        return Fit("nmf", x, state[1][order], s.loss(m), tuple(trace), i, ok)
    if family == "signed":
        cp, cn = state[1][order], state[2][order]
        return Fit("signed", x, cp - cn, s.loss(m), tuple(trace), i, ok, extra={"cp": cp, "cn": cn})
    inner = centroid_order(state[-1].T)
    parts = [c[order][:, inner] for c in state[1:-1]]
    c = parts[0] if family == "rrr" else parts[0] - parts[1]
    return Fit(family, x, c, s.loss(m), tuple(trace), i, ok, extra={"x2": state[-1][inner]} | ({} if family == "rrr" else {"cp": parts[0], "cn": parts[1]}))


def coefficients(fit: Fit) -> np.ndarray:
    """M of Y ~ M A."""
    return fit.x @ fit.c @ fit.extra["x2"] if fit.family in ("rrr", "rrr_signed") else fit.x @ fit.c


def cv_sums(spark: SparkSession, y: DataFrame, a: DataFrame, ranks=(2,), k: int = 5, seed: int = 123, shuffle: bool = True, family: str = "nmf", ranks2=None, **options) -> DataFrame:
    """Column-wise cross-validation of cells, of any number of samples: (rank[, rank2], loss, sigma).

    One pass over the samples; the (rank, fold) fits are a grid of tasks that share k sums of the model's size. The loss is the
    squared error over all held-out cells. ranks2: ranks of X2, tried with every rank (reduced-rank families).
    """
    from .resample import run_grid

    both, rows, covariates = paired_samples(y, a, signed="signed" in family)
    placed = placed_samples(both)
    if not 2 <= k <= placed.count():
        raise ValueError("the number of folds lies between 2 and the number of samples")
    parts = fold_sums(placed, len(rows), len(covariates), k, seed, shuffle)
    freed(placed)
    everything = total(parts)

    def work(shared, rank, rank2, fold):
        parts, everything = shared
        held = parts[int(fold) - 1]
        fit = fit_sums(everything - held, int(rank), family, rank2=int(rank2), seed=seed, **options)
        yield {"rank": int(rank), "rank2": int(rank2), "fold": int(fold), "loss": held.loss(coefficients(fit)), "n": int(held.n) * len(held.ya)}

    pairs = [(q, q) for q in ranks] if ranks2 is None else [(q, r) for q in ranks for r in ranks2]
    tasks = [{"rank": int(q), "rank2": int(r), "fold": f} for q, r in pairs for f in range(1, k + 1)]
    scores = run_grid(spark, tasks, work, "rank int, rank2 int, fold int, loss double, n bigint", (parts, everything))
    by = ["rank"] if ranks2 is None else ["rank", "rank2"]
    loss = F.sum("loss") / F.sum("n")
    return scores.groupBy(*by).agg(loss.alias("loss"), F.sqrt(loss).alias("sigma")).orderBy(*by)


# ---------------------------------------------------------------- replicates

_PRIME = (1 << 31) - 1
#: P(count <= k) of a Poisson variable of mean 1.
_COUNTS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(13)])


def uniforms(pos: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """len(pos) x len(replicates) numbers in (0, 1): the fifth power, a bijection modulo 2^31 - 1, of a combination of the two."""
    x = (pos.astype(np.int64)[:, None] * 7919 + replicates.astype(np.int64) * 104729 + seed * 1000003) % _PRIME
    y = x * x % _PRIME
    return (y * y % _PRIME * x % _PRIME + 0.5) / _PRIME


def replicate_weights(pos: np.ndarray, replicates: np.ndarray, kind: str = "pairs", seed: int = 123) -> np.ndarray:
    """len(pos) x len(replicates): counts of a pair bootstrap (Poisson of mean 1: the number of samples varies, as no sample
    knows the others' counts), or multipliers rademacher, exp or mammen of mean 0 and variance 1."""
    u = uniforms(pos, replicates, seed)
    if kind == "pairs":
        return np.searchsorted(_COUNTS, u.ravel(), side="left").reshape(u.shape).astype(float)
    if kind == "rademacher":
        return np.where(u < 0.5, -1.0, 1.0)
    if kind == "exp":
        return -np.log1p(-u) - 1
    if kind == "mammen":
        root = math.sqrt(5)
        return np.where(u < (root + 1) / (2 * root), (1 - root) / 2, (1 + root) / 2)
    raise ValueError("weights are pairs, rademacher, exp or mammen")


def replicate_sums(placed: DataFrame, left, right, replicates: int, kind: str = "pairs", seed: int = 123) -> DataFrame:
    """(replicate, values ARRAY<DOUBLE>): for each replicate from 1 the weighted sum of left_n right_n', row after row.

    left, right: functions of the matrices (y, a) of a block of samples (a row each) that give a row for each sample. A task
    folds its samples into one sum a replicate and cell; what is shuffled is that, whatever the number of samples.
    """
    numbers = np.arange(1, replicates + 1)

    def fold(batches):
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            pos, y, a = batch.column(0).to_numpy(), _matrix(batch.column(1)), _matrix(batch.column(2))
            u, v = left(y, a), right(y, a)
            size = u.shape[1] * v.shape[1]
            out = np.zeros((replicates, size)) if out is None else out
            for at in range(0, len(pos), step := max(1, BLOCK // max(size, replicates))):
                part = slice(at, at + step)
                products = (u[part, :, None] * v[part, None, :]).reshape(-1, size)
                out += replicate_weights(pos[part], numbers, kind, seed).T @ products
        if out is not None:
            r, c = np.indices(out.shape)
            for at in range(0, out.size, 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(r.ravel()[part] + 1), pa.array(c.ravel()[part]), pa.array(out.ravel()[part])], ["replicate", "k", "v"])

    return _gathered(placed.select("pos", "y", "a").mapInArrow(fold, "replicate bigint, k bigint, v double"))


def _gathered(parts: DataFrame) -> DataFrame:
    cells = parts.groupBy("replicate", "k").agg(F.sum("v").alias("v"))
    grouped = cells.groupBy("replicate").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("x"))  # of the model's size
    return grouped.select("replicate", F.transform("x", lambda e: e["v"]).alias("values"))


def each_replicate(sums: DataFrame, work, schema: str) -> DataFrame:
    """work(replicate, values) -> iterable of rows, for each row of replicate_sums(); the replicates' fits are dealt out."""
    import pandas as pd

    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches) -> Iterator:
        for batch in batches:
            rows = [row for b, v in zip(batch["replicate"], batch["values"], strict=True) for row in work(int(b), np.asarray(v, float))]
            yield pd.DataFrame(rows, columns=names)

    return sums.mapInPandas(run, schema)


def wild_sums(placed: DataFrame, m: np.ndarray, replicates: int, kind: str = "rademacher", seed: int = 123, clip: bool = True) -> DataFrame:
    """replicate_sums() of Y* A', where Y* is the fit M A plus the residuals times a multiplier a sample, cut at 0 with clip."""
    numbers = np.arange(1, replicates + 1)
    size = m.size

    def fold(batches):
        out = np.zeros((replicates, size))
        for batch in batches:
            if not batch.num_rows:
                continue
            pos, y, a = batch.column(0).to_numpy(), _matrix(batch.column(1)), _matrix(batch.column(2))
            hat = a @ m.T
            w = replicate_weights(pos, numbers, kind, seed)
            for b in range(replicates):
                again = hat + (y - hat) * w[:, b : b + 1]
                out[b] += ((np.maximum(again, 0) if clip else again).T @ a).ravel()
        r, c = np.indices(out.shape)
        for at in range(0, out.size, 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(r.ravel()[part] + 1), pa.array(c.ravel()[part]), pa.array(out.ravel()[part])], ["replicate", "k", "v"])

    return _gathered(placed.select("pos", "y", "a").mapInArrow(fold, "replicate bigint, k bigint, v double"))


def feedback_sums(s11, s12, s22, x, c1, c2, *, l2_ortho: float = 0.0, c1_l1: float = 1.0, c2_l1: float = 0.1, epsilon: float = 1e-6, maxit: int = 20000, held: bool = False):
    """(x, c1, c2, trace, converged) of Y1 ~ X (C1 Y1 + C2 Y2) from Y1 Y1', Y1 Y2' and Y2 Y2'; held: X stays as it is."""

    def value(x, c1, c2):
        cross = c1 @ s12 @ c2.T
        mm = c1 @ s11 @ c1.T + cross + cross.T + c2 @ s22 @ c2.T
        return float(np.trace(s11)) - 2 * float((x * (s11 @ c1.T + s12 @ c2.T)).sum()) + float(((x.T @ x) * mm).sum())

    def step(x, c1, c2):
        new = steps.feedback(Dense, x, c1, c2, s11, s12, s22, l2_ortho, c1_l1, c2_l1)
        return new if not held else steps.feedback_paths(Dense, x, c1, c2, s11, s12, s22, c1_l1, c2_l1)

    (x, c1, c2), trace, _, ok = _loop(step, value, (x, c1, c2), maxit, epsilon)
    return x, c1, c2, trace, ok


def fit_ffb_sums(y1: DataFrame, y2: DataFrame, rank: int, *, init="nndsvd", c1_init=None, c2_init=None, l2_ortho: float = 100.0, c1_l1: float = 1.0, c2_l1: float = 0.1, epsilon: float = 1e-6, maxit: int = 20000, seed: int = 123) -> Fit:
    """nmf_ffb() of cells of any number of samples, from Y1 Y1', Y1 Y2' and Y2 Y2' of one pass; what compares samples with their
    fitted values (mae, sc_cov, sc_map) is left out. init: a basis, or how one is made of Y1 Y2'."""
    both, rows, exogenous = paired_samples(y1, y2)
    s, p = gram_numpy(both.select(F.concat("y", "a").alias("z")), "z", "z"), len(rows)
    if not s.size:
        raise ValueError("Y1 and Y2 have no samples in common")
    s11, s12, s22 = s[:p, :p], s[:p, p:], s[p:, p:]
    x = initial_basis(s12, rank, init, seed)
    x = x / x.sum(axis=0, keepdims=True)
    c1 = np.random.default_rng(seed).uniform(0, 0.1, (rank, p)) if c1_init is None else np.array(c1_init, float)
    warm = lambda: fit_sums(Sums(s12, s22, float(np.trace(s11)), 0.0), rank, init=x, restriction="fixed", fixed_iterations=100).c
    c2 = warm() if c2_init is None else np.array(c2_init, float)
    x, c1, c2, trace, ok = feedback_sums(s11, s12, s22, x, c1, c2, l2_ortho=l2_ortho, c1_l1=c1_l1, c2_l1=c2_l1, epsilon=epsilon, maxit=maxit)
    order = centroid_order(x)
    x, c1, c2 = x[:, order], c1[order], c2[order]
    return Fit("ffb", x, c1, trace[-1], tuple(trace), len(trace), ok, "EU", rows, exogenous, extra={"c2": c2} | equilibrium(x, c1, c2))
