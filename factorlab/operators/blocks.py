"""Fits beyond the driver's size: weights, missing cells, Kullback-Leibler loss, with covariates or without; a pass an iteration.

Samples are rows (col, y[, w][, a]); a task folds its samples in blocks. With covariates the coefficients are the model's, and
an iteration needs two P x R sums, of what pulls a cell up and down times its sample's covariates. Without, a sample's
coefficients stay beside it: the pass that renews them with the next basis also gives the sums for the one after.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dense import Dense
from . import steps
from .algebra import _matrix
from .fit import Fit, _loss, _offdiag2, centroid_order
from .starts import _folded, start
from .storage import freed, stored


def masked_samples(cells: DataFrame, rows: list) -> DataFrame:
    """(col, y, w) in the order of rows. A null or NaN value has weight 0; an absent cell is an observed 0, or has weight 0
    where the cells have weights."""
    number = F.col("value").cast("double")
    known = number.isNotNull() & ~F.isnan(number)
    weighted = "weight" in cells.columns
    given = F.coalesce(F.nanvl(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)) if weighted else F.lit(1.0)
    w = F.when(known, given).otherwise(0.0)
    cell = F.struct(F.when(known & (w > 0), number).otherwise(0.0).alias("y"), w.alias("w"))
    held = cells.groupBy("col").agg(F.map_from_entries(F.collect_list(F.struct("row", cell))).alias("m"))  # a sample's features
    at = lambda r, f, none: F.coalesce(F.try_element_at("m", r)[f], F.lit(none))
    order = F.array(*[F.lit(r) for r in rows])
    return held.select("col", F.transform(order, lambda r: at(r, "y", 0.0)).alias("y"), F.transform(order, lambda r: at(r, "w", 0.0 if weighted else 1.0)).alias("w"))


def starting_basis(samples: DataFrame, rank: int, how: str, seed: int) -> np.ndarray:
    """A basis of the samples with what they miss filled by the features' weighted means."""
    p = len(samples.select("y").first()[0])
    found = _folded(samples, ["y", "w"], lambda y, w: np.concatenate([(w * y).sum(axis=0), w.sum(axis=0)]), 2 * p)
    mean = F.array(*[F.lit(float(v)) for v in found[:p] / np.maximum(found[p:], 1e-12)])
    both = F.arrays_zip("y", "w", mean.alias("mean"))
    return start(samples.select("col", F.transform(both, lambda c: F.when(c["w"] > 0, c["y"]).otherwise(c["mean"])).alias("y")), rank, how, seed)


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """Sum of rows of arrays, one a task."""
    rows = parts.select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(size)
    out[rows["k"].to_numpy()] = rows["v"].to_numpy()
    return out


def nmf_by_blocks(
    samples: DataFrame, rank: int, *, method: str = "EU", init="kmeans", c_init=None, restriction: str = "colSums", epsilon: float = 1e-4, maxit: int = 5000, seed: int = 123, c_l1: float = 0.0, l2_ortho: float = 0.0, l2_smooth: float = 0.0, fixed_iterations: int | None = None
) -> Fit:
    """fit.nmf() of samples (col, y, w[, a]) of any number, to rounding the same factors from the same start.

    Without a, c has no columns and extra["b"] is the table (col, b ARRAY<DOUBLE>) of the samples' coefficients. The trace is
    the objective after each step, as the pass of the next one finds it.
    """
    kl, covariates = method == "KL", "a" in samples.columns
    samples = stored(samples)
    head = samples.first()
    if head is None:
        raise ValueError("no samples")
    p, r = len(head["y"]), len(head["a"]) if covariates else 0
    low = samples.agg(F.min(F.array_min("y")), F.min(F.array_min("a")) if covariates else F.lit(0.0)).first()
    if min(low) < 0:
        raise ValueError("Y and A must be non-negative")
    x = starting_basis(samples, rank, init, seed) if isinstance(init, str) else np.array(init, float)
    limit = fixed_iterations or maxit
    penalty = lambda x, c: l2_ortho / 2 * _offdiag2(x) + l2_smooth / 2 * float((np.diff(x, axis=0) ** 2).sum()) + c_l1 * c
    shift = c_l1 if kl else c_l1 / 2
    basis = lambda x, up, down: steps._basis(Dense, x, up, down, l2_ortho, l2_smooth, restriction)
    trace: list[float] = []

    def settled(loss: float) -> bool:
        trace.append(loss)
        return not fixed_iterations and len(trace) >= 10 and abs(trace[-1] - trace[-2]) / max(abs(trace[-1]), 1.0) <= epsilon

    if covariates:
        c = np.ones((rank, r)) if c_init is None else np.array(c_init, float)

        def sums(x, c):
            def fold(y, w, a):
                hat = x @ (c @ a.T)
                up, down = steps._pulls(Dense, y.T, hat, w.T, kl)
                return np.concatenate([(up @ a).ravel(), (down @ a).ravel(), [_loss(y.T, hat, w.T, method)]])

            found = _folded(samples, ["y", "w", "a"], fold, 2 * p * r + 1)
            return found[: p * r].reshape(p, r), found[p * r : -1].reshape(p, r), float(found[-1])

        i, ok = 0, False
        up, down, loss = sums(x, c)
        while i < limit and not ok:
            i += 1
            new = basis(x, up @ c.T, down @ c.T)
            x, c = new, c * ((new.T @ up) / (new.T @ down + shift + steps.EPS))
            up, down, loss = sums(x, c)
            ok = settled(loss + penalty(x, float(c.sum())))
        freed(samples)
        order = centroid_order(x) if restriction != "fixed" and rank > 1 else np.arange(rank)
        return Fit("nmf", x[:, order], c[order], loss, tuple(trace), i, ok, method)

    kind = samples.schema["col"].dataType.simpleString()
    schema = f"col {kind}, y array<double>, w array<double>, b array<double>, sums array<double>"
    size = 2 * p * rank + 2

    def renewed(table: DataFrame, old: np.ndarray | None, new: np.ndarray) -> DataFrame:
        """The samples with b renewed from the fit of the old basis (none: as it is), and a row a task of sums with the new one."""

        def run(batches):
            total = np.zeros(size)
            longs = pa.list_(pa.float64())
            for batch in batches:
                if not batch.num_rows:
                    continue
                y, w, b = (_matrix(batch.column(k)).T for k in (1, 2, 3))
                if old is not None:
                    up, down = steps._pulls(Dense, y, old @ b, w, kl)
                    b = b * ((new.T @ up) / (new.T @ down + shift + steps.EPS))
                hat = new @ b
                up, down = steps._pulls(Dense, y, hat, w, kl)
                total += np.concatenate([(up @ b.T).ravel(), (down @ b.T).ravel(), [_loss(y, hat, w, method), b.sum()]])
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(list(b.T), longs), pa.nulls(batch.num_rows, longs)], ["col", "y", "w", "b", "sums"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, batch_type), pa.nulls(1, longs), pa.nulls(1, longs), pa.nulls(1, longs), pa.array([total.tolist()], longs)], ["col", "y", "w", "b", "sums"])

        return stored(table.select("col", "y", "w", "b").mapInArrow(run, schema))

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(samples.schema["col"].dataType)
    fresh = samples.withColumn("b", F.array(*[F.lit(1.0)] * rank))
    table, before, i, ok = renewed(fresh, None, x), samples, 0, False
    while True:
        found = _summed(table.where("sums IS NOT NULL"), size)
        loss = float(found[-2])
        if i:
            ok = settled(loss + penalty(x, float(found[-1])))
        if ok or i == limit:
            break
        i += 1
        new = basis(x, found[: p * rank].reshape(p, rank), found[p * rank : -2].reshape(p, rank))
        again = renewed(table.where("sums IS NULL"), x, new)
        freed(before)
        before, table, x = table, again, new
    order = centroid_order(x) if restriction != "fixed" and rank > 1 else np.arange(rank)
    b = table.where("sums IS NULL").select("col", F.array(*[F.get("b", F.lit(int(k))) for k in order]).alias("b"))
    return replace(Fit("nmf", x[:, order], np.zeros((rank, 0)), loss, tuple(trace), i, ok, method), extra={"b": b})
