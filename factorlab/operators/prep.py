"""Preparation: scaling, lagged designs, kernels, bandwidths, random features, folds. All relational plans."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .algebra import dot, nearest_squared, pairwise, squared_distances, whole
from .order import ranked


def _ranges(ref: DataFrame, by: str) -> DataFrame:
    return ref.groupBy(by).agg(F.min("value").alias("low"), F.max("value").alias("high"))


def minmax(cells: DataFrame, ref: DataFrame | None = None, by: str = "col") -> DataFrame:
    """(value - min) / (max - min) with ref's range per `by`; a zero width counts as 1."""
    width = F.when(F.col("high") == F.col("low"), 1.0).otherwise(F.col("high") - F.col("low"))
    return cells.join(_ranges(ref if ref is not None else cells, by), by).select("row", "col", ((F.col("value") - F.col("low")) / width).alias("value"))


def denormalize(cells: DataFrame, ref: DataFrame, by: str = "col") -> DataFrame:
    """The inverse of minmax; a zero width stays zero."""
    return cells.join(_ranges(ref, by), by).select("row", "col", (F.col("value") * (F.col("high") - F.col("low")) + F.col("low")).alias("value"))


def lag_design(series: DataFrame, degree: int, intercept: bool = True) -> tuple[DataFrame, DataFrame]:
    """(Y, A) cells of a vector autoregression from (t, var, value): A's rows are var_1 .. var_degree and (Intercept).

    The first `degree` steps are dropped. Every variable needs a dense t from 0.
    """
    if degree < 1:
        raise ValueError("degree must be at least 1")
    w = Window.partitionBy("var").orderBy("t")
    wide = series.select("t", "var", "value", *[F.lag("value", d).over(w).alias(str(d)) for d in range(1, degree + 1)]).where(F.col("t") >= degree)
    y = wide.select(F.col("var").alias("row"), F.col("t").alias("col"), "value")
    a = wide.unpivot(["t", "var"], [str(d) for d in range(1, degree + 1)], "lag", "x").select(F.concat_ws("_", "var", "lag").alias("row"), F.col("t").alias("col"), F.col("x").alias("value"))
    if intercept:
        a = a.union(wide.select(F.lit("(Intercept)").alias("row"), F.col("t").alias("col"), F.lit(1.0).alias("value")).distinct())
    return y, a


def degree_max(n: int) -> int:
    return min(n, math.floor(10 * math.log10(n)))


KERNELS = ("gaussian", "exponential", "periodic", "linear", "normalized_linear", "polynomial")


def kernel(u: DataFrame, v: DataFrame, kind: str = "gaussian", beta: float | tuple = 0.5, degree: int = 2) -> DataFrame:
    """(u, v, value) of a kernel between the rows (id, x ARRAY<DOUBLE>) of u and v; negative values become 0."""
    if kind not in KERNELS:
        raise ValueError(f"kernel is one of {', '.join(KERNELS)}")
    b1, b2 = beta if isinstance(beta, tuple) else (1.0, 1.0)

    def value(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if kind in ("linear", "normalized_linear", "polynomial"):
            product = x @ y.T
            if kind == "normalized_linear":
                norm = lambda m: np.maximum(np.sqrt((m**2).sum(axis=1)), 2.220446049250313e-16)
                product = product / (norm(x)[:, None] * norm(y))
            elif kind == "polynomial":
                product = (product + (0.0 if beta is None else float(beta))) ** float(degree)
            return np.maximum(product, 0.0)
        d2 = np.maximum(squared_distances(x, y), 0.0)
        if kind == "gaussian":
            return np.exp(-float(beta) * d2)
        return np.exp(-float(beta) * np.sqrt(d2)) if kind == "exponential" else np.exp(-b1 * np.sin(b2 * np.sqrt(d2)) ** 2)

    return pairwise(u, v, value, symmetric=True)


def _missing_all(u: DataFrame, v: DataFrame) -> DataFrame:
    """v, its null vectors as vectors that miss each feature of u; u's are whole."""
    one = u.select(F.size("x").alias("p")).first()
    missing = F.lit(None).cast(v.schema["x"].dataType.elementType)
    return v if one is None else v.withColumn("x", F.coalesce("x", F.array_repeat(missing, one["p"])))


def kernel_partial(u: DataFrame, v: DataFrame, beta: float = 0.5) -> DataFrame:
    """Gaussian kernel with missing (null) values in v: distances over the observed features, scaled by P / observed.

    A v without any observed feature, or whose vector itself is null, has kernel 0 with all; rows of u with nulls give none.
    """

    def value(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        seen = ~np.isnan(y)
        held = np.where(seen, y, 0.0)
        norms = (x**2) @ seen.T + (held**2).sum(axis=1)
        part = norms - 2 * (x @ held.T)
        i, j = np.nonzero(part <= 1e-6 * norms)  # where the difference cancels
        for k in range(0, len(i), 65_536):
            some = slice(k, k + 65_536)
            part[i[some], j[some]] = (((x[i[some]] - held[j[some]]) * seen[j[some]]) ** 2).sum(axis=1)
        n = seen.sum(axis=1)
        return np.where(n == 0, 0.0, np.exp(-beta * x.shape[1] / np.maximum(n, 1) * part))

    u = u.where(whole("x"))
    return pairwise(u, _missing_all(u, v), value, gaps=True)


@dataclass(frozen=True)
class Mixture:
    """A Gaussian mixture with diagonal covariances: weights (G), means and variances (G x P), and the mean log-likelihoods."""

    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    trace: tuple[float, ...] = ()

    def log_parts(self, x: np.ndarray) -> np.ndarray:
        """Log density times weight of each row of x (null: NaN, left out of the density) under each part."""
        seen = ~np.isnan(x)
        held = np.where(seen, x, 0.0)
        precision = 1 / self.variances
        squares = (held**2) @ precision.T - 2 * held @ (self.means * precision).T + seen @ (self.means**2 * precision).T
        return np.log(self.weights) - 0.5 * (squares + seen @ np.log(2 * math.pi * self.variances).T)

    def shares(self, x: np.ndarray) -> np.ndarray:
        log = self.log_parts(x)
        share = np.exp(log - log.max(axis=1, keepdims=True))
        return share / share.sum(axis=1, keepdims=True)


def mixture(u: DataFrame, parts: int = 3, iterations: int = 100, tolerance: float = 1e-6, seed: int = 123) -> Mixture:
    """The mixture of the rows (id, x) of u by EM from k-means, a pass an iteration: responsibilities and moments are folded in
    the tasks. Rows without a whole vector are left out."""
    from .starts import _folded, kmeans_samples

    rows = u.where(whole("x") & F.col("id").isNotNull()).select(F.col("id").alias("col"), F.col("x").alias("y"))
    means = kmeans_samples(rows, parts, seed).T
    p = means.shape[1]
    moments = _folded(rows, ["y"], lambda y: np.concatenate([[len(y)], y.sum(axis=0), (y**2).sum(axis=0)]), 2 * p + 1)
    spread = np.maximum(moments[p + 1 :] / moments[0] - (moments[1 : p + 1] / moments[0]) ** 2, 1e-12)
    now = Mixture(np.full(parts, 1 / parts), means, np.tile(spread, (parts, 1)))
    trace: list[float] = []
    for _ in range(iterations):

        def fold(y, now=now):
            log = now.log_parts(y)
            top = log.max(axis=1, keepdims=True)
            share = np.exp(log - top)
            total = share.sum(axis=1, keepdims=True)
            share = share / total
            return np.concatenate([share.sum(axis=0), (share.T @ y).ravel(), (share.T @ y**2).ravel(), [float((top + np.log(total)).sum())]])

        found = _folded(rows, ["y"], fold, parts * (2 * p + 1) + 1)
        size = np.maximum(found[:parts], 1e-12)
        means = found[parts : parts * (p + 1)].reshape(parts, p) / size[:, None]
        squares = found[parts * (p + 1) : -1].reshape(parts, p) / size[:, None]
        now = Mixture(size / size.sum(), means, np.maximum(squares - means**2, 1e-6 * spread))
        trace.append(float(found[-1] / moments[0]))
        if len(trace) > 1 and abs(trace[-1] - trace[-2]) <= tolerance * max(1.0, abs(trace[-2])):
            break
    return Mixture(now.weights, now.means, now.variances, tuple(trace))


def expected_kernel(x: np.ndarray, y: np.ndarray, mixed: Mixture, beta: float) -> np.ndarray:
    """Expected Gaussian kernel of rows of x (whole) and of y (NaN: missing).

    What y misses has the mixture's conditional mean and variance; the squared distance is matched by a gamma law of the same
    mean and variance, whose Laplace transform at beta is the expectation. A row that misses all has kernel 0.
    """
    seen = ~np.isnan(y)
    share = mixed.shares(y)
    mean = share @ mixed.means
    variance = np.where(seen, 0.0, np.maximum(share @ (mixed.means**2 + mixed.variances) - mean**2, 0.0))
    filled = np.where(seen, y, mean)
    expected = np.maximum(squared_distances(x, filled), 0.0) + variance.sum(axis=1)
    weighted = np.maximum((x**2) @ variance.T - 2 * x @ (filled * variance).T + (filled**2 * variance).sum(axis=1), 0.0)
    spread = 4 * weighted + 2 * (variance**2).sum(axis=1)
    safe = np.maximum(expected, 1e-300)
    gamma = np.exp(-(expected**2) / np.maximum(spread, 1e-300) * np.log1p(beta * spread / safe))
    return np.where(seen.any(axis=1), np.where(spread < 1e-30, np.exp(-beta * expected), gamma), 0.0)


def kernel_expected(u: DataFrame, v: DataFrame, beta: float = 0.5, mixed: Mixture | None = None, parts: int = 3, seed: int = 123) -> DataFrame:
    """(u, v, value): the Gaussian kernel's expectation where rows of v have nulls, under a mixture of u (None: fitted here).

    Covariances are diagonal. Rows of u without a whole vector, and rows whose vector is null, give no pairs.
    """
    mixed = mixture(u, parts, seed=seed) if mixed is None else mixed
    return pairwise(u.where(whole("x")), v, lambda x, y: expected_kernel(x, y, mixed, beta), gaps=True)


def nearest(u: DataFrame, landmarks: DataFrame | None = None) -> DataFrame:
    """(u, value): the least distance of each row of u to another row, or to a landmark of another id."""
    other = u if landmarks is None else landmarks
    return nearest_squared(u, other).select("u", F.sqrt(F.greatest("value", F.lit(0.0))).alias("value"))


def bandwidth(u: DataFrame, landmarks: DataFrame | None = None, grid: str | list[float] = "wide") -> DataFrame:
    """(k, beta): 1 / (2 d^2) times powers of ten, d the median nearest distance; k = 0 is the centre.

    grid: "wide" (exponents -2 to 2 in steps of 2/3 of t), "narrow", or a list of t; beta = centre * 10^(-2 t).
    """
    steps = {"wide": [-1, -2 / 3, -1 / 3, 0, 1 / 3, 2 / 3, 1], "narrow": [-0.5, 0, 0.5, 1]}.get(grid, grid) if isinstance(grid, str) else grid
    median = nearest(u, landmarks).agg(F.expr("percentile(value, 0.5)").alias("d"))
    d = F.when(F.col("d") > 0, F.col("d")).otherwise(math.sqrt(2.220446049250313e-16))
    factors = F.array(*[F.lit(10.0 ** (-2 * t)) for t in steps])
    return median.select(F.posexplode(F.transform(factors, lambda f: f / (2 * d * d))).alias("k", "beta"))


def random_features(u: DataFrame, omega: np.ndarray, phase: np.ndarray) -> DataFrame:
    """(id, z): sqrt(2 / D) cos(omega x + phase), the same map wherever omega (D x P) and phase (D) are reused."""
    scale = math.sqrt(2.0 / len(phase))
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in line]) for line in omega])
    shifts = F.array(*[F.lit(float(b)) for b in phase])
    return u.select("id", F.zip_with(rows, shifts, lambda w, b: F.lit(scale) * F.cos(dot(w, F.col("x")) + b)).alias("z"))


def draw_features(n_features: int, dimensions: int, beta: float, seed: int = 123) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(0, math.sqrt(2 * beta), (dimensions, n_features)), rng.uniform(0, 2 * math.pi, dimensions)


def hash_order(*columns: str, seed: int = 123) -> Column:
    """A portable pseudo-random integer of integer columns; ties are broken by the columns themselves."""
    total = F.lit(seed).cast("bigint")
    for column, factor in zip(columns, (7919, 104729, 1299709), strict=False):
        total = total + F.col(column).cast("bigint") * factor
    return (total * 48271) % 1000003


def folds(items: DataFrame, k: int, *columns: str, seed: int = 123, shuffle: bool = True) -> DataFrame:
    """items with fold 1..k, of sizes that differ by one at most (the first ones are larger).

    columns: integer columns that identify an item. The sizes need one global order, so items are ranked in two steps:
    ranks within hash ranges, offset by the counts of the ranges before.
    """
    small, extra = F.floor(F.col("_total") / k), F.col("_total") % k
    if not shuffle:  # ranges of the items themselves, so that none is crowded
        rows = ranked(items, list(columns)).withColumnsRenamed({"at": "_rank", "n": "_total"})
    else:
        keyed = items.withColumn("_key", hash_order(*columns, seed=seed).cast("bigint"))
        keyed = keyed.withColumn("_range", F.floor(F.col("_key") * 256 / 1000003))
        sizes = keyed.groupBy("_range").agg(F.count("*").alias("_n"))  # at most 256 rows
        before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        all_of = Window.partitionBy()
        sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(all_of).alias("_total"))
        within = F.row_number().over(Window.partitionBy("_range").orderBy("_key", *columns))
        rows = keyed.join(F.broadcast(sizes), "_range").withColumn("_rank", F.col("_before") + within - 1)
    rank = F.col("_rank")
    edge = extra * (small + 1)
    fold = F.when(rank < edge, F.floor(rank / (small + 1))).otherwise(extra + F.floor((rank - edge) / F.greatest(small, F.lit(1)))) + 1
    return rows.withColumn("fold", fold.cast("int")).select(*items.columns, "fold")


def upper_triangle_folds(cells: DataFrame, k: int, seed: int = 123) -> DataFrame:
    """Folds of a symmetric matrix's cells: each pair, the diagonal included, is dealt once and mirrored."""
    half = folds(cells.where("row <= col").select("row", "col"), k, "row", "col", seed=seed).withColumnsRenamed({"row": "lo", "col": "hi"})
    return cells.select("row", "col", F.least("row", "col").alias("lo"), F.greatest("row", "col").alias("hi")).join(half, ["lo", "hi"]).select("row", "col", "fold")
