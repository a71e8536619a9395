"""Goodness of fit, memberships and clustering criteria, as plans over cells (row, col, value)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dense import cophenetic, correlation, distances
from .algebra import codes, id_type, in_blocks, squared_distances
from .order import ranked


def _corr(n, sx, sy, sxx, syy, sxy) -> Column:
    """Correlation from sums; null where a variance is zero."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((vx > 0) & (vy > 0), (n * sxy - sx * sy) / F.sqrt(vx * vy))


def valid_pairs(y: DataFrame, fitted: DataFrame) -> DataFrame:
    """(row, col, y, fit) of the cells with positive weight."""
    if "weight" in y.columns:
        y = y.where("weight > 0")
    return y.select("row", "col", F.col("value").alias("y")).join(fitted.select("row", "col", F.col("value").alias("fit")), ["row", "col"])


def r_squared(y: DataFrame, fitted: DataFrame) -> DataFrame:
    """r2_cor (squared correlation), r2_zero (against 0), r2_mean (against row means); null below 2 cells or at zero."""
    pairs = valid_pairs(y, fitted)
    sums = {"n": F.count("*").cast("double"), "sx": F.sum("y"), "sy": F.sum("fit"), "sxx": F.sum(F.col("y") * F.col("y")), "syy": F.sum(F.col("fit") * F.col("fit")), "sxy": F.sum(F.col("y") * F.col("fit")), "sse": F.sum(F.pow(F.col("y") - F.col("fit"), 2)), "ssm": F.var_pop("y") * F.count("*")}
    rows = pairs.groupBy("row").agg(*[v.alias(k) for k, v in sums.items()])  # partial sums: no row's cells meet in one task
    s = rows.agg(*[F.sum(c).alias(c) for c in sums])
    enough = F.col("n") >= 2
    share = lambda c: F.when(enough & (F.col(c) > 0), 1 - F.col("sse") / F.col(c))
    r = _corr(*(F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")))
    return s.select(F.when(enough, r * r).alias("r2_cor"), share("sxx").alias("r2_zero"), share("ssm").alias("r2_mean"))


def sigma_mae(y: DataFrame, fitted: DataFrame) -> DataFrame:
    """Sample standard deviation of the residuals, and mean absolute residual."""
    r = F.col("y") - F.col("fit")
    return valid_pairs(y, fitted).agg(F.stddev_samp(r).alias("sigma"), F.avg(F.abs(r)).alias("mae"))


def family_errors(y: DataFrame, fitted: DataFrame, family: str = "nmf", method: str = "EU") -> DataFrame:
    """sigma and mae as the family of the fit defines them, over cells of positive weight (without weights: all).

    nmf: sample standard deviation of the residuals and mean absolute one, both without weights. signed, rrr and rrr_signed: root
    of the weighted squared error over the number of cells (null for KL), and the mean absolute residual without weights. net:
    both weighted, over the sum of the weights.
    """
    if family not in ("nmf", "signed", "rrr", "rrr_signed", "net"):
        raise ValueError("family is nmf, signed, rrr, rrr_signed or net")
    if family == "nmf":
        return sigma_mae(y, fitted)
    w = F.col("weight") if "weight" in y.columns else F.lit(1.0)
    kept = y.where("weight > 0") if "weight" in y.columns else y
    pairs = kept.select("row", "col", F.col("value").alias("y"), w.cast("double").alias("w")).join(fitted.select("row", "col", F.col("value").alias("fit")), ["row", "col"])
    r = F.col("y") - F.col("fit")
    squares, n = F.sum(F.col("w") * r * r), F.nullif(F.sum("w"), F.lit(0.0)) if family == "net" else F.nullif(F.count("*").cast("double"), F.lit(0.0))
    sigma = F.sqrt(squares / n) if method == "EU" else F.lit(None).cast("double")
    mae = F.sum(F.col("w") * F.abs(r)) / n if family == "net" else F.avg(F.abs(r))
    return pairs.agg(sigma.alias("sigma"), mae.alias("mae"))


def memberships(x: DataFrame, b: DataFrame, eps: float = 1e-10) -> DataFrame:
    """(side, item, basis, share, label) of rows (side X) and samples (side B): the bases' shares of each item, and the basis of
    the largest share (the first of ties; null for an item without any)."""
    parts = []
    for side, cells, item, basis in (("X", x, "row", "col"), ("B", b, "col", "row")):
        shares = membership(cells, item, eps)
        top = F.max(F.struct("value", (-F.col(basis)).alias("turned"))).over(Window.partitionBy(item))
        label = F.when(top["value"] > 0, -top["turned"]).cast("bigint")
        parts.append(shares.select(F.lit(side).alias("side"), F.col(item).cast("string").alias("item"), F.col(basis).cast("bigint").alias("basis"), F.col("value").alias("share"), label.alias("label")))
    return parts[0].unionByName(parts[1])


#: Samples up to which hierarchical clustering is done: its distances are a matrix on the driver.
CLUSTERED = 2000


def criterion(y: DataFrame, fitted: DataFrame, b: DataFrame | None = None, points: DataFrame | None = None, detail: str = "full") -> DataFrame:
    """One row of a fit's criteria. minimal: r2_cor, r2_zero, r2_mean, sigma and mae; fast: also the effective rank of b and
    its index; full: also the silhouette and the distance correlation of b's hard labels over points (id, x), the samples'
    data, and the cophenetic correlation of b (cpcc), null beyond CLUSTERED samples. Full asks for data without zero weights;
    with some it gives null for the three. Memberships are memberships()."""
    if detail not in ("minimal", "fast", "full"):
        raise ValueError("detail is minimal, fast or full")
    parts = [r_squared(y, fitted), sigma_mae(y, fitted)]
    if detail != "minimal":
        parts.append(effective_rank(b))
    if detail == "full":
        weighted = "weight" in y.columns and bool(y.where("weight <= 0").limit(1).count())
        latent = b.groupBy(F.col("col").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "value"))), lambda s: s["value"]).alias("x"))  # one sample's bases
        none = y.sparkSession.range(1)
        parts.append(none.select(F.lit(None).cast("double").alias("silhouette")) if weighted else silhouette(points, hard_labels(b).select(F.col("col").alias("id"), "label")))
        parts.append(none.select(F.lit(None).cast("double").alias("dist_cor")) if weighted else distance_correlation(points, latent))
        few = latent.limit(CLUSTERED + 1).collect() if not weighted else []
        value = cpcc(np.array([r["x"] for r in few], float).T) if 0 < len(few) <= CLUSTERED else None
        parts.append(none.select(F.lit(value).cast("double").alias("cpcc")))
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each
    return out


def residuals(y: DataFrame, fitted: DataFrame) -> DataFrame:
    return valid_pairs(y, fitted).select("row", "col", (F.col("y") - F.col("fit")).alias("value"))


def membership(b: DataFrame, by: str = "col", eps: float = 1e-10) -> DataFrame:
    """Shares of the bases within each sample (by="col"), or of each basis over a row's bases (by="row")."""
    return b.withColumn("value", F.col("value") / (F.sum("value").over(Window.partitionBy(by)) + eps))


def hard_labels(b: DataFrame, by: str = "col", over: str = "row") -> DataFrame:
    """(by, label, value): the largest entry, the first of ties."""
    w = Window.partitionBy(by).orderBy(F.desc("value"), over)
    return b.withColumn("k", F.row_number().over(w)).where("k = 1").select(by, F.col(over).alias("label"), "value")


def centroid_ranks(x: DataFrame, n_rows: int) -> DataFrame:
    """(col, centroid, position): bases by the mean position of their mass, rows counted from 1."""
    c = x.groupBy("col").agg((F.sum(F.col("row") * F.col("value")) / n_rows).alias("centroid"))
    return c.withColumn("position", F.row_number().over(Window.orderBy("centroid", "col")))  # one row per basis


def effective_rank(b: DataFrame) -> DataFrame:
    """effective_rank: exp of the entropy of the bases' variance shares; null below two bases or samples or at no variance.

    effective_rank_index: where it lies between its expectation for random shares and the number of bases, in [0, 1].
    """
    v = b.groupBy("row").agg(F.var_samp("value").alias("v"))
    s = v.agg(F.collect_list("v").alias("v"), F.count("*").alias("q"), F.sum("v").alias("total"))
    entropy = F.aggregate("v", F.lit(0.0), lambda a, x: a - F.when(x > 0, x / F.col("total") * F.log(x / F.col("total"))).otherwise(0.0))
    er = F.when((F.col("q") >= 2) & (F.col("total") > 0), F.exp(entropy))
    harmonic = F.aggregate(F.sequence(F.lit(1), F.col("q").cast("int")), F.lit(0.0), lambda a, k: a + 1.0 / k)
    low = F.exp(harmonic - 1)
    index = F.when(F.col("q") >= 2, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (er - low) / (F.col("q") - low))))
    return s.select(er.alias("effective_rank"), index.alias("effective_rank_index"))


def sparsity(cells: DataFrame, below: float = 1e-4) -> DataFrame:
    return cells.agg(F.avg(F.when(F.col("value") < below, 1.0).otherwise(0.0)).alias("sparsity"))


def silhouette(points: DataFrame, labels: DataFrame) -> DataFrame:
    """silhouette: mean over (id, x) points of (b - a) / max(a, b) in data space; singletons 0, null below two clusters.

    Points without a label or a whole vector are left out, of their cluster's size too.
    Points are compared with all points, as the criterion asks, in blocks; what leaves a task is a sum a point and cluster.
    """
    p = points.select("id", "x").join(labels.where("label IS NOT NULL").select("id", "label"), "id")

    def fold(left, right):
        d = np.sqrt(np.maximum(squared_distances(left["x"], right["x"]), 0.0))
        i, j = codes(left["id"], right["id"])
        other = i[:, None] != j
        kinds = pc.unique(right["label"])
        of = pc.index_in(right["label"], kinds).to_numpy(zero_copy_only=False)
        one = np.eye(len(kinds))[of]
        sums, counts = (d * other) @ one, other @ one
        at, k = np.nonzero(counts)
        return [left["id"].take(pa.array(at)), left["label"].take(pa.array(at)), kinds.take(pa.array(k)), sums[at, k], counts[at, k]]

    kind = labels.schema["label"].dataType.simpleString()
    sums = in_blocks(p, p, fold, f"i {id_type(p)}, li {kind}, lj {kind}, s double, n double")
    means = sums.groupBy("i", "li", "lj").agg((F.sum("s") / F.sum("n")).alias("m"))
    per = means.groupBy("i", "li").agg(F.min(F.when(F.col("lj") == F.col("li"), F.col("m"))).alias("a"), F.min(F.when(F.col("lj") != F.col("li"), F.col("m"))).alias("b"))
    top = F.greatest("a", "b")
    s = F.when(F.col("a").isNull(), 0.0).when(top > 0, (F.col("b") - F.col("a")) / top).otherwise(0.0)
    return per.agg(F.when(F.countDistinct("li") >= 2, F.avg(s)).alias("silhouette"))


def distance_correlation(left: DataFrame, right: DataFrame) -> DataFrame:
    """dist_cor: correlation of the pairwise distances of (id, x) in two spaces; a block pair gives six sums."""
    both = left.select("id", "x").join(right.select("id", F.col("x").alias("q")), "id")

    def fold(a, b):
        i, j = codes(a["id"], b["id"])
        once = i[:, None] < j
        x, y = (np.sqrt(np.maximum(squared_distances(a[c], b[c]), 0.0))[once] for c in ("x", "q"))
        return [[float(z)] for z in (len(x), x.sum(), y.sum(), (x * x).sum(), (y * y).sum(), (x * y).sum())]

    names = ("n", "sx", "sy", "sxx", "syy", "sxy")
    s = in_blocks(both, both, fold, ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c).alias(c) for c in names])
    return s.select(_corr(*map(F.col, names)).alias("dist_cor"))


def cpcc(b: np.ndarray) -> float | None:
    """Correlation of the samples' distances and their complete-linkage cophenetic distances; null below two bases."""
    if len(b) < 2 or b.shape[1] < 3:
        return None
    d = distances(b)
    at = np.triu_indices(len(d), 1)
    return correlation(d[at], cophenetic(d, "complete")[at])


def cluster_criteria(y: np.ndarray, fits: list[tuple[str, np.ndarray]]) -> list[dict]:
    """Per (name, B): rank, silhouette, CPCC, distance correlation and hardness, in the given order."""
    dy, out = distances(y), []
    at = np.triu_indices(y.shape[1], 1)
    for name, b in fits:
        db, labels = distances(b), b.argmax(axis=0)
        prob = b / (b.sum(axis=0) + 1e-10)
        out.append({"fit": name, "rank": len(b), "silhouette": dense_silhouette(dy, labels), "cpcc": cpcc(b), "dist_cor": correlation(dy[at], db[at]), "hard": float(prob.max(axis=0).mean())})
    return out


def dense_silhouette(d: np.ndarray, labels: np.ndarray) -> float | None:
    kinds = np.unique(labels)
    if len(kinds) < 2:
        return None
    values = []
    for i, own in enumerate(labels):
        same = (labels == own) & (np.arange(len(labels)) != i)
        if not same.any():
            values.append(0.0)
            continue
        a, b = d[i, same].mean(), min(d[i, labels == k].mean() for k in kinds if k != own)
        values.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(values))


def adjusted_rand(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ari of the labels a and b (per group `by`); null below two items or where it isn't defined."""
    by = by or []
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    n = pairs.groupBy(*by, "a", "b").agg(F.count("*").cast("double").alias("n"))
    side = lambda c, out: n.groupBy(*by, c).agg(F.sum("n").alias("m")).groupBy(*by).agg(F.sum(two("m")).alias(out))
    joined = n.groupBy(*by).agg(F.sum(two("n")).alias("both"), F.sum("n").alias("total"))
    for part in (side("a", "sa"), side("b", "sb")):
        joined = joined.join(part, by) if by else joined.crossJoin(part)
    expected = F.col("sa") * F.col("sb") / F.nullif(two("total"), F.lit(0.0))
    top = (F.col("sa") + F.col("sb")) / 2
    return joined.select(*by, F.when((F.col("total") >= 2) & (top != expected), (F.col("both") - expected) / F.nullif(top - expected, F.lit(0.0))).alias("ari"))


def flow_layout(labels: DataFrame, reference: int) -> DataFrame:
    """(fit, id, label, position): clusters of each fit stacked by their members' mean place in the reference, with gaps.

    labels: (id, fit, label). The reference's samples are ordered by label, then id. Samples are numbered over ranges, so that
    neither a fit nor a cluster is one task's; windows are over the clusters alone.
    """
    key = ranked(labels.where(F.col("fit") == reference).select("id", "label"), ["label", "id"]).select("id", (F.col("at") + 1).alias("key"), F.col("n").cast("double").alias("total"))
    joined = labels.select("id", "fit", "label").join(key, "id")
    members = ranked(joined, ["key"], ["fit", "label"])
    clusters = members.groupBy("fit", "label").agg(F.avg("key").alias("centre"), F.count("*").alias("members"))
    order = Window.partitionBy("fit").orderBy("centre", "label")
    before = F.coalesce(F.sum("members").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    clusters = clusters.select("fit", "label", before.alias("before"), F.row_number().over(order).alias("block"), F.count("*").over(Window.partitionBy("fit")).alias("blocks"))
    k = F.col("before") + F.col("at") + 1
    # a place of 2^16 members leads to its cluster's row, so that a large cluster is many keys
    slots = members.select("fit", "label", F.shiftright("at", 16).alias("slot")).distinct().join(clusters, ["fit", "label"])
    placed = members.withColumn("slot", F.shiftright("at", 16)).join(slots, ["fit", "label", "slot"])
    return placed.select("fit", "id", "label", (k + (F.col("block") - 1) * F.col("total") / F.col("blocks")).alias("position"))


def adjacent_ari(labels: DataFrame) -> DataFrame:
    """(fit, ari) between each fit and the next one, for (id, fit, label) with fits counted up by one."""
    a = labels.select("id", "fit", F.col("label").alias("a"))
    b = labels.select("id", (F.col("fit") - 1).alias("fit"), F.col("label").alias("b"))
    return adjusted_rand(a.join(b, ["id", "fit"]), ["fit"])


def _signatures(labels: DataFrame) -> tuple[DataFrame, int]:
    """(id, x): each sample's labels as numbers, one a run in the runs' order (null: none); and the number of runs."""
    runs = [r[0] for r in labels.select("run").distinct().orderBy("run").collect()]  # the restarts of a rank
    codes_of = labels.select("run", "label").distinct().withColumn("code", F.dense_rank().over(Window.partitionBy("run").orderBy("label")).cast("double"))  # labels of a run: its rank
    keyed = labels.join(F.broadcast(codes_of), ["run", "label"]).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("run", "code"))).alias("m"))
    return keyed.select("id", F.array(*[F.try_element_at("m", F.lit(r)) for r in runs]).alias("x")), len(runs)


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of the places at which rows of x and of y are equal."""
    return sum(((x[:, k, None] == y[:, k]) for k in range(x.shape[1])), np.zeros((len(x), len(y)))) / x.shape[1]


def consensus(labels: DataFrame) -> DataFrame:
    """(i, j, value): share of the runs in which i and j (all ordered pairs) have one label; labels: (run, id, label).

    All pairs are the result asked for; they are made in blocks of samples.
    """
    points, _ = _signatures(labels)

    def fold(left, right):
        n, m = len(left["id"]), len(right["id"])
        return [left["id"].take(pa.array(np.repeat(np.arange(n), m))), right["id"].take(pa.array(np.tile(np.arange(m), n))), _agreement(left["x"], right["x"]).ravel()]

    return in_blocks(points, points, fold, f"i {id_type(points)}, j {id_type(points)}, value double", gaps=True)


def consensus_classes(labels: DataFrame) -> DataFrame:
    """(id, x, size): samples that have equal labels in all runs are one class, named by its smallest sample."""
    points, _ = _signatures(labels)
    return points.groupBy("x").agg(F.min("id").alias("id"), F.count("*").cast("double").alias("size"))


def consensus_measures(labels: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """consensus_summary() of the labels' consensus matrix, from pairs of classes and without the matrix.

    Within a class every pair agrees in all runs; between classes all pairs of their members agree as the classes do. What
    leaves a task is two sums a pair of blocks of classes.
    """
    classes = consensus_classes(labels).select("id", "x", "size")

    def fold(a, b):
        value, pairs = _agreement(a["x"], b["x"]), np.outer(a["size"].to_numpy(), b["size"].to_numpy())
        first, second = codes(a["id"], b["id"])
        mixed = (value > low) & (value < high) & (first[:, None] > second)
        return [[float((pairs * 4 * (value - 0.5) ** 2).sum())], [float(pairs.sum())], [float(pairs[mixed].sum())]]

    sums = in_blocks(classes, classes, fold, "spread double, pairs double, mixed double", gaps=True).agg(*[F.sum(c).alias(c) for c in ("spread", "pairs", "mixed")])
    n = F.sqrt("pairs")
    return sums.select((F.col("spread") / F.col("pairs")).alias("dispersion"), (F.col("mixed") / F.nullif(n * (n - 1) / 2, F.lit(0.0))).alias("pac"))


def consensus_summary(matrix: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """dispersion (1: every pair is decided) and pac (share of pairs i > j strictly between low and high)."""
    pair = F.col("i") > F.col("j")
    mixed = F.when((F.col("value") > low) & (F.col("value") < high), 1.0).otherwise(0.0)
    return matrix.agg(F.avg(4 * F.pow(F.col("value") - 0.5, 2)).alias("dispersion"), F.avg(F.when(pair, mixed)).alias("pac"))


def elbow(curve: DataFrame) -> DataFrame:
    """The rank whose r2 lies farthest from the chord of the (index, r2) curve scaled to the unit square; needs 3 ranks."""
    every = Window.partitionBy()
    k = F.row_number().over(Window.orderBy("rank"))
    n = F.count("*").over(every)
    x = (F.col("k") - 1) / F.greatest(F.col("n") - 1, F.lit(1))
    y = (F.col("r2") - F.min("r2").over(every)) / F.coalesce(F.nullif(F.max("r2").over(every) - F.min("r2").over(every), F.lit(0.0)), F.lit(1.0))
    scaled = curve.withColumn("k", k).withColumn("n", n).withColumn("x", x).withColumn("y", y)
    first, last = F.min_by("y", "k").over(every), F.max_by("y", "k").over(every)
    gap = F.abs((last - first) * F.col("x") - F.col("y") + first) / F.sqrt(F.pow(last - first, 2) + 1)
    ranked = scaled.withColumn("gap", gap).withColumn("best", F.row_number().over(Window.orderBy(F.desc("gap"), "k")))
    return ranked.where("best = 1 AND n > 2").select("rank", F.col("gap").alias("distance"))


def bootstrap_summary(draws: DataFrame, estimates: DataFrame, level: float = 0.95, two_sided: bool = True) -> DataFrame:
    """Per (basis, covariate): estimate, bse, ci_low, ci_high (type 7 quantiles), p_value of the centred draws.

    draws: (replicate, basis, covariate, value); non-finite draws don't count.
    """
    fine = draws.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))).join(estimates, ["basis", "covariate"])
    tail = F.avg(F.when(F.col("value") >= 2 * F.col("estimate"), 1.0).otherwise(0.0))
    p = F.least(F.lit(1.0), 2 * F.least(tail, 1 - tail)) if two_sided else tail
    return fine.groupBy("basis", "covariate").agg(
        F.first("estimate").alias("estimate"), F.stddev_samp("value").alias("bse"), F.expr(f"percentile(value, {(1 - level) / 2!r})").alias("ci_low"), F.expr(f"percentile(value, {(1 + level) / 2!r})").alias("ci_high"), p.alias("p_value")
    )
