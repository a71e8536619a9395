"""Cross-validation, rank selection and consensus as grids of independent tasks.

The matrix a grid works on is model-sized and broadcast; each (rank, fold, run) is a row of a task table, spread over as
many partitions as there are tasks. A task's seed comes from its own numbers, so results don't depend on the layout.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import criteria
from .fit import Fit, initial_basis, nmf, nmf_ard, nmf_ffb, nmf_net, nmf_rrr, nmf_signed, nnls
from .predict import response


def run_grid(spark: SparkSession, tasks: list[dict], work: Callable, schema: str, shared=None) -> DataFrame:
    """work(shared, **task) -> iterable of dicts, for each task, as rows of schema."""
    known = spark.sparkContext.broadcast(shared)
    table = pd.DataFrame(tasks)
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches):
        for batch in batches:
            rows = []
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                for task in batch.to_dict("records"):
                    rows += list(work(known.value, **{k: v for k, v in task.items() if k != "task_id"}))
            yield pd.DataFrame(rows, columns=names)

    table.insert(0, "task_id", range(len(table)))
    spread = spark.createDataFrame(table).repartitionByRange(max(1, len(tasks)), "task_id")
    return spread.mapInPandas(run, schema)


def element_folds(shape: tuple[int, int], k: int, seed: int = 123, valid: np.ndarray | None = None) -> np.ndarray:
    """Fold 1..k of each valid cell (0 elsewhere), by the portable hash order of prep.folds."""
    i, j = np.indices(shape)
    keys = ((seed + (i + 1).astype(np.int64) * 7919 + (j + 1) * 104729) * 48271) % 1000003
    mask = np.ones(shape, bool) if valid is None else valid
    order = np.lexsort((j[mask], i[mask], keys[mask]))
    out, part = np.zeros(shape, int), np.zeros(int(mask.sum()), int)
    for f, members in enumerate(np.array_split(order, k)):
        part[members] = f + 1
    out[mask] = part
    return out


def column_folds(n: int, k: int, seed: int = 123, shuffle: bool = True) -> np.ndarray:
    if not 2 <= k <= n:
        raise ValueError("the number of folds lies between 2 and the number of samples")
    keys = ((seed + np.arange(1, n + 1, dtype=np.int64) * 7919) * 48271) % 1000003 if shuffle else np.arange(n)
    out = np.zeros(n, int)
    for f, members in enumerate(np.array_split(np.lexsort((np.arange(n), keys)), k)):
        out[members] = f + 1
    return out


def triangle_folds(n: int, k: int, seed: int = 123) -> np.ndarray:
    half = element_folds((n, n), k, seed, np.triu(np.ones((n, n), bool)))
    return half + np.triu(half, 1).T


def _averaged(scores: DataFrame, kl: bool = False, by: tuple[str, ...] = ("rank",)) -> DataFrame:
    """(rank, loss, sigma): fold losses averaged; a failing rank stays with null."""
    loss = F.avg("loss")
    return scores.groupBy(*by).agg(loss.alias("loss"), (F.lit(None).cast("double") if kl else F.sqrt(loss)).alias("sigma")).orderBy(*by)


def ecv(spark: SparkSession, y: np.ndarray, a: np.ndarray | None = None, ranks=(1, 2, 3), k: int = 5, seed: int = 123, family: str = "nmf", ranks2=None, **options) -> DataFrame:
    """Element-wise cross-validation of nmf, signed, rrr, rrr_signed or net fits: (rank, loss, sigma).

    A fold's cells have weight 0 in the fit and their mean loss counts. net: cells of the upper triangle (the diagonal
    included) are dealt out, their mirrored ones are left out with them. ranks2, for reduced-rank fits: ranks of X2, which are
    tried with every rank, as a column rank2; without them both ranks are equal.
    """
    y = np.asarray(y, float)
    fold = triangle_folds(len(y), k, seed) if family == "net" else element_folds(y.shape, k, seed, ~np.isnan(y))
    method, reduced = options.get("method", "EU"), family in ("rrr", "rrr_signed")
    if ranks2 is not None and not reduced:
        raise ValueError("ranks2 is for reduced-rank fits")

    def work(shared, rank, rank2, fold):
        y, a, folds = shared
        w = ((folds != fold) & (folds > 0)).astype(float)
        held = folds == fold
        rank, known = int(rank), np.nan_to_num(y)
        if family == "net":
            fit = nmf_net(known, rank, weights=w, seed=seed, **options)
            hat, held = fit.x @ fit.c @ fit.x.T, np.triu(held)
        elif reduced:
            fit = nmf_rrr(known, known if a is None else a, rank, int(rank2), weights=w, signed=family == "rrr_signed", seed=seed, **options)
            hat = fit.x @ fit.extra["b1"]
        else:
            fit = (nmf_signed if family == "signed" else nmf)(known, a, rank, weights=w, seed=seed, **options)
            hat = fit.fitted(a)
        gap = y[held] - hat[held] if method == "EU" else None
        loss = float((gap**2).mean()) if method == "EU" else float((hat[held] - y[held] * np.log(hat[held] + 1e-10)).mean())
        yield {"rank": rank, "rank2": int(rank2), "fold": int(fold), "loss": loss}

    pairs = [(q, q) for q in ranks] if ranks2 is None else [(q, r) for q in ranks for r in ranks2]
    tasks = [{"rank": int(q), "rank2": int(r), "fold": f} for q, r in pairs for f in range(1, k + 1)]
    scores = run_grid(spark, tasks, work, "rank int, rank2 int, fold int, loss double", (y, a, fold))
    return _averaged(scores, method == "KL", ("rank",) if ranks2 is None else ("rank", "rank2"))


def cv(
    spark: SparkSession, y: np.ndarray, a: np.ndarray | None = None, ranks=(2,), k: int = 5, seed: int = 123, shuffle: bool = True, kernel: bool = False, refit_steps: int = 200, family: str = "nmf", **options
) -> DataFrame:
    """Column-wise cross-validation: (rank, loss, sigma). Without covariates the test columns' B is fitted with X held;
    kernel: A is square, train x train in training and train x test in testing. family: nmf; signed (test columns have weight
    0, and the folds' means are averaged); rrr (y from a, predicted by X C2 C1 A from the training columns' fit).

    Cells DataFrames with covariates may have any number of samples: sums.cv_sums() then gives the same from sums per fold."""
    if isinstance(y, DataFrame):
        from .sums import cv_sums

        if a is None or kernel or options.get("method", "EU") != "EU":
            raise ValueError("cells are for squared error with covariates; make arrays of others")
        return cv_sums(spark, y, a, ranks, k, seed, shuffle, family, **options)
    y = np.asarray(y, float)
    fold = column_folds(y.shape[1], k, seed, shuffle)
    if a is not None and a.shape[0] == a.shape[1] and np.array_equal(a, np.eye(len(a))):
        a = None

    def work(shared, rank, fold):
        y, a, folds = shared
        train, test = folds != fold, folds == fold
        if family == "signed":
            fit = nmf_signed(y, a, int(rank), weights=np.broadcast_to(train.astype(float), y.shape).copy(), seed=seed, **options)
            hat = fit.fitted(a)[:, test]
            return [{"rank": int(rank), "fold": int(fold), "loss": float(((y[:, test] - hat) ** 2).mean()), "n": 1}]
        if family == "rrr":
            known, new = (a[np.ix_(train, train)], a[np.ix_(train, test)]) if kernel else (a[:, train], a[:, test])
            fit = nmf_rrr(y[:, train], known, int(rank), seed=seed, **options)
            hat = response(fit, new)
        elif a is None:
            fit = nmf(y[:, train], None, int(rank), seed=seed, **options)
            hat = fit.x @ nnls(fit.x, y[:, test], refit_steps)
        else:
            use = a[np.ix_(train, train)] if kernel else a[:, train]
            fit = nmf(y[:, train], use, int(rank), seed=seed, **options)
            hat = fit.fitted(a[np.ix_(train, test)] if kernel else a[:, test])
        return [{"rank": int(rank), "fold": int(fold), "loss": float(((y[:, test] - hat) ** 2).sum()), "n": int(hat.size)}]

    tasks = [{"rank": int(q), "fold": f} for q in ranks for f in range(1, k + 1)]
    scores = run_grid(spark, tasks, work, "rank int, fold int, loss double, n bigint", (y, a, fold))
    loss = F.sum("loss") / F.sum("n")
    return scores.groupBy("rank").agg(loss.alias("loss"), F.sqrt(loss).alias("sigma")).orderBy("rank")


def ffb_cv(spark: SparkSession, y1: np.ndarray, y2: np.ndarray, rank: int | None = None, k: int = 5, seed: int = 123, shuffle: bool = True, **options) -> DataFrame:
    """mae: one row, the mean over folds of columns of the mean absolute error of the equilibrium's prediction M Y2.

    Each fold has its own seed; one whose fit has no equilibrium makes the result infinite.
    """
    y1, y2 = np.asarray(y1, float), np.asarray(y2, float)
    folds = column_folds(y1.shape[1], k, seed, shuffle)

    def work(shared, fold):
        y1, y2, folds = shared
        train, test = folds != fold, folds == fold
        fit = nmf_ffb(y1[:, train], y2[:, train], rank, seed=int(seed + fold), **options)
        m = fit.extra["m"]
        usable = m is not None and fit.extra["radius"] < 1
        yield {"fold": int(fold), "mae": float(np.abs(y1[:, test] - m @ y2[:, test]).mean()) if usable else float("inf")}

    scores = run_grid(spark, [{"fold": f} for f in range(1, k + 1)], work, "fold int, mae double", (y1, y2, folds))
    return scores.agg(F.avg("mae").alias("mae"))


def bicv(spark: SparkSession, y: np.ndarray, ranks=(1, 2, 3), k: int = 2, seed: int = 123, nnls_steps: int = 100, **options) -> DataFrame:
    """Bi-cross-validation: blocks of rows and columns are predicted from the other three; infeasible ranks give null."""
    y = np.asarray(y, float)
    rows, cols = column_folds(y.shape[0], k, seed), column_folds(y.shape[1], k, seed + 1)

    def work(shared, rank, i, j):
        y, rows, cols = shared
        r, c = rows == i, cols == j
        kept = y[np.ix_(~r, ~c)]
        if rank > min(kept.shape):
            return [{"rank": int(rank), "loss": None}]
        fit = nmf(kept, None, int(rank), seed=seed, **options)
        b = nnls(fit.x, y[np.ix_(~r, c)], nnls_steps)
        x = nnls(fit.c.T, y[np.ix_(r, ~c)].T, nnls_steps).T
        return [{"rank": int(rank), "loss": float(((y[np.ix_(r, c)] - x @ b) ** 2).mean())}]

    tasks = [{"rank": int(q), "i": i, "j": j} for q in ranks for i in range(1, k + 1) for j in range(1, k + 1)]
    if any(q > min(y.shape[0] - -(-y.shape[0] // k), y.shape[1] - -(-y.shape[1] // k)) for q in ranks):
        warnings.warn("some ranks exceed a fold's training block", stacklevel=2)
    return _averaged(run_grid(spark, tasks, work, "rank int, loss double", (y, rows, cols)))


def _fitted(y, a, rank: int, family: str, seed: int, options: dict) -> tuple[np.ndarray, np.ndarray]:
    """(fitted values, B) of a family's fit."""
    if family == "net":
        fit = nmf_net(y, rank, seed=seed, **options)
        return fit.x @ fit.c @ fit.x.T, fit.x.T
    if family in ("rrr", "rrr_signed"):
        fit = nmf_rrr(y, a if a is not None else y, rank, seed=seed, signed=family == "rrr_signed", **options)
        return fit.x @ fit.extra["b1"], fit.extra["b1"]
    fit = (nmf_signed if family == "signed" else nmf)(y, a, rank, seed=seed, **options)
    return fit.fitted(a), fit.b(a)


def rank_curve(spark: SparkSession, y: np.ndarray, a: np.ndarray | None = None, ranks=(1, 2, 3), k: int = 5, seed: int = 123, full: bool = True, family: str = "nmf", **options) -> DataFrame:
    """Per rank of nmf, signed, rrr, rrr_signed or net fits: r2, sigma_fit, effective_rank, its index, ecv loss, and the
    recommended rank (ECV minimum, else elbow)."""

    def work(shared, rank):
        y, a = shared
        hat, b = _fitted(y, a, int(rank), family, seed, options)
        v = b.var(axis=1, ddof=1)
        share = v[v > 0] / v.sum() if v.sum() > 0 else v[:0]
        er = float(np.exp(-(share * np.log(share)).sum())) if len(b) >= 2 and len(share) else None
        low = float(np.exp(sum(1.0 / i for i in range(1, len(b) + 1)) - 1))
        index = None if er is None or len(b) < 2 else min(1.0, max(0.0, (er - low) / (len(b) - low)))
        r2 = float(np.corrcoef(y.ravel(), hat.ravel())[0, 1] ** 2)
        yield {"rank": int(rank), "r2": r2, "sigma_fit": float((y - hat).std(ddof=1)), "effective_rank": er, "effective_rank_index": index}

    curve = run_grid(spark, [{"rank": int(q)} for q in ranks], work, "rank int, r2 double, sigma_fit double, effective_rank double, effective_rank_index double", (np.asarray(y, float), a))
    if full:
        curve = curve.join(ecv(spark, y, a, ranks, k, seed, family, **options).select("rank", F.col("loss").alias("ecv")), "rank")
    else:
        curve = curve.withColumn("ecv", F.lit(None).cast("double"))
    curve = spark.createDataFrame(curve.toPandas(), curve.schema)  # one row per rank
    best = curve.where("ecv IS NOT NULL").orderBy("ecv", "rank").limit(1).select(F.col("rank").alias("best"))
    best = best if full else criteria.elbow(curve.select("rank", "r2")).select(F.col("rank").alias("best"))
    return curve.crossJoin(best).withColumn("recommended", F.col("rank") == F.col("best")).drop("best").orderBy("rank")


def consensus_runs(spark: SparkSession, y: np.ndarray, a: np.ndarray | None = None, ranks=(2, 3, 4), runs: int = 30, seed: int = 123, **options) -> DataFrame:
    """(rank, run, id, label) of fits from random starts."""

    def work(shared, k, rank, run):
        y, a = shared
        fit = nmf(y, a, int(rank), init="runif", seed=int(seed + 1000 * k + run), **options)
        for i, label in enumerate(fit.b(a).argmax(axis=0)):
            yield {"rank": int(rank), "run": int(run), "id": i, "label": int(label)}

    tasks = [{"k": k + 1, "rank": int(q), "run": r + 1} for k, q in enumerate(ranks) for r in range(runs)]
    return run_grid(spark, tasks, work, "rank int, run int, id int, label int", (np.asarray(y, float), a))


def consensus_curve(spark: SparkSession, y: np.ndarray, a: np.ndarray | None = None, ranks=(2, 3, 4), runs: int = 30, seed: int = 123, low: float = 0.1, high: float = 0.9, **options) -> DataFrame:
    """Per rank: dispersion, pac and the cophenetic correlation (average linkage) of the consensus matrix."""
    from ..functions.dense import cophenetic, correlation

    labels = consensus_runs(spark, y, a, ranks, runs, seed, **options).persist()
    rows = []
    for q in ranks:
        of_rank = labels.where(F.col("rank") == q)
        summary = criteria.consensus_measures(of_rank, low, high).first()
        table = criteria.consensus(of_rank).toPandas().pivot(index="i", columns="j", values="value").to_numpy()
        d, at = 1 - table, np.triu_indices(len(table), 1)
        rows.append((int(q), summary[0], summary[1], correlation(d[at], cophenetic(d, "average")[at]) if d[at].any() else None))
    labels.unpersist()
    return spark.createDataFrame(rows, "rank int, dispersion double, pac double, cophenetic double")


def ard_rank(spark: SparkSession, y: np.ndarray, rank: int | None = None, runs: int = 10, seed: int = 123, **options) -> tuple[DataFrame, Fit]:
    """(rank, n, chosen) over runs of relevance-pruned fits, and the modal run of least residual."""
    y = np.asarray(y, float)

    def work(shared, run):
        fit = nmf_ard(shared, rank, seed=int(seed + run), **options)
        yield {"run": int(run), "rank": int(fit.extra["rank"]), "loss": fit.objective}

    found = run_grid(spark, [{"run": r + 1} for r in range(runs)], work, "run int, rank int, loss double", y).toPandas()
    counts = found.groupby("rank").size()
    mode = int(counts[counts == counts.max()].index.min())
    best = found[found["rank"] == mode].sort_values(["loss", "run"]).run.iloc[0]
    table = spark.createDataFrame([(int(q), int(n), int(q) == mode) for q, n in counts.items()], "rank int, n int, chosen boolean")
    return table, nmf_ard(y, rank, seed=int(seed + best), **options)


def beta_cv(spark: SparkSession, y: np.ndarray, d2: np.ndarray, rank: int, betas: list[float], k: int = 5, seed: int = 123, family: str = "nmf", rank2: int | None = None, weights: np.ndarray | None = None, **options) -> DataFrame:
    """(beta, loss, chosen): column-wise cross-validation of a Gaussian kernel's bandwidth; squared distances are shared.

    A training fit has the kernel's train x train part as covariates, a prediction its train x test part. family: nmf, or rrr
    with ranks rank and rank2 (None: equal) of a two-sided model. weights: of y's cells, linear in fit and loss.
    """
    if family not in ("nmf", "rrr"):
        raise ValueError("family is nmf or rrr")
    y = np.asarray(y, float)
    fold = column_folds(y.shape[1], k, seed)

    def work(shared, beta, fold):
        y, d2, folds, w = shared
        a = np.exp(-beta * d2)
        train, test = folds != fold, folds == fold
        known = a[np.ix_(train, train)]
        part = None if w is None else w[:, train]
        fit = nmf(y[:, train], known, rank, weights=part, seed=seed, **options) if family == "nmf" else nmf_rrr(y[:, train], known, rank, rank2, weights=part, seed=seed, **options)
        held = np.ones((len(y), int(test.sum()))) if w is None else w[:, test]
        loss = held * (y[:, test] - response(fit, a[np.ix_(train, test)])) ** 2
        yield {"beta": float(beta), "loss": float(loss.sum()), "n": int((held > 0).sum())}

    scores = run_grid(spark, [{"beta": float(b), "fold": f} for b in betas for f in range(1, k + 1)], work, "beta double, loss double, n bigint", (y, d2, fold, weights))
    return _chosen(scores.groupBy("beta").agg((F.sum("loss") / F.sum("n")).alias("loss")), "beta")


def degree_cv(spark: SparkSession, y: np.ndarray, rank: int = 1, degrees=(1, 2), k: int = 5, intercept: bool = True, seed: int = 123, **options) -> DataFrame:
    """(degree, loss, chosen) of autoregressions y (variables x time), by contiguous blocks; failing degrees give null."""
    from .series import design

    def work(shared, degree, fold):
        y, a = design(shared, int(degree), intercept)
        if y.shape[1] < k:
            return [{"degree": int(degree), "loss": None, "n": 0}]
        folds = column_folds(y.shape[1], k, seed, shuffle=False)
        train, test = folds != fold, folds == fold
        fit = nmf(y[:, train], a[:, train], rank, seed=seed, **options)
        return [{"degree": int(degree), "loss": float(((y[:, test] - fit.fitted(a[:, test])) ** 2).sum()), "n": int(test.sum() * len(y))}]

    scores = run_grid(spark, [{"degree": int(d), "fold": f} for d in degrees for f in range(1, k + 1)], work, "degree int, loss double, n bigint", np.asarray(y, float))
    return _chosen(scores.groupBy("degree").agg((F.sum("loss") / F.nullif(F.sum("n"), F.lit(0))).alias("loss")), "degree")


def _chosen(curve: DataFrame, name: str) -> DataFrame:
    rows = sorted(curve.collect(), key=lambda r: r[name])  # one per candidate
    known = [r["loss"] for r in rows if r["loss"] is not None]
    best = next((r[name] for r in rows if known and r["loss"] == min(known)), None)
    return curve.sparkSession.createDataFrame([(r[name], r["loss"], r[name] == best) for r in rows], f"{name} {curve.schema[name].dataType.simpleString()}, loss double, chosen boolean")


def warm_start(y: np.ndarray, rank: int, **options) -> np.ndarray:
    """A basis to hand to many fits."""
    return initial_basis(np.asarray(y, float), rank, **options)
