"""Statistical inference for coefficients: information, sandwich, wild bootstrap by one step or by refitting."""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.dense import upper_tail
from .fit import Fit, equilibrium, nmf, nmf_ffb
from .resample import run_grid

TABLE = "basis string, covariate string, estimate double, se double, bse double, z_value double, p_value double, ci_low double, ci_high double, on_boundary boolean"


def multipliers(rng: np.random.Generator, n: int, kind: str = "rademacher") -> np.ndarray:
    """n bootstrap multipliers of mean 0 and variance 1."""
    if kind == "rademacher":
        return rng.choice([-1.0, 1.0], n)
    if kind == "exp":
        return rng.exponential(1.0, n) - 1
    if kind == "mammen":
        root = math.sqrt(5)
        return np.where(rng.uniform(size=n) < (root + 1) / (2 * root), (1 - root) / 2, (1 + root) / 2)
    raise ValueError("multipliers are rademacher, exp or mammen")


def scores(y: np.ndarray, x: np.ndarray, c: np.ndarray, a: np.ndarray, sigma2: float) -> np.ndarray:
    """QK x N score vectors, coefficients in column order (basis fastest)."""
    r = x.T @ (y - x @ c @ a)
    return -(a[:, None, :] * r[None, :, :]).reshape(-1, y.shape[1]) / sigma2


def score_outer(samples_df: DataFrame, x: np.ndarray, c: np.ndarray, sigma2: float) -> np.ndarray:
    """Sum of s_n s_n' over samples (y, a), in one distributed pass; it is QK x QK."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    def fold(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                y, a = (np.asarray(batch.column(k).flatten(), float).reshape(batch.num_rows, -1).T for k in (0, 1))
                s = scores(y, x, c, a, sigma2)
                total = s @ s.T if total is None else total + s @ s.T
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])

    rows = samples_df.select("y", "a").mapInArrow(fold, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((c.size, c.size))
    out[rows.i.to_numpy(), rows.j.to_numpy()] = rows.v.to_numpy()
    return out


def covariance(y, x, c, a, ridge: float = 1e-8, sandwich: bool = True):
    """(sigma2, inverse information, covariance, scores)."""
    p, n = y.shape
    df = max(1, p * n - c.size)
    sigma2 = max(float(((y - x @ c @ a) ** 2).sum()) / df, 1e-300)
    info = np.kron(a @ a.T, x.T @ x) / sigma2
    info += ridge * np.eye(len(info))
    inverse = np.linalg.pinv(info, hermitian=True)
    s = scores(y, x, c, a, sigma2)
    v = inverse @ (s @ s.T) @ inverse * n / max(1, n - 1) if sandwich else inverse
    return sigma2, inverse, v, s


def _dense_draws(spark, fit, y, a, sandwich, ridge, bootstrap, draws, kind, seed, method, unit, refit_epsilon, refit_maxit, signed):
    """(covariance, bootstrap draws or None) from arrays."""
    x, c = fit.x, fit.c
    _, inverse, v, s = covariance(y, x, c, a, ridge, sandwich)
    estimate = c.T.ravel()
    if not bootstrap:
        return v, None
    if method == "onestep":
        if unit == "element":
            r = y - x @ c @ a
            sigma2 = max(float((r**2).sum()) / max(1, y.size - c.size), 1e-300)
            shift = lambda draw: -(x.T @ (r * multipliers(np.random.default_rng([seed, draw]), y.size, kind).reshape(y.shape)) @ a.T).T.ravel() / sigma2
        else:
            shift = lambda draw: s @ multipliers(np.random.default_rng([seed, draw]), y.shape[1], kind)
        out = np.array([estimate - inverse @ shift(draw) for draw in range(draws)])
        return v, out if signed else np.maximum(out, 0)
    hat = fit.fitted(a)

    def work(shared, draw):
        y, hat, x, a, c = shared
        rng = np.random.default_rng([seed, int(draw)])
        w = multipliers(rng, y.size, kind).reshape(y.shape) if unit == "element" else multipliers(rng, y.shape[1], kind)
        again = nmf(np.maximum(hat + (y - hat) * w, 0), a, x.shape[1], init=x, c_init=np.maximum(c, 1e-8), restriction="fixed", epsilon=refit_epsilon, maxit=refit_maxit)
        yield {"draw": int(draw), "c": again.c.T.ravel().tolist()}

    rows = run_grid(spark, [{"draw": r} for r in range(draws)], work, "draw int, c array<double>", (y, hat, x, a, c)).toPandas().sort_values("draw")
    return v, np.array(rows.c.tolist(), float)


def _sums_draws(fit, y, a, sandwich, ridge, bootstrap, draws, kind, seed, method, refit_epsilon, refit_maxit, signed):
    """The same from cells: sums over samples in one pass each for the fit, the sandwich and all draws."""
    from . import sums as S

    both, rows, covariates = S.paired_samples(y, a, signed=signed)
    if rows != list(fit.rows) or covariates != list(fit.covariates):
        raise ValueError("the cells' rows and covariates aren't those of the fit")
    placed = S.placed_samples(both)
    x, c = fit.x, fit.c
    p, r = len(rows), len(covariates)
    whole = S.total(S.fold_sums(placed, p, r, 1))
    sigma2 = max(whole.loss(x @ c) / max(1.0, p * whole.n - c.size), 1e-300)
    info = np.kron(whole.aa, x.T @ x) / sigma2
    inverse = np.linalg.pinv(info + ridge * np.eye(len(info)), hermitian=True)
    v = inverse @ score_outer(placed, x, c, sigma2) @ inverse * whole.n / max(1, whole.n - 1) if sandwich else inverse
    if not bootstrap:
        return v, None
    estimate, m = c.T.ravel(), x @ c
    if method == "onestep":
        # a sample's score is the outer product of its covariates and of X' times its residual
        found = S.replicate_sums(placed, lambda _, a: a, lambda y, a: -((y - a @ m.T) @ x) / sigma2, draws, kind, seed)

        def moved(_, values):
            d = estimate - inverse @ values
            return [(_, (d if signed else np.maximum(d, 0)).tolist())]
    else:
        found = S.wild_sums(placed, m, draws, kind, seed)

        def moved(_, values):
            again = S.fit_sums(S.Sums(values.reshape(p, r), whole.aa, whole.yy, whole.n), fit.rank, init=x, c_init=np.maximum(c, 1e-8), restriction="fixed", epsilon=refit_epsilon, maxit=refit_maxit)
            return [(_, again.c.T.ravel().tolist())]

    rows = S.each_replicate(found, moved, "draw int, c array<double>").toPandas().sort_values("draw")  # draws times coefficients
    return v, np.array(rows.c.tolist(), float)


def infer(
    spark: SparkSession, fit: Fit, y, a, *, bootstrap: bool = True, draws: int = 500, level: float = 0.95, kind: str = "rademacher", seed: int = 123, sandwich: bool = True, side: str = "one", ridge: float = 1e-8, method: str = "onestep", unit: str = "column", boundary: float = 1e-3,
    refit_epsilon: float = 1e-8, refit_maxit: int = 100_000,
) -> DataFrame:
    """The coefficient table of Y ~ X C A with X held: standard errors, z, p (one- or two-sided) and bootstrap intervals.

    onestep: c - H^-1 sum w_n s_n (kept non-negative unless C has signs). refit: the fitted values plus residuals times
    multipliers are fitted anew, each draw a task of the grid. unit: a multiplier a column, or (arrays only) an element.
    y, a: arrays, or cells of any number of samples, of which only sums of the model's size are gathered; multipliers of cells
    come from the samples' and draws' numbers, so draws differ from those of arrays.
    """
    if unit not in ("column", "element") or method not in ("onestep", "refit"):
        raise ValueError("unit is column or element, method onestep or refit")
    c = fit.c
    signed = bool((c < 0).any()) or "cp" in fit.extra
    if isinstance(y, DataFrame):
        if unit == "element":
            raise ValueError("multipliers of elements are for arrays")
        v, table = _sums_draws(fit, y, a, sandwich, ridge, bootstrap, draws, kind, seed, method, refit_epsilon, refit_maxit, signed)
        n_covariates = len(fit.covariates)
    else:
        v, table = _dense_draws(spark, fit, y, a, sandwich, ridge, bootstrap, draws, kind, seed, method, unit, refit_epsilon, refit_maxit, signed)
        n_covariates = len(a)
    estimate = c.T.ravel()
    se = np.sqrt(np.maximum(np.diag(v), 0))
    low = high = bse = np.full(len(estimate), np.nan)
    if table is not None:
        bse = table.std(axis=0, ddof=1)
        low, high = np.quantile(table, (1 - level) / 2, axis=0), np.quantile(table, (1 + level) / 2, axis=0)
    z = np.divide(estimate, se, out=np.full(len(se), np.nan), where=se > 0)
    two = side == "two" or (side == "auto" and signed)
    p = [None if math.isnan(q) else min(1.0, 2 * upper_tail(abs(q))) if two else upper_tail(q) for q in z]
    names = [(b, str(k)) for k in (fit.covariates or [f"Cov{i + 1}" for i in range(n_covariates)]) for b in fit.bases]
    clean = lambda u: None if u is None or (isinstance(u, float) and math.isnan(u)) else float(u)
    edge = estimate <= boundary * max(float(np.abs(estimate).max()), 1e-300)
    rows = [(b, k, float(e), clean(float(s1)), clean(float(b1)), clean(float(z1)), clean(p1), clean(float(l1)), clean(float(h1)), bool(o1) and not signed) for (b, k), e, s1, b1, z1, p1, l1, h1, o1 in zip(names, estimate, se, bse, z, p, low, high, edge, strict=True)]
    return spark.createDataFrame(rows, TABLE)


def infer_network(spark: SparkSession, fit: Fit, y: np.ndarray, **options) -> DataFrame:
    """Inference for a network's C, with A = X'; only pairs of different bases, the first before the second."""
    from dataclasses import replace

    names = list(fit.bases)
    table = infer(spark, replace(fit, covariates=names), (y + y.T) / 2, fit.x.T, **options)
    rows = [r for r in table.collect() if names.index(r["basis"]) < names.index(r["covariate"])]  # Q x Q rows at most
    return spark.createDataFrame(rows, table.schema)


def infer_rrr(spark: SparkSession, fit: Fit, y1: np.ndarray, y2: np.ndarray, **options) -> DataFrame:
    """Inference for C of Y1 ~ X1 C (X2 Y2), with the encoded samples as covariates."""
    from dataclasses import replace

    z = fit.extra["x2"] @ y2
    inner = replace(fit, covariates=list(fit.factors))
    return infer(spark, inner, y1, z, **({"side": "two"} if fit.family == "rrr_signed" else {}) | options)


def infer_ffb(spark: SparkSession, fit: Fit, y1: np.ndarray, y2: np.ndarray, *, draws: int = 1000, threshold: float = 0.01, level: float = 0.95, c1_l1: float = 1.0, c2_l1: float = 0.1, seed: int = 123, maxit: int = 2000) -> DataFrame:
    """Pair bootstrap of the paths with X held: support rate, interval and bse of each entry of C1 and C2.

    A replicate is a vector of resampling counts; unstable, singular or over-amplified replicates don't count.
    """

    def work(shared, draw):
        y1, y2, x = shared
        rng = np.random.default_rng([seed, 1000 + int(draw)])
        pick = rng.integers(0, y1.shape[1], y1.shape[1])
        q = x.shape[1]
        again = nmf_ffb(y1[:, pick], y2[:, pick], q, init=x, c1_init=rng.uniform(0, 0.1, (q, len(y1))), c2_init=rng.uniform(0, 1, (q, len(y2))), c1_l1=c1_l1, c2_l1=c2_l1, l2_ortho=0.0, maxit=maxit)
        o = equilibrium(again.x, again.c, again.extra["c2"])
        valid = o["radius"] < 1 and o["m"] is not None and (not math.isfinite(o["bound"]) or o["amplification"] <= 1.01 * o["bound"])
        both = np.concatenate([again.c, again.extra["c2"]], axis=1)
        for basis in range(q):
            for k in range(both.shape[1]):
                yield {"draw": int(draw), "basis": basis, "k": k, "value": float(both[basis, k]) if valid else None}

    rows = run_grid(spark, [{"draw": r} for r in range(draws)], work, "draw int, basis int, k int, value double", (y1, y2, fit.x)).toPandas()
    both = np.concatenate([fit.c, fit.extra["c2"]], axis=1)
    out = []
    for (basis, k), group in rows.groupby(["basis", "k"]):
        v = group.value.dropna().to_numpy()
        kind = "C1" if k < len(y1) else "C2"
        name = fit.rows[k] if kind == "C1" else fit.covariates[k - len(y1)]
        support = float((v > threshold).mean()) if len(v) else None
        out.append((kind, f"Basis{basis + 1}", str(name), float(both[basis, k]), float(v.std(ddof=1)) if len(v) > 1 else None, *(float(np.quantile(v, u)) if len(v) else None for u in ((1 - level) / 2, (1 + level) / 2)), support, None if support is None else 1 - support))
    return spark.createDataFrame(pd.DataFrame(out, columns=["type", "basis", "covariate", "estimate", "bse", "ci_low", "ci_high", "support_rate", "prob_unsupported"]), "type string, basis string, covariate string, estimate double, bse double, ci_low double, ci_high double, support_rate double, prob_unsupported double")


def infer_ffb_cells(fit: Fit, y1: DataFrame, y2: DataFrame, *, draws: int = 1000, threshold: float = 0.01, level: float = 0.95, c1_l1: float = 1.0, c2_l1: float = 0.1, seed: int = 123, maxit: int = 2000) -> DataFrame:
    """infer_ffb() of cells of any number of samples: one pass gives Y1 Y1', Y1 Y2' and Y2 Y2' of every replicate, whose counts
    come from the samples' and the replicate's numbers; replicates are refitted and summarized where they are. With fewer than
    ten valid replicates the intervals are null."""
    from pyspark.sql import functions as F

    from . import sums as S

    both, rows, exogenous = S.paired_samples(y1, y2)
    placed, p, q = S.placed_samples(both), len(rows), fit.rank
    joined = lambda y, a: np.concatenate([y, a], axis=1)
    found = S.replicate_sums(placed, joined, joined, draws, "pairs", seed)
    x, n = fit.x, p + len(exogenous)

    def work(draw, values):
        s = values.reshape(n, n)
        rng = np.random.default_rng([seed, 1000 + draw])
        _, c1, c2, _, _ = S.feedback_sums(s[:p, :p], s[:p, p:], s[p:, p:], x, rng.uniform(0, 0.1, (q, p)), rng.uniform(0, 1, (q, n - p)), c1_l1=c1_l1, c2_l1=c2_l1, maxit=maxit, held=True)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            o = equilibrium(x, c1, c2)
        if o["radius"] < 1 and o["m"] is not None and (not math.isfinite(o["bound"]) or o["amplification"] <= 1.01 * o["bound"]):
            for (basis, k), value in np.ndenumerate(np.concatenate([c1, c2], axis=1)):
                yield draw, basis, k, float(value)

    values = S.each_replicate(found, work, "draw int, basis int, k int, value double").groupBy("basis", "k")
    enough = F.count("*") >= 10
    tail = lambda u: F.when(enough, F.expr(f"percentile(value, {u!r})"))
    support = F.avg(F.when(F.col("value") > threshold, 1.0).otherwise(0.0))
    summary = values.agg(F.count("*").alias("valid"), F.stddev_samp("value").alias("bse"), tail((1 - level) / 2).alias("ci_low"), tail((1 + level) / 2).alias("ci_high"), support.alias("support_rate"), (1 - support).alias("prob_unsupported"))
    whole = np.concatenate([fit.c, fit.extra["c2"]], axis=1)
    names = [("C1", str(r)) for r in rows] + [("C2", str(r)) for r in exogenous]
    known = y1.sparkSession.createDataFrame([(b, k, *names[k], f"Basis{b + 1}", float(v)) for (b, k), v in np.ndenumerate(whole)], "basis int, k int, type string, covariate string, name string, estimate double")
    return known.join(summary, ["basis", "k"], "left").select("type", F.col("name").alias("basis"), "covariate", "estimate", "bse", "ci_low", "ci_high", "support_rate", "prob_unsupported", F.coalesce("valid", F.lit(0)).alias("valid"))
