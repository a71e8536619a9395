"""Mixed effects Y = X (C A + U) + E with random coefficients U; every step needs YY', YA' and AA' only.

Given X, C and the variances, a sample's random coefficients are a matrix T times its (y, a), so UU', YU' and AU' are T and the
joint Gram of (y, a). A fit of cells is one pass over the samples; U is a plan over them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions.dense import Dense, path_neighbours
from . import steps
from .algebra import dot, gram_numpy
from .fit import _dense, centroid_order, initial_basis
from .resample import element_folds, run_grid


@dataclass(frozen=True)
class Mixed:
    """x, c, u (random coefficients), variances, and what follows from them."""

    x: np.ndarray
    c: np.ndarray
    u: np.ndarray | DataFrame
    sigma2: float
    tau2: float
    nll: float
    trace: tuple[float, ...]
    converged: bool
    rows: list
    covariates: list
    n: float = 0

    @property
    def icc(self) -> float:
        return self.tau2 / (self.tau2 + self.sigma2)

    def fixed(self, a: np.ndarray) -> np.ndarray:
        return self.x @ (self.c @ a)

    def blup(self, a: np.ndarray) -> np.ndarray:
        return self.x @ (self.c @ a + self.u)

    def effects(self) -> np.ndarray:
        """T of U = T (Y; A)."""
        return random_effects(self.x, self.c, self.sigma2 / self.tau2)

    def df_u(self) -> float:
        p = self.x.T @ self.x
        return self.n * float(np.trace(p @ np.linalg.inv(p + self.sigma2 / self.tau2 * np.eye(len(p)))))


def random_effects(x: np.ndarray, c: np.ndarray, ratio: float) -> np.ndarray:
    """T = [M X', -M X'X C] with M = (X'X + ratio)^-1: the best linear prediction of U is T (Y; A)."""
    k = np.linalg.solve(x.T @ x + ratio * np.eye(x.shape[1]), x.T)
    return np.concatenate([k, -k @ x @ c], axis=1)


def marginal_nll(s: np.ndarray, n: float, x, c, sigma2: float, tau2: float) -> float:
    """Negative log-likelihood of Y_n ~ N(X C a_n, sigma2 I + tau2 X X'), from the Gram of (Y; A), by Q x Q algebra."""
    p = len(x)
    t = np.concatenate([np.eye(p), -x @ c], axis=1)  # the residuals are t (Y; A)
    rr = t @ s @ t.T
    m = x.T @ x + sigma2 / tau2 * np.eye(x.shape[1])
    quad = (float(np.trace(rr)) - float(np.trace(np.linalg.solve(m, x.T @ rr @ x)))) / sigma2
    logdet = p * math.log(sigma2) + np.linalg.slogdet(m)[1] + x.shape[1] * math.log(tau2 / sigma2)
    return 0.5 * (n * (logdet + p * math.log(2 * math.pi)) + quad)


def ridge_coefficients(g: np.ndarray, aa: np.ndarray, right: np.ndarray, ridge: float) -> np.ndarray:
    """C of G C AA' + ridge C = right, by the eigenvectors of both sides; without ridge by pseudo-inverses."""
    if not ridge:
        return np.linalg.pinv(g) @ right @ np.linalg.pinv(aa)
    d, v = np.linalg.eigh(g)
    e, w = np.linalg.eigh(aa)
    return v @ ((v.T @ right @ w) / (np.outer(np.maximum(d, 0), np.maximum(e, 0)) + ridge)) @ w.T


def mixed_from_gram(
    s: np.ndarray, n: float, x: np.ndarray, *, signed: bool = True, epsilon: float = 1e-5, outer: int = 500, inner: int = 50, sigma2: float | None = None, tau2: float | None = None, c_l2: float = 0.0, l2_ortho: float = 0.0, l2_smooth: float = 0.0
) -> dict:
    """x, c, sigma2, tau2, trace and converged, from the Gram s of (Y; A) over n samples and a starting basis."""
    p, rank = x.shape
    ya, aa = s[:p, p:], s[p:, p:]
    x = np.maximum(x, 1e-8)
    x = x / x.sum(axis=0)
    c = np.linalg.pinv(x) @ ya @ np.linalg.pinv(aa)
    if not signed:
        c = np.maximum(c, 1e-6)
    residual = lambda x, t: float(np.trace(s[:p, :p])) - 2 * float((x * (s[:p] @ t.T)).sum()) + float(((x.T @ x) * (t @ s @ t.T)).sum())  # noqa: E731 - of Y - X t (Y; A)
    both = lambda c, t: t + np.concatenate([np.zeros((rank, p)), c], axis=1)  # noqa: E731 - of C A + U
    s2 = sigma2 or residual(x, both(c, np.zeros((rank, len(s))))) / (p * n) / 2 + 1e-8
    t2 = tau2 or s2
    near = path_neighbours(p)
    trace, ok = [], False
    for _ in range(outer):
        lam, before = s2 / t2, None
        for _ in range(inner):
            m = np.linalg.inv(x.T @ x + lam * np.eye(rank))
            t = random_effects(x, c, lam)
            b = both(c, t)
            bb, yb = b @ s @ b.T + n * s2 * m, s[:p] @ b.T
            up = np.maximum(yb, 0) + x @ np.maximum(-bb, 0)
            down = np.maximum(-yb, 0) + x @ np.maximum(bb, 0) + 1e-12
            if l2_ortho:
                down = down + l2_ortho * steps.ortho(Dense, x)
            if l2_smooth:
                up, down = up + l2_smooth * (near @ x), down + l2_smooth * near.sum(axis=1, keepdims=True) * x
            x = x * np.sqrt(up / down)
            d = x.sum(axis=0)
            d = np.where(d > 1e-12, d, 1.0)
            x, c, t = x / d, c * d[:, None], t * d[:, None]
            gram, rest = x.T @ x, x.T @ (ya - x @ (t @ s[:, p:]))
            c = ridge_coefficients(gram, aa, rest, c_l2) if signed else c * np.maximum(rest, 0) / (gram @ c @ aa + c_l2 * c + 1e-12)
            value = residual(x, both(c, t)) + lam * float(np.trace(t @ s @ t.T)) + c_l2 * float((c**2).sum())
            if before is not None and abs(before - value) <= 1e-7 * max(abs(before), 1e-12):
                break
            before = value
        m = np.linalg.inv(x.T @ x + lam * np.eye(rank))
        t, old = random_effects(x, c, lam), s2
        s2 = sigma2 or max((residual(x, both(c, t)) + n * old * float(np.trace(x.T @ x @ m))) / (p * n), 1e-12)
        t2 = tau2 or max((float(np.trace(t @ s @ t.T)) + n * old * float(np.trace(m))) / (rank * n), 1e-12)
        trace.append(marginal_nll(s, n, x, c, s2, t2))
        if len(trace) > 1 and abs(trace[-1] - trace[-2]) <= epsilon * max(abs(trace[-2]), 1.0):
            ok = True
            break
    order = centroid_order(x)
    return {"x": x[:, order], "c": c[order], "sigma2": s2, "tau2": t2, "trace": tuple(trace), "converged": ok}


def nmf_mixed(y, a=None, rank: int = 2, *, init="kmeans", seed: int = 1, nstart: int = 1, **options) -> Mixed:
    """Alternates random coefficients (BLUP), basis (square-root semi-NMF step), C (least squares, with c_l2 a ridge, or
    multiplicative if not signed) and both variances (EM), until the marginal likelihood settles.

    y, a: arrays, or cells of any number of samples, which are reduced to the Gram of (Y; A) by one pass; u is then a plan, a
    table (col, u ARRAY<DOUBLE>). nstart: that many starts by name, of seeds one after another; the likeliest fit is kept.
    """
    cells = isinstance(y, DataFrame)
    if cells:
        from pyspark.sql import functions as F

        from .starts import start
        from .sums import paired_samples

        if a is None:
            a = y.select(F.lit("(Intercept)").alias("row"), "col", F.lit(1.0).alias("value")).distinct()
        table, rows, covariates = paired_samples(y, a, signed=True)
        joint = table.select("col", F.concat("y", "a").alias("z"))
        s, n, p = gram_numpy(joint, "z", "z"), float(table.count()), len(rows)
        positive = table.select("col", F.transform("y", lambda v: F.greatest(v, F.lit(0.0))).alias("y"))
        begin = lambda k: start(positive, rank, init, seed + k) if isinstance(init, str) else np.array(init, float)
    else:
        y, rows, _ = _dense(y)
        p, n = y.shape
        a, covariates = (np.ones((1, n)), ["(Intercept)"]) if a is None else _dense(a)[:2]
        z = np.concatenate([y, a])
        s = z @ z.T
        begin = lambda k: initial_basis(np.maximum(y, 0), rank, init, seed + k)
    fits = [mixed_from_gram(s, float(n), begin(k), **options) for k in range(max(1, nstart) if isinstance(init, str) else 1)]
    best = min(fits, key=lambda f: f["trace"][-1])
    t = random_effects(best["x"], best["c"], best["sigma2"] / best["tau2"])
    if cells:
        parts = F.array(*[F.array(*[F.lit(float(v)) for v in line]) for line in t])
        u = joint.select("col", F.transform(parts, lambda line: dot(line, F.col("z"))).alias("u"))
    else:
        u = t @ z
    return Mixed(best["x"], best["c"], u, best["sigma2"], best["tau2"], best["trace"][-1], best["trace"], best["converged"], rows, covariates, n)


def infer_mixed(spark: SparkSession, model: Mixed, y: np.ndarray, a: np.ndarray) -> DataFrame:
    """Standard errors of C from the information corrected for the random effects: (X' V^-1 X) kron (A A')."""
    from ..functions.dense import upper_tail

    x = model.x
    m = x.T @ x + model.sigma2 / model.tau2 * np.eye(x.shape[1])
    middle = (x.T @ x - x.T @ x @ np.linalg.solve(m, x.T @ x)) / model.sigma2
    v = np.linalg.pinv(np.kron(a @ a.T, middle), hermitian=True)
    se, e = np.sqrt(np.maximum(np.diag(v), 0)), model.c.T.ravel()
    names = [(f"Basis{q + 1}", str(k)) for k in model.covariates for q in range(x.shape[1])]
    rows = [(b, k, float(c), float(s), float(c / s) if s > 0 else None, min(1.0, 2 * upper_tail(abs(c / s))) if s > 0 else None) for (b, k), c, s in zip(names, e, se, strict=True)]
    return spark.createDataFrame(rows, "basis string, covariate string, estimate double, se double, z_value double, p_value double")


def ecv_mixed(spark: SparkSession, y: np.ndarray, a: np.ndarray | None = None, ranks=(1, 2), k: int = 5, rounds: int = 4, seed: int = 1, **options) -> DataFrame:
    """(rank, loss, sigma): held-out cells are filled from row means, then from the fit, `rounds` times."""
    from .resample import _averaged

    y = np.asarray(y, float)
    fold = element_folds(y.shape, k, seed)

    def work(shared, rank, fold):
        y, a, folds = shared
        held = folds == fold
        mean = np.where(held, np.nan, y)
        filled = np.where(held, np.nanmean(mean, axis=1, keepdims=True), y)
        for _ in range(rounds):
            model = nmf_mixed(filled, a, int(rank), seed=seed, **options)
            hat = model.blup(np.ones((1, y.shape[1])) if a is None else a)
            filled = np.where(held, hat, y)
        yield {"rank": int(rank), "fold": int(fold), "loss": float(((y - hat)[held] ** 2).mean())}

    return _averaged(run_grid(spark, [{"rank": int(q), "fold": f} for q in ranks for f in range(1, k + 1)], work, "rank int, fold int, loss double", (y, a, fold)))


def split_roles(y: np.ndarray, names: list[str], threshold: float = 0.1, n_exogenous: int | None = None, flip: bool = True) -> dict:
    """Exogenous and endogenous variables of y (variables x samples), from its correlation matrix alone.

    Variables are turned to agree with the first principal component, then ordered: next comes the one that the chosen
    ones influence least (largest standardized regression coefficient). The first whose influence exceeds the threshold
    begins the endogenous ones.
    """
    z = (y - y.mean(axis=1, keepdims=True)) / np.maximum(y.std(axis=1, ddof=1, keepdims=True), 1e-12)
    r = z @ z.T / max(1, y.shape[1] - 1)
    first = np.linalg.eigh(r)[1][:, -1]
    signs = np.where(first * np.sign(first.sum() or 1) < 0, -1.0, 1.0) if flip else np.ones(len(r))
    r = r * signs[:, None] * signs[None, :]
    order = [int(np.argmin(np.abs(r).sum(axis=1)))]
    influence = [0.0]
    while len(order) < len(r):
        inside = np.linalg.pinv(r[np.ix_(order, order)])
        rest = [i for i in range(len(r)) if i not in order]
        strength = [float((inside @ r[order, i]).max()) for i in rest]
        at = int(np.argmin(strength))
        order.append(rest[at])
        influence.append(strength[at])
    cut = n_exogenous or next((k for k, v in enumerate(influence) if k and v > threshold), len(order) - 1)
    return {"order": [names[i] for i in order], "influence": influence, "exogenous": [names[i] for i in order[:cut]], "endogenous": [names[i] for i in order[cut:]], "flipped": [n for n, s in zip(names, signs, strict=True) if s < 0]}
