"""Queries of resampling from sums over samples, and of starting bases of all samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.sqlmath import Program
from ..operators import infer, resample, starts, steps, sums
from ..operators.fit import nmf
from . import datasets as D
from .queries import _cells_of, _small, _start, query, rounded

_K = 3
_PLACES = f"sp AS ({D.SPENDING}), mk AS ({D.MARKETS}), who AS (SELECT j, row_number() OVER (ORDER BY j) AS pos FROM (SELECT DISTINCT j FROM sp))"
_FOLDED = f"{_PLACES}, folds AS (SELECT j, pos, ntile({_K}) OVER (ORDER BY ((123 + pos * 7919) * 48271) % 1000003, pos) AS fold FROM who)"


def _sums_of(p: Program, where: str):
    """YA', AA' and the squared norm of the customers that where chooses."""
    y = p.source(f"SELECT i, j, v FROM sp JOIN folds USING (j) WHERE {where}", (5, 0))
    a = p.source(f"SELECT i, j, v FROM mk JOIN folds USING (j) WHERE {where}", (5, 0))
    return y @ a.T, a @ a.T, p.sum(y * y)


def _cv_program(family: str) -> str:
    p, losses = Program(_FOLDED), []
    for f in range(1, _K + 1):
        ya, aa, _ = _sums_of(p, f"fold <> {f}")
        x = p.const(_start(5, 2))
        if family == "nmf":
            c = p.const(np.ones((2, 5)))
            for _ in range(3):
                x, c = steps.core_eu(p, x, c, ya, aa)
            m = x @ c
        elif family == "signed":
            cp, cn = p.const(_small((2, 5))), p.const(_small((2, 5), 2, 3))
            for _ in range(2):
                x, cp, cn = steps.signed(p, x, cp, cn, ya, p.pos(aa), p.pos(-aa))
            m = x @ (cp - cn)
        else:
            c, x2 = p.const(_small((2, 2), 2, 3)), p.const(_small((2, 5)))
            for _ in range(2):
                x, c, x2 = steps.reduced_rank(p, x, c, x2, ya, aa)
            m = (x @ c) @ x2
        ya, aa, yy = _sums_of(p, f"fold = {f}")
        loss = yy - 2 * p.sum(m * ya) + p.sum((m.T @ m) * aa)
        losses.append(f"SELECT v AS loss, 5 * (SELECT count(*) FROM folds WHERE fold = {f}) AS n FROM {loss.name}")
    return p.select(f"SELECT 2::INT AS rank, round(sum(loss) / sum(n), 6) AS loss, round(sqrt(sum(loss) / sum(n)), 6) AS sigma FROM ({' UNION ALL '.join(losses)})")


_STARTS = {
    "nmf": {"init": _start(5, 2), "fixed_iterations": 3}, "signed": {"init": _start(5, 2), "c_init": _small((2, 5)), "cn_init": _small((2, 5), 2, 3), "fixed_iterations": 2},
    "rrr": {"init": _start(5, 2), "c_init": _small((2, 2), 2, 3), "x2_init": _small((2, 5)), "fixed_iterations": 2},
}


def _cv_query(family: str) -> None:
    @query(f"cv_{family}_sums", lambda: _cv_program(family))
    def run(spark, d):
        return rounded(resample.cv(spark, D.spending(spark, d), D.markets(spark, d), (2,), _K, family=family, **_STARTS[family]))


for _family in _STARTS:
    _cv_query(_family)


@query("cv_sums_grid")
def _(spark, d):
    return rounded(resample.cv(spark, D.spending(spark, d), D.markets(spark, d), (1, 2, 3), 5, family="rrr", ranks2=(2, 3), maxit=300))


# ---------------------------------------------------------------- replicates

_DRAWS = 4
_U = f"""{_PLACES}, h AS (SELECT j, b, (pos * 7919 + b * 104729 + 123 * 1000003) % 2147483647 AS x FROM who, range(1, {_DRAWS + 1}) AS t(b)),
q AS (SELECT j, b, x, x * x % 2147483647 AS y FROM h), u AS (SELECT j, b, (y * y % 2147483647 * x % 2147483647 + 0.5) / 2147483647::DOUBLE AS u FROM q)"""
_POISSON = "CASE " + " ".join(f"WHEN u <= {float(c)!r} THEN {k}" for k, c in enumerate(sums._COUNTS)) + f" ELSE {len(sums._COUNTS)} END"
_M = _small((5, 5)) / 5


def _placed(spark, d):
    return sums.placed_samples(sums.paired_samples(D.spending(spark, d), D.markets(spark, d))[0])


def _replicates(found):
    return rounded(found.select("replicate", F.posexplode("values").alias("k", "value")))


_ALL_CELLS = "cells AS (SELECT i, j, coalesce(sp.v, 0.0) AS v FROM (SELECT DISTINCT i FROM sp) CROSS JOIN who LEFT JOIN sp USING (i, j))"


@query("pair_bootstrap_sums", f"""WITH {_U}, {_ALL_CELLS}, w AS (SELECT j, b, {_POISSON} AS w FROM u)
SELECT b AS replicate, (y.i * 5 + k.i)::INT AS k, round(sum(w * y.v * coalesce(a.v, 0.0)), 6) AS value FROM cells y CROSS JOIN (SELECT DISTINCT i FROM mk) k LEFT JOIN mk a ON a.j = y.j AND a.i = k.i JOIN w ON w.j = y.j GROUP BY ALL""")
def _(spark, d):
    return _replicates(sums.replicate_sums(_placed(spark, d), lambda y, a: y, lambda y, a: a, _DRAWS))


_WILD_M = ", ".join(f"({i}, {j}, {float(v)!r}::DOUBLE)" for (i, j), v in np.ndenumerate(_M))


@query("wild_bootstrap_sums", f"""WITH {_U}, {_ALL_CELLS}, w AS (SELECT j, b, CASE WHEN u < 0.5 THEN -1.0 ELSE 1.0 END AS w FROM u), m(i, k, m) AS (VALUES {_WILD_M}),
hat AS (SELECT m.i, a.j, sum(m.m * a.v) AS h FROM m JOIN mk a ON a.i = m.k GROUP BY ALL)
SELECT b AS replicate, (y.i * 5 + k.i)::INT AS k, round(sum(greatest(h + (y.v - h) * w, 0.0) * coalesce(a.v, 0.0)), 6) AS value FROM cells y JOIN hat USING (i, j) CROSS JOIN (SELECT DISTINCT i FROM mk) k LEFT JOIN mk a ON a.j = y.j AND a.i = k.i JOIN w ON w.j = y.j GROUP BY ALL""")
def _(spark, d):
    return _replicates(sums.wild_sums(_placed(spark, d), _M, _DRAWS))


def _spending_fit(spark, d):
    return nmf(D.spending(spark, d), D.markets(spark, d), 2, init=_start(5, 2), maxit=300)


@query("inference_sums")
def _(spark, d):
    """Coefficients of customers' spending by segment, with one-step draws from sums of scores."""
    return rounded(infer.infer(spark, _spending_fit(spark, d), *_shared(spark, d), draws=200))


@query("refit_bootstrap_sums")
def _(spark, d):
    return rounded(infer.infer(spark, _spending_fit(spark, d), *_shared(spark, d), method="refit", draws=40, refit_maxit=300))


def _shared(spark, d):
    """Spending and markets of the customers with orders."""
    y = D.spending(spark, d)
    return y, D.markets(spark, d).join(y.select("col").distinct(), "col", "left_semi")


@query("ffb_bootstrap_sums")
def _(spark, d):
    y, a = _shared(spark, d)
    y = y.withColumn("value", F.col("value") / 10)
    fit = sums.fit_ffb_sums(y, a, 2, init=_start(5, 2), maxit=200, l2_ortho=1.0)
    return rounded(infer.infer_ffb_cells(fit, y, a, draws=40, maxit=200))


# ---------------------------------------------------------------- starts


@query("start_nndsvd")
def _(spark, d):
    return _cells_of(spark, {"X": starts.nndsvd_samples(D.vectors(spark, d).select(F.col("id").alias("col"), F.transform("x", lambda v: F.abs(v)).alias("y")), 4)})


@query("start_kmeans")
def _(spark, d):
    return _cells_of(spark, {"X": starts.kmeans_samples(D.vectors(spark, d).select(F.col("id").alias("col"), F.transform("x", lambda v: F.abs(v)).alias("y")), 4)})
