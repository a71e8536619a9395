"""Queries of latent dynamics' plot data and diagnostics, of mixed effects from sums, and of expected kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.sqlmath import Program
from ..operators import mixed, prep, resample, steps
from ..operators import series as ts
from ..operators.fit import nmf
from . import datasets as D
from .queries import ITERATIONS, _columns, _halves, _series_matrix, _start, ar_fit, query, rounded, rounded_pairs
from .queries import _ar_program as _two_lags
from .queries_weighted import _gapped

_ORDER = "SELECT k AS i, 0::BIGINT AS j, row_number() OVER (ORDER BY c, k) - 1 AS v FROM (SELECT j AS k, sum((i + 1) * v) / 5 AS c FROM {x} GROUP BY j)"


def _lags():
    """(program, G_1, G_2, order of the bases) of the fixed two-lag fit."""
    p, x, c = _two_lags()
    g = [_columns(p, c, 0, 5) @ x, _columns(p, c, 5, 10) @ x]
    return p, *g, p.add(_ORDER.format(x=x.name), (2, 1)).name


def _profile_sql() -> str:
    p, g1, g2, o = _lags()
    return p.select(" UNION ALL ".join(f"SELECT {d} AS lag, a.v::INT AS effect, b.v::INT AS cause, round(m.v, 6) AS value FROM {m.name} m JOIN {o} a ON a.i = m.i JOIN {o} b ON b.i = m.j" for d, m in ((1, g1), (2, g2))))


@query("ar_lag_profile", _profile_sql)
def _(spark, d):
    fit, _, _ = ar_fit(spark, d)
    return rounded(ts.lag_profile(spark, ts.latent(fit.x, fit.c, 2).g))


def _graph_sql() -> str:
    p, g1, g2, o = _lags()
    total = g1 + g2
    return p.select(f"SELECT b.v::INT AS cause, a.v::INT AS effect, round(m.v, 6) AS value, a.v = b.v AS self, round(m.v / max(m.v) OVER (), 6) AS width FROM {total.name} m JOIN {o} a ON a.i = m.i JOIN {o} b ON b.i = m.j WHERE m.v > 0")


@query("ar_latent_graph", _graph_sql)
def _(spark, d):
    fit, _, _ = ar_fit(spark, d)
    return rounded(ts.latent_graph(spark, ts.latent(fit.x, fit.c, 2).g)[1])


# ---------------------------------------------------------------- phase data of one lag


def _one_lag():
    p = Program(f"raw AS ({D.SERIES}), s AS (SELECT dense_rank() OVER (ORDER BY var) - 1 AS k, t, value AS v FROM raw), n AS (SELECT max(t) AS m FROM s)")
    y = p.source("SELECT k AS i, t - 1 AS j, v FROM s WHERE t >= 1", (5, 0))
    a = p.source("SELECT k AS i, t AS j, v FROM s WHERE t < (SELECT m FROM n) UNION ALL SELECT 5, t, 1.0::DOUBLE FROM s WHERE k = 0 AND t < (SELECT m FROM n)", (6, 0))
    ya, aa = y @ a.T, a @ a.T
    x, c = p.const(_start(5, 2)), p.const(np.ones((2, 6)))
    for _ in range(ITERATIONS):
        x, c = steps.core_eu(p, x, c, ya, aa)
    g, theta = _columns(p, c, 0, 5) @ x, _columns(p, c, 5, 6)
    o = p.add(_ORDER.format(x=x.name), (2, 1)).name
    g = p.add(f"SELECT a.v AS i, b.v AS j, m.v FROM {g.name} m JOIN {o} a ON a.i = m.i JOIN {o} b ON b.i = m.j", (2, 2))
    return p, g, p.add(f"SELECT a.v AS i, 0::BIGINT AS j, m.v FROM {theta.name} m JOIN {o} a ON a.i = m.i", (2, 1))


_STARTS = ((0.5, 9.0), (9.0, 0.5), (1.0, 1.0))
_EXTENT, _TICKS = 8.0, 5


def _phase(spark, d):
    y, _ = _series_matrix(spark, d)
    target, a = ts.design(y, 1)
    fit = nmf(target, a, 2, init=_start(5, 2), fixed_iterations=ITERATIONS)
    return ts.phase_data(spark, ts.latent(fit.x, fit.c, 1), np.array(_STARTS), 4, _TICKS, _EXTENT)


def _paths_sql() -> str:
    p, g, theta = _one_lag()
    now = p.const(np.array(_STARTS).T)
    parts = []
    for t in range(5):
        parts.append(f"SELECT a.j::INT AS start, {t} AS t, round(a.v, 6) AS b1, round(b.v, 6) AS b2 FROM {now.name} a JOIN {now.name} b ON a.j = b.j AND a.i = 0 AND b.i = 1")
        now = g @ now + theta
    return p.select(" UNION ALL ".join(parts))


@query("phase_paths", _paths_sql)
def _(spark, d):
    return rounded(_phase(spark, d)[0])


def _flow_sql() -> str:
    p, g, theta = _one_lag()
    ticks = [_EXTENT * k / (_TICKS - 1) for k in range(_TICKS)]
    points = p.const(np.array([[u, v] for u in ticks for v in ticks]).T)
    step = g @ points + theta - points
    return p.select(f"SELECT round(a.v, 6) AS b1, round(b.v, 6) AS b2, round(c.v, 6) AS d1, round(e.v, 6) AS d2 FROM {points.name} a JOIN {points.name} b ON a.j = b.j AND a.i = 0 AND b.i = 1 JOIN {step.name} c ON c.j = a.j AND c.i = 0 JOIN {step.name} e ON e.j = a.j AND e.i = 1")


@query("phase_flow", _flow_sql)
def _(spark, d):
    return rounded(_phase(spark, d)[1])


def _nullclines_sql() -> str:
    p, g, theta = _one_lag()
    m = g - p.const(np.eye(2))
    parts = [f"SELECT 'null{i + 1}' AS line, u AS b1, round(-(a.v * u + t.v) / b.v, 6) AS b2 FROM (VALUES (0.0::DOUBLE), ({_EXTENT!r}::DOUBLE)) AS k(u), {m.name} a, {m.name} b, {theta.name} t WHERE a.i = {i} AND a.j = 0 AND b.i = {i} AND b.j = 1 AND t.i = {i}" for i in (0, 1)]
    return p.select(" UNION ALL ".join(parts))


@query("phase_nullclines", _nullclines_sql)
def _(spark, d):
    return rounded(_phase(spark, d)[2].where("line <> 'fixed'"))


@query("latent_summary")
def _(spark, d):
    """Radius, long-run means and shares of a one-lag fit with their intervals over replicates, and what identifies it."""
    y, _ = _series_matrix(spark, d)
    target, a = ts.design(y, 1)
    found = ts.infer_latent(spark, nmf(target, a, 2, maxit=300, epsilon=1e-6), target, a, 1, draws=16, maxit=200, epsilon=1e-6)[1]
    rows = [("radius", 0, found["radius"], *map(float, found["ci"])), ("prob_nonstationary", 0, found["prob_nonstationary"], None, None), ("identified", 0, float(found["identified"]), None, None)]
    rows += [(name, k, *v) for name in ("mean_y", "shares") for k, v in enumerate(found[name])]
    rows += [(f"margin_{k}", 0, None if v is None else float(v), None, None) for k, v in found["margins"].items()]
    return rounded(spark.createDataFrame(rows, "name string, k int, estimate double, ci_low double, ci_high double"))


# ---------------------------------------------------------------- mixed effects from sums


@query("mixed_sums")
def _(spark, d):
    """Random effects of every customer's spending by priority, given its segment."""
    model = mixed.nmf_mixed(D.spending(spark, d), D.markets(spark, d), 2, init=_start(5, 2), outer=20, inner=10)
    return rounded(model.u.select("col", F.posexplode("u").alias("basis", "value")))


# ---------------------------------------------------------------- kernels


@query("kernel_expected")
def _(spark, d):
    x = _gapped(spark, d)
    return rounded_pairs(prep.kernel_expected(x, x, 0.05, prep.mixture(x, 2, iterations=20)))


@query("beta_cv_rrr")
def _(spark, d):
    y1, y2, *_ = _halves(spark, d)
    d2 = ((y2[:, :, None] - y2[:, None, :]) ** 2).sum(axis=0)
    return rounded(resample.beta_cv(spark, y1, d2 / d2.mean(), 2, [0.1, 1.0, 10.0], 3, family="rrr", maxit=100))

