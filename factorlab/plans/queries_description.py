"""Queries of what fits say: errors by family, memberships, classes, coefficient tables, names and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sqlmath import Program
from ..operators import criteria, describe, predict, steps
from ..operators.fit import nmf_ffb, nmf_net, nmf_rrr, nmf_signed
from ..sources import cells as C
from . import datasets as D
from .queries import _BOTH, ITERATIONS, _dense_revenue, _factors, _halves, _network, _ordered_sql, _small, _start, query, rounded
from .queries_weighted import _MIRRORED_SQL, _RRR_START, _TRI, _WEIGHT_SQL, _weights

_PATHS = {"init": _start(3, 2), "c1_init": _small((2, 3)) / 10, "c2_init": _small((2, 2), 2, 3), "l2_ortho": 1.0, "fixed_iterations": ITERATIONS}


def _order(p: Program, x) -> str:
    """Name of (i: basis, v: its place in canonical order)."""
    return p.add(f"SELECT k AS i, 0::BIGINT AS j, row_number() OVER (ORDER BY c, k) - 1 AS v FROM (SELECT j AS k, sum((i + 1) * v) / {x.shape[0]} AS c FROM {x.name} GROUP BY j)", (x.shape[1], 1)).name


def _weighted_cells(spark, m, w):
    """Cells with weights, both of model-sized arrays; rows and columns count from 0."""
    at = lambda x: C.to_cells(spark, x, list(range(x.shape[0])), list(range(x.shape[1])))
    return at(m).join(at(w).withColumnRenamed("value", "weight"), ["row", "col"]), at


# ---------------------------------------------------------------- errors by family


def _errors_sql(family: str) -> str:
    p = Program(_BOTH if family == "rrr" else "")
    if family == "rrr":
        y, y2 = p.source("SELECT * FROM y1", (3, 25)), p.source("SELECT * FROM y2", (2, 25))
        w, state = y.map(_WEIGHT_SQL), [p.const(m) for m in _RRR_START]
        for _ in range(2):
            state = steps.reduced_rank_cells(p, *state, y, y2, w)
        hat = state[0] @ (state[1] @ (state[2] @ y2))
    elif family == "net":
        y = p.source(D.TRADE, (25, 25))
        w, state = y.map(_MIRRORED_SQL), [p.const(_start(25, 2)), p.const(_TRI)]
        for _ in range(2):
            state = steps.network_tri(p, *state, y, w=w)
        hat = (state[0] @ state[1]) @ state[0].T
    else:
        y, a = p.source(D.REVENUE, (5, 25)), p.source(D.REGIONS, (5, 25))
        y, a = y - p.sum(y, 1) / 25, a - p.sum(a, 1) / 25
        s = a @ a.T
        w, state = y.map(_WEIGHT_SQL), [p.const(_start(5, 2)), p.const(_small((2, 5))), p.const(_small((2, 5), 2, 3))]
        for _ in range(2):
            state = steps.signed(p, *state, y @ a.T, p.pos(s), p.pos(-s), l2_smooth=0.5)
        hat = (state[0] @ (state[1] - state[2])) @ a
    n = "sum(w.v)" if family == "net" else "count(*)"
    mae = "sum(w.v * abs(y.v - h.v)) / sum(w.v)" if family == "net" else "avg(abs(y.v - h.v))"
    return p.select(f"SELECT round(sqrt(sum(w.v * pow(y.v - h.v, 2)) / {n}), 6) AS sigma, round({mae}, 6) AS mae FROM {y.name} y JOIN {hat.name} h USING (i, j) JOIN {w.name} w USING (i, j) WHERE w.v > 0")


def _errors(family: str) -> None:
    @query(f"errors_{family}", lambda: _errors_sql(family))
    def run(spark, d):
        if family == "rrr":
            y, y2, *_ = _halves(spark, d)
            fit = nmf_rrr(y, y2, 2, weights=_weights(y.shape), init=_RRR_START, fixed_iterations=2)
            hat, w = fit.x @ fit.extra["b1"], _weights(y.shape)
        elif family == "net":
            y = _network(spark, d)
            w = _weights(y.shape, True)
            fit = nmf_net(y, 2, weights=w, init=_start(25, 2), c_init=_TRI, fixed_iterations=2)
            hat = fit.x @ fit.c @ fit.x.T
        else:
            y, a = _dense_revenue(spark, d)
            y, a, w = y - y.mean(axis=1, keepdims=True), a - a.mean(axis=1, keepdims=True), _weights(y.shape)
            hat = nmf_signed(y, a, 2, init=_start(5, 2), cp_init=_small((2, 5)), cn_init=_small((2, 5), 2, 3), l2_smooth=0.5, fixed_iterations=2).fitted(a)
        cells, at = _weighted_cells(spark, y, w)
        return rounded(criteria.family_errors(cells, at(hat), family))


for _family in ("rrr", "net", "signed"):
    _errors(_family)


# ---------------------------------------------------------------- memberships and classes


@query("memberships", _ordered_sql("""SELECT 'X' AS side, seg AS item, q::BIGINT AS basis, round(v / (sum(v) OVER (PARTITION BY i) + 1e-10), 6) AS share, first_value(q) OVER (PARTITION BY i ORDER BY v DESC, q)::BIGINT AS label FROM x JOIN s USING (i)
UNION ALL SELECT 'B', j::VARCHAR, q::BIGINT, round(v / (sum(v) OVER (PARTITION BY j) + 1e-10), 6), first_value(q) OVER (PARTITION BY j ORDER BY v DESC, q)::BIGINT FROM b"""))
def _(spark, d):
    _, b, x, _ = _factors(spark, d)
    return rounded(criteria.memberships(x, b))


def _rrr_class_sql() -> str:
    p = Program(_BOTH)
    y1, y2 = p.source("SELECT * FROM y1", (3, 25)), p.source("SELECT * FROM y2", (2, 25))
    state = [p.const(m) for m in _RRR_START]
    for _ in range(ITERATIONS):
        state = steps.reduced_rank(p, *state, y1 @ y2.T, y2 @ y2.T)
    hat = state[0] @ (state[1] @ (state[2] @ y2))
    top = lambda m: f"(SELECT j, seg FROM {m.name} JOIN {D.SEGMENTS} s USING (i) QUALIFY row_number() OVER (PARTITION BY j ORDER BY v DESC, seg) = 1)"
    return p.select(f"SELECT h.j AS col, h.seg AS label, y.seg AS actual FROM {top(hat)} h JOIN {top(y1)} y USING (j)")


@query("rrr_class", _rrr_class_sql)
def _(spark, d):
    y1, y2, rows, covariates = _halves(spark, d)
    fit = nmf_rrr(y1, y2, 2, init=_RRR_START, fixed_iterations=ITERATIONS)
    fit = type(fit)(**(fit.__dict__ | {"rows": rows, "covariates": covariates}))
    cols = list(range(25))
    return predict.classes(fit, C.to_cells(spark, y2, covariates, cols), C.to_cells(spark, y1, rows, cols))


# ---------------------------------------------------------------- coefficient tables and names


def _paths_sql(named: bool = False) -> str:
    p = Program(_BOTH)
    y1, y2 = p.source("SELECT * FROM y1", (3, 25)), p.source("SELECT * FROM y2", (2, 25))
    start = _start(3, 2)
    x, c1, c2 = p.const(start / start.sum(axis=0)), p.const(_PATHS["c1_init"]), p.const(_PATHS["c2_init"])
    for _ in range(ITERATIONS):
        x, c1, c2 = steps.feedback(p, x, c1, c2, y1 @ y1.T, y1 @ y2.T, y2 @ y2.T, 1.0, 1.0, 0.1)
    o = _order(p, x)
    basis = "CASE o.v WHEN 0 THEN 'first' ELSE 'Basis' || (o.v + 1) END" if named else "'Basis' || (o.v + 1)"
    part = lambda kind, m, shift: f"SELECT '{kind}' AS type, {basis} AS basis, s.seg AS covariate, round(m.v, 6) AS estimate FROM {m.name} m JOIN {o} o ON o.i = m.i JOIN {D.SEGMENTS} s ON s.i = m.j + {shift}"
    return p.select(f"{part('C1', c1, 0)} UNION ALL {part('C2', c2, 3)}")


def _path_fit(spark, d):
    y1, y2, rows, covariates = _halves(spark, d)
    fit = nmf_ffb(y1, y2, 2, **_PATHS)
    return type(fit)(**(fit.__dict__ | {"rows": rows, "covariates": covariates}))


@query("path_coefficients", _paths_sql)
def _(spark, d):
    return rounded(predict.path_coefficients(spark, _path_fit(spark, d)))


@query("coefficients_renamed", lambda: _paths_sql(True))
def _(spark, d):
    return describe.relabel_coefficients(rounded(predict.path_coefficients(spark, _path_fit(spark, d))), {"Basis1": "first"})


# ---------------------------------------------------------------- graphs


def _members_sql() -> str:
    p = Program()
    y, state = p.source(D.TRADE, (25, 25)), None
    state = [p.const(_start(25, 2)), p.const(_TRI)]
    for _ in range(2):
        state = steps.network_tri(p, *state, y)
    o = _order(p, state[0])
    return p.select(f"SELECT * FROM (SELECT m.i AS row, o.v::BIGINT AS col, round(m.v / (sum(m.v) OVER (PARTITION BY m.i) + 1e-16), 6) AS value FROM {state[0].name} m JOIN {o} o ON o.i = m.j) WHERE value >= 0.6")


@query("network_members", _members_sql)
def _(spark, d):
    fit = nmf_net(_network(spark, d), 2, init=_start(25, 2), c_init=_TRI, fixed_iterations=2)
    shares = rounded(describe.members(C.to_cells(spark, fit.x, list(range(25)), [0, 1])))
    return shares.where(F.col("value") >= 0.6)


@query("dot_paths")
def _(spark, d):
    """The graph of a path model, with its bases named."""
    fit = describe.relabel(_path_fit(spark, d), bases=["trade", "service"])
    return spark.createDataFrame([("ffb", describe.fit_dot(fit))], "model string, dot string")
