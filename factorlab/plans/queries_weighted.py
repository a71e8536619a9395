"""Queries of fits with weights, masks and Kullback-Leibler loss, and of vectors with gaps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.sqlmath import Program
from ..operators import criteria, prep, resample, steps
from ..operators.fit import nmf_net, nmf_rrr
from . import datasets as D
from .queries import _BOTH, _HASH, ITERATIONS, _cells_of, _dense_revenue, _fit_sql, _halves, _network, _small, _start, query, rounded

#: Weights by place: a third of the cells count half, some not at all.
_WEIGHT_SQL = "CASE WHEN (i + 2 * j) % 3 = 0 THEN 0.5 WHEN (i + j) % 7 = 0 THEN 0.0 ELSE 1.0 END"
#: The same, symmetric.
_MIRRORED_SQL = "CASE WHEN (i + j) % 3 = 0 THEN 0.5 WHEN (i + j) % 7 = 0 THEN 0.0 ELSE 1.0 END"


def _weights(shape: tuple[int, int], mirrored: bool = False) -> np.ndarray:
    i, j = np.indices(shape)
    return np.where((i + (1 if mirrored else 2) * j) % 3 == 0, 0.5, np.where((i + j) % 7 == 0, 0.0, 1.0))


# ---------------------------------------------------------------- reduced-rank regression

_RRR_START = (_start(3, 2), _small((2, 2), 2, 3), _small((2, 2)))
_SIGNED_START = (_start(3, 2), _small((2, 2), 2, 3), _small((2, 2), 1, 4), _small((2, 2)))


def _rrr_program(weighted: bool, kl: bool = False, signed: bool = False):
    p = Program(_BOTH)
    y1, y2 = p.source("SELECT * FROM y1", (3, 25)), p.source("SELECT * FROM y2", (2, 25))
    w = y1.map(_WEIGHT_SQL) if weighted else None
    state = [p.const(m) for m in (_SIGNED_START if signed else _RRR_START)]
    if signed:
        y1 = y1 - p.sum(y1, 1) / 25
    for _ in range(3):
        state = steps.signed_reduced_rank_cells(p, *state, y1, y2, w) if signed else steps.reduced_rank_cells(p, *state, y1, y2, w, kl)
    x1, x2 = state[0], state[-1]
    c = state[1] - state[2] if signed else state[1]
    return _fit_sql(p, {"X1": (x1, None, "o1"), "C": (c, "o1", "o2"), "X2": (x2, "o2", None)}, {"o1": (x1, False), "o2": (x2, True)})


def _rrr_query(name: str, weighted: bool, kl: bool = False, signed: bool = False) -> None:
    @query(name, lambda: _rrr_program(weighted, kl, signed))
    def run(spark, d):
        y1, y2, *_ = _halves(spark, d)
        if signed:
            y1 = y1 - y1.mean(axis=1, keepdims=True)
        fit = nmf_rrr(y1, y2, 2, signed=signed, method="KL" if kl else "EU", weights=_weights(y1.shape) if weighted else None, init=_SIGNED_START if signed else _RRR_START, fixed_iterations=3)
        return _cells_of(spark, {"X1": fit.x, "C": fit.c, "X2": fit.extra["x2"]})


_rrr_query("rrr_weighted_fixed", True)
_rrr_query("rrr_kl_fixed", False, kl=True)
_rrr_query("rrr_kl_weighted_fixed", True, kl=True)
_rrr_query("signed_rrr_weighted_fixed", True, signed=True)


# ---------------------------------------------------------------- networks

_TRI, _NEGATIVE = np.ones((2, 2)) + np.eye(2), np.full((2, 2), 0.2)


def _net_program(kind: str):
    p = Program()
    y, x = p.source(D.TRADE, (25, 25)), p.const(_start(25, 2))
    w = y.map(_MIRRORED_SQL)
    if kind == "bi":
        for _ in range(ITERATIONS):
            x = steps.network_bi(p, x, y, w=w)
        return _fit_sql(p, {"X": (x, None, "X")}, {"X": (x, False)})
    state = [x, p.const(_TRI)] + ([p.const(_NEGATIVE)] if kind == "signed" else [])
    for _ in range(3):
        state = (steps.network_tri if kind == "tri" else steps.network_signed)(p, *state, y, w=w)
    c = state[1] if kind == "tri" else state[1] - state[2]
    return _fit_sql(p, {"X": (state[0], None, "X"), "C": (c, "X", "X")}, {"X": (state[0], False)})


def _net_query(kind: str) -> None:
    @query(f"net_{kind}_weighted_fixed", lambda: _net_program(kind))
    def run(spark, d):
        fit = nmf_net(_network(spark, d), 2, kind, weights=_weights((25, 25), True), init=_start(25, 2), c_init=_TRI, cn_init=_NEGATIVE, fixed_iterations=ITERATIONS if kind == "bi" else 3)
        return _cells_of(spark, {"X": fit.x} | ({} if kind == "bi" else {"C": fit.c}))


for _kind in ("tri", "bi", "signed"):
    _net_query(_kind)


# ---------------------------------------------------------------- element-wise cross-validation by masks

_FOLDS = 3


def _masked_program(family: str) -> str:
    """Losses of two-step fits, each from the same start with a fold's cells at weight 0."""
    p = Program(_BOTH if family == "rrr" else "")
    if family == "net":
        y = p.source(D.TRADE, (25, 25))
        half = f"SELECT i, j, ntile({_FOLDS}) OVER (ORDER BY {_HASH.format(i='(i + 1)', j='(j + 1)')}, i, j)::DOUBLE AS v FROM {y.name} WHERE i <= j"
        fold = p.add(f"WITH u AS ({half}) SELECT i, j, v FROM u UNION ALL SELECT j, i, v FROM u WHERE i < j", (25, 25))
    else:
        y = p.source("SELECT * FROM y1" if family == "rrr" else D.REVENUE, (3 if family == "rrr" else 5, 25))
        fold = p.add(f"SELECT i, j, ntile({_FOLDS}) OVER (ORDER BY {_HASH.format(i='(i + 1)', j='(j + 1)')}, i, j)::DOUBLE AS v FROM {y.name}", y.shape)
    y2 = p.source("SELECT * FROM y2", (2, 25)) if family == "rrr" else None
    losses = []
    for f in range(1, _FOLDS + 1):
        w = fold.map(f"CASE WHEN v = {f} THEN 0.0 ELSE 1.0 END")
        if family == "nmf":
            state = [p.const(_start(5, 2)), p.const(np.ones((2, 25)))]
        else:
            state = [p.const(m) for m in (_RRR_START if family == "rrr" else (_start(25, 2), _TRI))]
        for _ in range(2):
            if family == "nmf":
                state = steps.core_weighted(p, *state, y, w)
            elif family == "rrr":
                state = steps.reduced_rank_cells(p, *state, y, y2, w)
            else:
                state = steps.network_tri(p, *state, y, w=w)
        hat = state[0] @ state[1] if family == "nmf" else state[0] @ (state[1] @ (state[2] @ y2)) if family == "rrr" else (state[0] @ state[1]) @ state[0].T
        upper = " AND i <= j" if family == "net" else ""
        losses.append(f"SELECT avg(pow(y.v - h.v, 2)) AS loss FROM {y.name} y JOIN {hat.name} h USING (i, j) JOIN {fold.name} f USING (i, j) WHERE f.v = {f}{upper}")
    return p.select(f"SELECT 2::INT AS rank, round(avg(loss), 6) AS loss, round(sqrt(avg(loss)), 6) AS sigma FROM ({' UNION ALL '.join(losses)})")


def _masked_query(family: str) -> None:
    @query(f"ecv_{family}_fixed", lambda: _masked_program(family))
    def run(spark, d):
        y1, y2, *_ = _halves(spark, d)
        y, a = {"nmf": lambda: (_dense_revenue(spark, d)[0], None), "rrr": lambda: (y1, y2), "net": lambda: (_network(spark, d), None)}[family]()
        init = {"nmf": {"init": _start(5, 2)}, "rrr": {"init": _RRR_START}, "net": {"init": _start(25, 2), "c_init": _TRI}}[family]
        return rounded(resample.ecv(spark, y, a, (2,), _FOLDS, family=family, fixed_iterations=2, **init))


for _family in ("nmf", "rrr", "net"):
    _masked_query(_family)


@query("ecv_rrr_grid")
def _(spark, d):
    y1, y2, *_ = _halves(spark, d)
    return rounded(resample.ecv(spark, y1, y2, (1, 2), 3, family="rrr", ranks2=(1, 2), maxit=100))


# ---------------------------------------------------------------- vectors with gaps

_GAPS_SQL = "CASE WHEN vec_id % 5 = 0 THEN NULL WHEN vec_id % 7 = 0 THEN list_transform(embedding::DOUBLE[], lambda e, k: CASE WHEN k = 3 THEN NULL ELSE e END) ELSE embedding::DOUBLE[] END"
_WHOLE_SQL = f"SELECT vec_id, label, x FROM (SELECT vec_id, label, {_GAPS_SQL} AS x FROM embeddings) WHERE x IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL)) = 0"


def _gapped(spark, d):
    x = D.vectors(spark, d)
    holes = F.transform("x", lambda e, k: F.when(k != 2, e))
    return x.select("id", F.when(F.col("id") % 5 != 0, F.when(F.col("id") % 7 == 0, holes).otherwise(F.col("x"))).alias("x"))


@query("nearest_with_gaps", f"WITH x AS MATERIALIZED ({_WHOLE_SQL}) SELECT a.vec_id AS u, round(min(list_distance(a.x, b.x)), 6) AS value FROM x a JOIN x b ON a.vec_id <> b.vec_id GROUP BY a.vec_id")
def _(spark, d):
    return rounded(prep.nearest(_gapped(spark, d)))


@query("silhouette_with_gaps", f"""WITH x AS MATERIALIZED ({_WHOLE_SQL}), d AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label AS li, b.label AS lj, list_distance(a.x, b.x) AS d FROM x a JOIN x b ON a.vec_id <> b.vec_id),
m AS (SELECT i, li, lj, avg(d) AS m FROM d GROUP BY ALL), s AS (SELECT i, min(CASE WHEN li = lj THEN m END) AS a, min(CASE WHEN li <> lj THEN m END) AS b FROM m GROUP BY i)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""")
def _(spark, d):
    labels = D.table(spark, d, "embeddings", "vec_id", "label").withColumnRenamed("vec_id", "id")
    return rounded(criteria.silhouette(_gapped(spark, d), labels))
