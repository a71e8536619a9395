"""Queries of fits that never leave the executors: a pass an iteration over sample blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sqlmath import Program
from ..operators import steps
from ..operators.fit import nmf
from . import datasets as D
from .queries import ITERATIONS, SQL, _cells_of, _core_sql, _fit_sql, _start, query, rounded

_OPTIONS = {"init": _start(5, 2), "fixed_iterations": ITERATIONS, "dense_cells": 0}


def _cells(spark, d, weighted: bool = False):
    """The revenue of every segment in every nation, with weights by place."""
    segments = D.table(spark, d, "customer", "c_mktsegment").distinct().select(F.col("c_mktsegment").alias("row"))
    nations = D.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("col"))
    y = segments.crossJoin(nations).join(D.revenue(spark, d), ["row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))  # 5 x 25
    if not weighted:
        return y
    place = {r[0]: k for k, r in enumerate(segments.orderBy("row").collect())}
    i, j = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])[F.col("row")], F.col("col")
    return y.withColumn("weight", F.when((i + 2 * j) % 3 == 0, 0.5).when((i + j) % 7 == 0, 0.0).otherwise(1.0))


def _with_covariates(name: str, kind: str, method: str) -> None:
    @query(name, SQL[kind])
    def run(spark, d):
        fit = nmf(_cells(spark, d), D.regions(spark, d), 2, method=method, **_OPTIONS)
        return _cells_of(spark, {"X": fit.x, "C": fit.c})


_with_covariates("blocks_kl_cov", "nmf_kl_cov_fixed", "KL")


def _weighted_cov_sql() -> str:
    p = Program()
    y, a = p.source(D.REVENUE, (5, 25)), p.source(D.REGIONS, (5, 25))
    w = y.map("CASE WHEN (i + 2 * j) % 3 = 0 THEN 0.5 WHEN (i + j) % 7 = 0 THEN 0.0 ELSE 1.0 END")
    x, c = p.const(_start(5, 2)), p.source("SELECT i, j, 1.0::DOUBLE AS v FROM range(2) AS a(i), range(5) AS b(j)", (2, 5))
    for _ in range(ITERATIONS):
        x, c = steps.core_weighted(p, x, c, y, w, a)
    return _fit_sql(p, {"X": (x, None, "X"), "C": (c, "X", None)}, {"X": (x, False)})


@query("blocks_weighted_cov", _weighted_cov_sql)
def _(spark, d):
    fit = nmf(_cells(spark, d, True), D.regions(spark, d), 2, **_OPTIONS)
    return _cells_of(spark, {"X": fit.x, "C": fit.c})


def _free_sql(kind: str) -> str:
    p, x, c, _, _ = _core_sql(kind)
    order = p.add(f"SELECT k AS i, 0::BIGINT AS j, row_number() OVER (ORDER BY c, k) - 1 AS v FROM (SELECT j AS k, sum((i + 1) * v) / 5 AS c FROM {x.name} GROUP BY j)", (2, 1)).name
    return p.select(f"SELECT m.j AS col, o.v::INT AS basis, round(m.v, 6) AS value FROM {c.name} m JOIN {order} o ON o.i = m.i")


def _free(name: str, kind: str, method: str, weighted: bool) -> None:
    @query(name, lambda: _free_sql(kind))
    def run(spark, d):
        fit = nmf(_cells(spark, d, weighted), None, 2, method=method, **_OPTIONS)
        return rounded(fit.extra["b"].select("col", F.posexplode("b").alias("basis", "value")))


_free("blocks_eu", "free", "EU", False)
_free("blocks_kl", "kl", "KL", False)
_free("blocks_weighted", "weighted", "EU", True)
