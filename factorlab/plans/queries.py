"""The registered queries: what each computes in Spark, and the same as SQL where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sqlmath import Matrix, Program
from ..operators import algebra, criteria, describe, infer, mixed, predict, prep, resample, steps
from ..operators import series as ts
from ..operators.fit import Fit, initial_basis, nmf, nmf_ffb, nmf_net, nmf_rrr, nmf_signed
from ..sources import cells as C
from . import datasets as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ITERATIONS = 5


def query(name: str, sql: str | Callable[[], str] | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql() if callable(sql) else sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_pairs(df: DataFrame, digits: int = 6) -> DataFrame:
    """rounded() for kernels of many pairs: halves go away from zero, by arithmetic as in DuckDB. Spark's round makes a decimal
    from the text of each value, which takes longer than the kernel and its files."""

    def near(c: Column) -> Column:
        scaled = c * F.lit(10.0**digits)
        even = F.rint(scaled)
        whole = F.when(F.abs(scaled - even) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(even)
        return F.when(F.abs(scaled) < math.inf, (whole + F.lit(0.0)) / F.lit(10.0**digits)).otherwise(c)

    return df.select(*[near(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---------------------------------------------------------------- matrices and preparation


@query("matrix_cells", f"SELECT row, col, round(value, 6) AS value FROM ({D.REVENUE_CELLS})")
def _(spark, d):
    return rounded(D.revenue(spark, d))


_MINMAX = f"SELECT row, col, (value - low) / CASE WHEN high = low THEN 1 ELSE high - low END AS value, low, high FROM ({D.QUANTITY_CELLS}) JOIN (SELECT col, min(value) AS low, max(value) AS high FROM ({D.QUANTITY_CELLS}) GROUP BY col) USING (col)"


@query("matrix_minmax", f"SELECT row, col, round(value, 6) AS value FROM ({_MINMAX})")
def _(spark, d):
    return rounded(prep.minmax(D.quantity(spark, d)))


@query("matrix_denorm", f"SELECT row, col, round(value * (high - low) + low, 6) AS value FROM ({_MINMAX})")
def _(spark, d):
    y = D.quantity(spark, d)
    return rounded(prep.denormalize(prep.minmax(y), y))


@query("one_hot", "SELECT l.l AS row, vec_id AS col, CASE WHEN label::VARCHAR = l.l THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM embeddings CROSS JOIN (SELECT DISTINCT label::VARCHAR AS l FROM embeddings) l")
def _(spark, d):
    return C.one_hot(D.table(spark, d, "embeddings", "vec_id", "label"), "vec_id", "label")


_FORMULA_SQL = """SELECT side, row, col, round(sum(value), 6) AS value FROM (
  SELECT 'Y' AS side, 'l_quantity' AS row, l_orderkey * 10 + l_linenumber AS col, l_quantity AS value FROM lineitem
  UNION ALL SELECT 'A', 'l_extendedprice', l_orderkey * 10 + l_linenumber, l_extendedprice FROM lineitem
  UNION ALL SELECT 'A', 'l_discount', l_orderkey * 10 + l_linenumber, l_discount FROM lineitem
  UNION ALL SELECT 'A', 'l_tax', l_orderkey * 10 + l_linenumber, l_tax FROM lineitem) GROUP BY side, row, col"""


@query("formula_rest_columns", _FORMULA_SQL)
def _(spark, d):
    li = D.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    y, a = C.from_formula(li, "l_quantity ~ .", "key")
    both = y.select(F.lit("Y").alias("side"), "row", "col", "value").union(a.select(F.lit("A").alias("side"), "row", "col", "value"))
    return rounded(both.groupBy("side", "row", "col").agg(F.sum("value").alias("value")))


@query("edges_symmetric", f"SELECT row, col, round(value, 6) AS value FROM ({D.TRADE_CELLS})")
def _(spark, d):
    return rounded(D.trade(spark, d))


@query("series_grid", f"SELECT t, var, round(value, 6) AS value FROM ({D.SERIES})")
def _(spark, d):
    return rounded(D.series(spark, d))


_LAGS = f"s AS ({D.SERIES})"


@query("lag_design", f"""WITH {_LAGS}, lagged AS (SELECT t, var, d, lag(value, d) OVER (PARTITION BY var, d ORDER BY t) AS x FROM s CROSS JOIN (VALUES (1), (2)) AS k(d))
SELECT row, col, round(value, 6) AS value FROM (SELECT var || '_' || d AS row, t AS col, x AS value FROM lagged WHERE t >= 2 UNION ALL SELECT DISTINCT '(Intercept)', t, 1.0::DOUBLE FROM s WHERE t >= 2)""".replace("lag(value, d) OVER (PARTITION BY var, d ORDER BY t)", "CASE d WHEN 1 THEN lag(value, 1) OVER (PARTITION BY var, d ORDER BY t) ELSE lag(value, 2) OVER (PARTITION BY var, d ORDER BY t) END"))
def _(spark, d):
    return rounded(prep.lag_design(D.series(spark, d), 2)[1])


@query("degree_max", f"SELECT n, least(n, floor(10 * log10(n)))::BIGINT AS degree FROM (SELECT count(DISTINCT t)::BIGINT AS n FROM ({D.SERIES}))")
def _(spark, d):
    n = D.series(spark, d).select("t").distinct().count()  # one number
    return spark.createDataFrame([(n, prep.degree_max(n))], "n bigint, degree bigint")


_KERNEL_SQL = {
    "gaussian": "exp(-0.05 * pow(list_distance(a.x, b.x), 2))", "exponential": "exp(-0.5 * list_distance(a.x, b.x))", "periodic": "exp(-pow(sin(list_distance(a.x, b.x)), 2))",
    "linear": "list_inner_product(a.x, b.x)", "normalized_linear": "list_inner_product(a.x, b.x) / (greatest(sqrt(list_inner_product(a.x, a.x)), 2.220446049250313e-16) * greatest(sqrt(list_inner_product(b.x, b.x)), 2.220446049250313e-16))",
    "polynomial": "pow(list_inner_product(a.x, b.x), 2.0)",
}
_X = "(SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)"


def _kernel(kind: str) -> None:
    @query(f"kernel_{kind}", f"SELECT a.vec_id AS u, b.vec_id AS v, round(greatest({_KERNEL_SQL[kind]}, 0.0), 6) AS value FROM {_X} a CROSS JOIN {_X} b")
    def run(spark, d):
        x = D.vectors(spark, d)
        beta = {"gaussian": 0.05, "exponential": 0.5, "periodic": (1.0, 1.0), "polynomial": 0.0}.get(kind, 0.5)
        return rounded_pairs(prep.kernel(x, x, kind, beta))


for _kind in prep.KERNELS:
    _kernel(_kind)


_HOLES = "list_transform(embedding::DOUBLE[], lambda e, k: CASE WHEN (vec_id + k) % 7 = 0 THEN NULL ELSE e END)"


@query("kernel_gaussian_partial", f"""SELECT u, v, round(CASE WHEN seen = 0 THEN 0.0 ELSE exp(-0.05 * 64.0 / greatest(seen, 1) * d2) END, 6) AS value FROM (
SELECT a.vec_id AS u, b.vec_id AS v, len(list_filter(b.x, lambda e: e IS NOT NULL)) AS seen, pow(list_distance(a.x, list_transform(b.x, lambda e, k: coalesce(e, a.x[k]))), 2) AS d2
FROM {_X} a CROSS JOIN (SELECT vec_id, {_HOLES} AS x FROM embeddings) b)""")
def _(spark, d):
    x = D.vectors(spark, d)
    holes = x.select("id", F.transform("x", lambda e, k: F.when((F.col("id") + k + 1) % 7 != 0, e)).alias("x"))
    return rounded_pairs(prep.kernel_partial(x, holes, 0.05))


_NEAREST = f"SELECT a.vec_id AS u, min(list_distance(a.x, b.x)) AS value FROM {_X} a JOIN {_X} b ON a.vec_id <> b.vec_id GROUP BY a.vec_id"
_LANDMARKS = f"SELECT a.vec_id AS u, min(list_distance(a.x, b.x)) AS value FROM {_X} a JOIN (SELECT e.vec_id, e.embedding::DOUBLE[] AS x FROM embeddings e JOIN (SELECT min(vec_id) AS vec_id FROM embeddings GROUP BY label) USING (vec_id)) b ON a.vec_id <> b.vec_id GROUP BY a.vec_id"
_GRID = "SELECT k::INT AS k, round(pow(10.0, -2 * t) / (2 * d * d), 6) AS beta FROM (SELECT quantile_cont(value, 0.5) AS d FROM ({near})), (VALUES {steps}) AS g(k, t)"
_WIDE = "(0, -1.0::DOUBLE), (1, -2.0::DOUBLE / 3), (2, -1.0::DOUBLE / 3), (3, 0.0::DOUBLE), (4, 1.0::DOUBLE / 3), (5, 2.0::DOUBLE / 3), (6, 1.0::DOUBLE)"


@query("nearest_distance", f"SELECT u, round(value, 6) AS value FROM ({_NEAREST})")
def _(spark, d):
    return rounded(prep.nearest(D.vectors(spark, d)))


@query("bandwidth_grid", _GRID.format(near=_NEAREST, steps=_WIDE))
def _(spark, d):
    return rounded(prep.bandwidth(D.vectors(spark, d)))


@query("bandwidth_landmarks", _GRID.format(near=_LANDMARKS, steps="(0, -0.5::DOUBLE), (1, 0.0::DOUBLE), (2, 0.5::DOUBLE), (3, 1.0::DOUBLE)"))
def _(spark, d):
    x = D.vectors(spark, d)
    first = D.table(spark, d, "embeddings", "vec_id", "label").groupBy("label").agg(F.min("vec_id").alias("id")).select("id")
    return rounded(prep.bandwidth(x, x.join(first, "id"), "narrow"))


_OMEGA = [[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(64)] for i in range(8)]
_PHASE = [i * 0.7 for i in range(8)]


def _rff_sql() -> str:
    omega = ", ".join(f"({i}, {row!r}::DOUBLE[], {_PHASE[i]!r}::DOUBLE)" for i, row in enumerate(_OMEGA))
    return f"SELECT vec_id AS id, o.k::INT AS k, round(sqrt(2.0 / 8) * cos(list_inner_product(o.w, x) + o.b), 6) AS value FROM {_X} CROSS JOIN (VALUES {omega}) AS o(k, w, b)"


@query("rff_features", _rff_sql)
def _(spark, d):
    z = prep.random_features(D.vectors(spark, d), np.array(_OMEGA), np.array(_PHASE))
    return rounded(z.select("id", F.posexplode("z").alias("k", "value")))


def _samples(spark, d):
    y, a = D.revenue(spark, d), D.regions(spark, d)
    rows = [r[0] for r in D.table(spark, d, "customer", "c_mktsegment").distinct().orderBy("c_mktsegment").collect()]
    covariates = [f"r{r[0]}" for r in D.table(spark, d, "region", "r_regionkey").orderBy("r_regionkey").collect()]
    return C.samples(y, rows, "y").join(C.samples(a, covariates, "a"), "col")


@query("gram_ya", f"SELECT y.i, a.i AS j, round(sum(y.v * a.v), 6) AS value FROM ({D.REVENUE}) y JOIN ({D.REGIONS}) a USING (j) GROUP BY y.i, a.i")
def _(spark, d):
    return rounded(algebra.gram(_samples(spark, d), "y", "a"))


@query("gram_embeddings", f"SELECT i, j, round(sum(x[i + 1] * x[j + 1]), 6) AS value FROM {_X}, range(64) AS p(i), range(64) AS q(j) GROUP BY i, j")
def _(spark, d):
    return rounded(algebra.gram(D.vectors(spark, d), "x", "x"))


@query("matrix_product", f"SELECT y.row, a.i AS region, round(sum(y.value * a.v), 6) AS value FROM ({D.REVENUE_CELLS}) y JOIN ({D.REGIONS}) a ON y.col = a.j GROUP BY y.row, a.i")
def _(spark, d):
    a = algebra.transposed(D.regions(spark, d))
    return rounded(algebra.matmul(D.revenue(spark, d), a).select("row", F.substring("col", 2, 9).cast("bigint").alias("region"), "value"))


# ---------------------------------------------------------------- fits of a fixed number of iterations


def _cells_of(spark: SparkSession, factors: dict[str, np.ndarray]) -> DataFrame:
    rows = [(name, i, j, float(v)) for name, m in factors.items() for (i, j), v in np.ndenumerate(np.atleast_2d(m))]
    return rounded(spark.createDataFrame(rows, "factor string, i bigint, j bigint, value double"))


def _fit_sql(program: Program, factors: dict[str, tuple[Matrix, str | None, str | None]], orders: dict[str, tuple[Matrix, bool]]) -> str:
    """Cells of the factors with their bases in canonical order. factors: name -> (matrix, order of i, order of j);
    orders: name -> (basis, whether its bases are rows)."""
    parts = []
    names = {}
    for name, (m, by_rows) in orders.items():
        base, place = ("i", "j") if by_rows else ("j", "i")
        size = m.shape[1] if by_rows else m.shape[0]
        names[name] = program.add(f"SELECT k AS i, 0::BIGINT AS j, row_number() OVER (ORDER BY c, k) - 1 AS v FROM (SELECT {base} AS k, sum(({place} + 1) * v) / {size} AS c FROM {m.name} GROUP BY {base})", (m.shape[0] if by_rows else m.shape[1], 1)).name
    for name, (m, oi, oj) in factors.items():
        joins = (f" JOIN {names[oi]} oi ON oi.i = m.i" if oi else "") + (f" JOIN {names[oj]} oj ON oj.i = m.j" if oj else "")
        parts.append(f"SELECT '{name}' AS factor, {'oi.v' if oi else 'm.i'}::BIGINT AS i, {'oj.v' if oj else 'm.j'}::BIGINT AS j, round(m.v, 6) AS value FROM {m.name} m{joins}")
    return program.select(" UNION ALL ".join(parts))


def _start(p: int, q: int) -> np.ndarray:
    return initial_basis(np.zeros((p, 1)), q, "deterministic")


def _core_sql(kind: str, n: int = ITERATIONS, factors: bool = True, **options):
    """The program of a fixed core fit on revenue (segment x nation), and its X and C."""
    p = Program()
    y, a = p.source(D.REVENUE, (5, 25)), p.source(D.REGIONS, (5, 25))
    x = p.const(_start(5, 2))
    covariates = kind in ("cov", "kl_cov")
    c = p.const(np.ones((2, 5 if covariates else 25)))
    if kind == "cov":
        s_ya, s_aa = y @ a.T, a @ a.T
    if kind == "weighted":
        w = y.map("CASE WHEN (i + 2 * j) % 3 = 0 THEN 0.5 WHEN (i + j) % 7 = 0 THEN 0.0 ELSE 1.0 END")
    for _ in range(n):
        if kind == "cov":
            x, c = steps.core_eu(p, x, c, s_ya, s_aa, **options)
        elif kind == "weighted":
            x, c = steps.core_weighted(p, x, c, y, w, None, **options)
        elif kind in ("kl", "kl_cov"):
            x, c = steps.core_kl(p, x, c, y, a if covariates else None, **options)
        else:
            x, c = steps.core_free(p, x, c, y, **options)
    return p, x, c, y, a


def _fixed(name: str, kind: str, sql_options: dict | None = None, **options) -> None:
    sql_options = sql_options or {}

    def sql() -> str:
        p, x, c, _, _ = _core_sql(kind, **sql_options)
        ordered = None if sql_options.get("how") == "fixed" else "X"
        return _fit_sql(p, {"X": (x, None, ordered), "C": (c, ordered, None)}, {"X": (x, False)})

    @query(name, sql)
    def run(spark, d):
        fit = revenue_fit(spark, d, kind, **options)
        return _cells_of(spark, {"X": fit.x, "C": fit.c})


def revenue_fit(spark: SparkSession, d: str, kind: str = "free", **options) -> Fit:
    y = D.revenue(spark, d)
    start = {"init": _start(5, 2), "fixed_iterations": ITERATIONS, "rank": 2} | options
    if kind == "cov":
        return nmf(y, D.regions(spark, d), **start)
    cols = [r[0] for r in D.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint")).orderBy("n_nationkey").collect()]
    dense, rows, _ = C.to_numpy(y, cols=cols)
    a = C.to_numpy(D.regions(spark, d), cols=cols)[0] if kind == "kl_cov" else None
    if kind == "weighted":
        i, j = np.indices(dense.shape)
        start["weights"] = np.where((i + 2 * j) % 3 == 0, 0.5, np.where((i + j) % 7 == 0, 0.0, 1.0))
    from dataclasses import replace

    fit = nmf(dense, a, method="KL" if kind.startswith("kl") else "EU", **start)
    return replace(fit, rows=rows, cols=cols)


_fixed("nmf_eu_fixed", "free")
_fixed("nmf_eu_cov_fixed", "cov")
_fixed("nmf_kl_fixed", "kl")
_fixed("nmf_kl_cov_fixed", "kl_cov")
_fixed("nmf_weighted_fixed", "weighted")
_fixed("nmf_l1_fixed", "cov", {"l1": 0.5}, c_l1=0.5)
_fixed("nmf_ortho_fixed", "cov", {"l2_ortho": 3.0}, l2_ortho=3.0)
_fixed("nmf_smooth_fixed", "cov", {"l2_smooth": 2.0}, l2_smooth=2.0)
_fixed("nmf_restriction_colsqsums", "cov", {"how": "colSqSums"}, restriction="colSqSums")
_fixed("nmf_restriction_totalsum", "cov", {"how": "totalSum"}, restriction="totalSum")
_fixed("nmf_restriction_none", "cov", {"how": "none"}, restriction="none")
_fixed("nmf_restriction_fixed", "cov", {"how": "fixed"}, restriction="fixed")

_BOTH = f"y1 AS (SELECT i, j, v FROM ({D.REVENUE}) WHERE i < 3), y2 AS (SELECT i - 3 AS i, j, v FROM ({D.REVENUE}) WHERE i >= 3)"


def _small(shape, a=3, b=5) -> np.ndarray:
    i, j = np.indices(shape)
    return 0.1 + ((i * a + j * b) % 7) / 10


def _rrr_sql(signed: bool) -> str:
    p = Program(_BOTH)
    y1 = p.source("SELECT * FROM y1", (3, 25))
    y2 = p.source("SELECT * FROM y2", (2, 25))
    if signed:
        y1 = y1 - p.sum(y1, 1) / 25
    s12, s22 = y1 @ y2.T, y2 @ y2.T
    x1, x2 = p.const(_start(3, 2)), p.const(_small((2, 2)))
    if signed:
        cp, cn = p.const(_small((2, 2), 2, 3)), p.const(_small((2, 2), 1, 4))
        for _ in range(3):
            x1, cp, cn, x2 = steps.signed_reduced_rank(p, x1, cp, cn, x2, s12, s22)
        c = cp - cn
    else:
        c = p.const(_small((2, 2), 2, 3))
        for _ in range(ITERATIONS):
            x1, c, x2 = steps.reduced_rank(p, x1, c, x2, s12, s22)
    return _fit_sql(p, {"X1": (x1, None, "o1"), "C": (c, "o1", "o2"), "X2": (x2, "o2", None)}, {"o1": (x1, False), "o2": (x2, True)})


def _halves(spark, d):
    cols = [r[0] for r in D.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint")).orderBy("n_nationkey").collect()]
    y, rows, _ = C.to_numpy(D.revenue(spark, d), cols=cols)
    return y[:3], y[3:], rows[:3], rows[3:]


@query("rrr_fixed", lambda: _rrr_sql(False))
def _(spark, d):
    y1, y2, *_ = _halves(spark, d)
    fit = nmf_rrr(y1, y2, 2, init=(_start(3, 2), _small((2, 2), 2, 3), _small((2, 2))), fixed_iterations=ITERATIONS)
    return _cells_of(spark, {"X1": fit.x, "C": fit.c, "X2": fit.extra["x2"]})


@query("signed_rrr_fixed", lambda: _rrr_sql(True))
def _(spark, d):
    y1, y2, *_ = _halves(spark, d)
    y1 = y1 - y1.mean(axis=1, keepdims=True)
    fit = nmf_rrr(y1, y2, 2, signed=True, init=(_start(3, 2), _small((2, 2), 2, 3), _small((2, 2), 1, 4), _small((2, 2))), fixed_iterations=3)
    return _cells_of(spark, {"X1": fit.x, "C": fit.c, "X2": fit.extra["x2"]})


def _signed_sql() -> str:
    p = Program()
    y, a = p.source(D.REVENUE, (5, 25)), p.source(D.REGIONS, (5, 25))
    y, a = y - p.sum(y, 1) / 25, a - p.sum(a, 1) / 25
    s, g0 = a @ a.T, y @ a.T
    x, cp, cn = p.const(_start(5, 2)), p.const(_small((2, 5))), p.const(_small((2, 5), 2, 3))
    sp, sn = p.pos(s), p.pos(-s)
    for _ in range(ITERATIONS):
        x, cp, cn = steps.signed(p, x, cp, cn, g0, sp, sn)
    return _fit_sql(p, {"X": (x, None, "X"), "C": (cp - cn, "X", None)}, {"X": (x, False)})


@query("signed_fixed", _signed_sql)
def _(spark, d):
    y, a = _dense_revenue(spark, d)
    fit = nmf_signed(y - y.mean(axis=1, keepdims=True), a - a.mean(axis=1, keepdims=True), 2, init=_start(5, 2), cp_init=_small((2, 5)), cn_init=_small((2, 5), 2, 3), fixed_iterations=ITERATIONS)
    return _cells_of(spark, {"X": fit.x, "C": fit.c})


def _dense_revenue(spark, d):
    cols = [r[0] for r in D.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint")).orderBy("n_nationkey").collect()]
    return C.to_numpy(D.revenue(spark, d), cols=cols)[0], C.to_numpy(D.regions(spark, d), cols=cols)[0]


def _network(spark, d) -> np.ndarray:
    keys = list(range(25))
    return C.to_numpy(D.trade(spark, d), rows=keys, cols=keys)[0]


def _net_sql(kind: str) -> str:
    p = Program()
    y, x = p.source(D.TRADE, (25, 25)), p.const(_start(25, 2))
    if kind == "bi":
        for _ in range(ITERATIONS):
            x = steps.network_bi(p, x, y)
        return _fit_sql(p, {"X": (x, None, "X")}, {"X": (x, False)})
    if kind == "tri":
        c = p.const(np.ones((2, 2)) + np.eye(2))
        for _ in range(ITERATIONS):
            x, c = steps.network_tri(p, x, c, y)
    else:
        cp, cn = p.const(np.ones((2, 2)) + np.eye(2)), p.const(np.full((2, 2), 0.2))
        for _ in range(3):
            x, cp, cn = steps.network_signed(p, x, cp, cn, y)
        c = cp - cn
    return _fit_sql(p, {"X": (x, None, "X"), "C": (c, "X", "X")}, {"X": (x, False)})


def _net(kind: str) -> None:
    @query(f"net_{kind}_fixed", lambda: _net_sql(kind))
    def run(spark, d):
        start = np.ones((2, 2)) + np.eye(2)
        fit = nmf_net(_network(spark, d), 2, kind, init=_start(25, 2), c_init=start, cn_init=np.full((2, 2), 0.2), fixed_iterations=3 if kind == "signed" else ITERATIONS)
        return _cells_of(spark, {"X": fit.x} | ({} if kind == "bi" else {"C": fit.c}))


for _kind in ("tri", "bi", "signed"):
    _net(_kind)


def _ffb_sql() -> str:
    p = Program(_BOTH)
    y1, y2 = p.source("SELECT * FROM y1", (3, 25)), p.source("SELECT * FROM y2", (2, 25))
    s11, s12, s22 = y1 @ y1.T, y1 @ y2.T, y2 @ y2.T
    start = _start(3, 2)
    x, c1, c2 = p.const(start / start.sum(axis=0)), p.const(_small((2, 3)) / 10), p.const(_small((2, 2), 2, 3))
    for _ in range(ITERATIONS):
        x, c1, c2 = steps.feedback(p, x, c1, c2, s11, s12, s22, 1.0, 1.0, 0.1)
    return _fit_sql(p, {"X": (x, None, "X"), "C1": (c1, "X", None), "C2": (c2, "X", None)}, {"X": (x, False)})


@query("ffb_fixed", _ffb_sql)
def _(spark, d):
    y1, y2, *_ = _halves(spark, d)
    fit = nmf_ffb(y1, y2, 2, init=_start(3, 2), c1_init=_small((2, 3)) / 10, c2_init=_small((2, 2), 2, 3), l2_ortho=1.0, fixed_iterations=ITERATIONS)
    return _cells_of(spark, {"X": fit.x, "C1": fit.c, "C2": fit.extra["c2"]})


# ---------------------------------------------------------------- memberships, criteria, prediction


def _ordered_sql(tail: str, kind: str = "free") -> str:
    """A statement over x(i, q, v), b(q, j, v), y and yhat of the fixed fit, bases in canonical order."""
    p, x, c, y, a = _core_sql(kind)
    b = c if kind == "free" else c @ a
    hat = x @ b
    order = f"o AS (SELECT k, row_number() OVER (ORDER BY c, k) - 1 AS q FROM (SELECT j AS k, sum((i + 1) * v) / 5 AS c FROM {x.name} GROUP BY j))"
    views = f", {order}, x AS (SELECT m.i, o.q, m.v FROM {x.name} m JOIN o ON o.k = m.j), b AS (SELECT o.q, m.j, m.v FROM {b.name} m JOIN o ON o.k = m.i), y AS (SELECT * FROM {y.name}), hat AS (SELECT * FROM {hat.name}), s AS (SELECT seg, i FROM {D.SEGMENTS})"
    return f"WITH {', '.join(p.steps)}{views} {tail}"


def _factors(spark, d, kind="free"):
    """(y, B, X, fitted) cells of the fixed fit, with bases counted from 0."""
    fit = revenue_fit(spark, d, kind)
    bases = list(range(fit.rank))
    x, b = C.to_cells(spark, fit.x, fit.rows, bases), C.to_cells(spark, fit.c, bases, fit.cols)
    dense = C.to_cells(spark, np.zeros((len(fit.rows), len(fit.cols))), fit.rows, fit.cols).select("row", "col")
    y = dense.join(D.revenue(spark, d), ["row", "col"], "left").select("row", "col", F.coalesce("value", F.lit(0.0)).alias("value"))
    return y, b, x, algebra.matmul(x, b)


@query("membership_prob", _ordered_sql("SELECT q AS row, j AS col, round(v / (sum(v) OVER (PARTITION BY j) + 1e-10), 6) AS value FROM b"))
def _(spark, d):
    return rounded(criteria.membership(_factors(spark, d)[1]))


@query("row_membership", _ordered_sql("SELECT seg AS row, q AS col, round(v / (sum(v) OVER (PARTITION BY i) + 1e-10), 6) AS value FROM x JOIN s USING (i)"))
def _(spark, d):
    return rounded(criteria.membership(_factors(spark, d)[2], "row"))


@query("cluster_argmax", _ordered_sql("SELECT j AS col, q AS label, round(v, 6) AS value FROM b QUALIFY row_number() OVER (PARTITION BY j ORDER BY v DESC, q) = 1"))
def _(spark, d):
    return rounded(criteria.hard_labels(_factors(spark, d)[1]))


@query("centroid_order", _ordered_sql("SELECT q AS col, round(sum((i + 1) * v) / 5, 6) AS centroid, row_number() OVER (ORDER BY sum((i + 1) * v), q)::BIGINT AS position FROM x GROUP BY q"))
def _(spark, d):
    x = _factors(spark, d)[2]
    numbered = x.withColumn("row", F.dense_rank().over(Window.orderBy("row")))  # a basis: features times rank
    return rounded(criteria.centroid_ranks(numbered, 5).withColumn("position", F.col("position").cast("bigint")))


_FIT_SUMS = "SELECT count(*) AS n, sum(y.v) AS sx, sum(h.v) AS sy, sum(y.v * y.v) AS sxx, sum(h.v * h.v) AS syy, sum(y.v * h.v) AS sxy, sum(pow(y.v - h.v, 2)) AS sse, sum(pow(y.v - m.m, 2)) AS ssm FROM y JOIN hat h USING (i, j) JOIN (SELECT i, avg(v) AS m FROM y GROUP BY i) m USING (i)"


@query("fit_r2s", _ordered_sql(f"SELECT round(pow(n * sxy - sx * sy, 2) / ((n * sxx - sx * sx) * (n * syy - sy * sy)), 6) AS r2_cor, round(1 - sse / sxx, 6) AS r2_zero, round(1 - sse / ssm, 6) AS r2_mean FROM ({_FIT_SUMS})"))
def _(spark, d):
    y, _, _, hat = _factors(spark, d)
    return rounded(criteria.r_squared(y, hat))


@query("fit_sigma_mae", _ordered_sql("SELECT round(stddev_samp(y.v - h.v), 6) AS sigma, round(avg(abs(y.v - h.v)), 6) AS mae FROM y JOIN hat h USING (i, j)"))
def _(spark, d):
    y, _, _, hat = _factors(spark, d)
    return rounded(criteria.sigma_mae(y, hat))


@query("effective_rank", _ordered_sql("""SELECT round(er, 6) AS effective_rank, round(least(1.0, greatest(0.0, (er - exp(0.5)) / (2 - exp(0.5)))), 6) AS effective_rank_index
FROM (SELECT exp(-sum(p * ln(p))) AS er FROM (SELECT var / sum(var) OVER () AS p FROM (SELECT q, var_samp(v) AS var FROM b GROUP BY q)))"""))
def _(spark, d):
    return rounded(criteria.effective_rank(_factors(spark, d)[1]))


@query("fit_criterion", f"SELECT r2_cor, r2_zero, r2_mean, sigma, mae, effective_rank, effective_rank_index FROM ({SQL['fit_r2s']}), ({SQL['fit_sigma_mae']}), ({SQL['effective_rank']})")
def _(spark, d):
    y, b, _, hat = _factors(spark, d)
    return rounded(criteria.criterion(y, hat, b, detail="fast"))


@query("coef_shown", _ordered_sql("SELECT * FROM (SELECT seg AS covariate, q::BIGINT AS basis, round(v, 6) AS p_value, row_number() OVER (ORDER BY q DESC, seg) AS position FROM x JOIN s USING (i)) WHERE p_value < 0.2 ORDER BY position LIMIT 5"))
def _(spark, d):
    x = _factors(spark, d)[2]
    table = x.select(F.col("row").alias("covariate"), F.col("col").cast("bigint").alias("basis"), F.round("value", 6).alias("p_value"))
    return describe.shown_coefficients(describe.ordered_coefficients(table, "basis", ["2", "1"]), 5, 0.2)


@query("sparsity", _ordered_sql("SELECT round(avg(CASE WHEN v < 1e-4 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS sparsity FROM x"))
def _(spark, d):
    return rounded(criteria.sparsity(_factors(spark, d)[2]))


@query("residual_cells", _ordered_sql("SELECT seg AS row, j AS col, round(y.v - h.v, 6) AS value FROM y JOIN hat h USING (i, j) JOIN s USING (i)"))
def _(spark, d):
    y, _, _, hat = _factors(spark, d)
    return rounded(criteria.residuals(y, hat))


@query("heatmap_cells", _ordered_sql("SELECT 'Y' AS panel, seg AS row, j::VARCHAR AS col, round(v, 6) AS value FROM y JOIN s USING (i) UNION ALL SELECT 'XB', seg, j::VARCHAR, round(v, 6) FROM hat JOIN s USING (i)"))
def _(spark, d):
    y, _, _, hat = _factors(spark, d)
    return rounded(describe.heatmap({"Y": y, "XB": hat}))


@query("dot_edges", _ordered_sql("SELECT seg AS row, q AS col, round(v, 6) AS value FROM x JOIN s USING (i) WHERE v >= 0.1"))
def _(spark, d):
    return rounded(describe.edges(_factors(spark, d)[2], 0.1))


_PROB = "p AS (SELECT q, j, v / (sum(v) OVER (PARTITION BY j) + 1e-10) AS v FROM b), xp AS (SELECT x.i, p.j, sum(x.v * p.v) AS v FROM x JOIN p USING (q) GROUP BY x.i, p.j)"


def _with(sql: str, more: str) -> str:
    """more as further common table expressions at the end of _ordered_sql's list."""
    head, tail = sql.split(", s AS (", 1)
    inner, rest = tail.split(") SELECT", 1) if ") SELECT" in tail else (tail, "")
    depth, k = 1, 0
    while depth:
        depth += {"(": 1, ")": -1}.get(tail[k], 0)
        k += 1
    return f"{head}, s AS ({tail[:k]}, {more} {tail[k:]}"


def _predicted(spark, d, kind):
    fit = revenue_fit(spark, d, "cov")
    return predict.predict(fit, D.regions(spark, d), kind)


@query("predict_response", _ordered_sql("SELECT seg AS row, j AS col, round(v, 6) AS value FROM hat JOIN s USING (i)", "cov"))
def _(spark, d):
    return rounded(_predicted(spark, d, "response"))


@query("predict_prob", _with(_ordered_sql("SELECT seg AS row, j AS col, round(v, 6) AS value FROM xp JOIN s USING (i)", "cov"), _PROB))
def _(spark, d):
    return rounded(_predicted(spark, d, "prob"))


@query("predict_class", _with(_ordered_sql("SELECT j AS col, seg AS label, round(v, 6) AS value FROM xp JOIN s USING (i) QUALIFY row_number() OVER (PARTITION BY j ORDER BY v DESC, seg) = 1", "cov"), _PROB))
def _(spark, d):
    return rounded(_predicted(spark, d, "class"))


_CONFUSION = "(SELECT k.actual, p.predicted, count(*)::BIGINT AS n FROM (SELECT seg AS predicted, j FROM xp JOIN s USING (i) QUALIFY row_number() OVER (PARTITION BY j ORDER BY v DESC, seg) = 1) p JOIN (SELECT seg AS actual, j FROM y JOIN s USING (i) QUALIFY row_number() OVER (PARTITION BY j ORDER BY v DESC, seg) = 1) k USING (j) GROUP BY ALL)"


def _confused(spark, d):
    zero = C.to_cells(spark, np.zeros((5, 25)), C.row_labels(D.revenue(spark, d)), list(range(25))).select("row", "col")
    y = zero.join(D.revenue(spark, d), ["row", "col"], "left").select("row", "col", F.coalesce("value", F.lit(0.0)).alias("value"))
    return predict.confusion(_predicted(spark, d, "class"), criteria.hard_labels(y))


@query("confusion", _with(_ordered_sql(f"SELECT * FROM {_CONFUSION}", "cov"), _PROB))
def _(spark, d):
    return _confused(spark, d)


@query("accuracy", _with(_ordered_sql(f"SELECT round(sum(CASE WHEN actual = predicted THEN n ELSE 0 END) / sum(n), 6)::DOUBLE AS accuracy FROM {_CONFUSION}", "cov"), _PROB))
def _(spark, d):
    return rounded(predict.accuracy(_confused(spark, d)))


_DIST = f"SELECT a.vec_id AS i, b.vec_id AS j, a.label AS li, b.label AS lj, list_distance(a.x, b.x) AS d FROM (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings) a JOIN (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings) b ON a.vec_id <> b.vec_id"


@query("silhouette", f"""WITH m AS (SELECT i, li, lj, avg(d) AS m FROM ({_DIST}) GROUP BY ALL), s AS (SELECT i, min(CASE WHEN li = lj THEN m END) AS a, min(CASE WHEN li <> lj THEN m END) AS b FROM m GROUP BY i)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""")
def _(spark, d):
    labels = D.table(spark, d, "embeddings", "vec_id", "label").withColumnRenamed("vec_id", "id")
    return rounded(criteria.silhouette(D.vectors(spark, d), labels))


@query("dist_cor", f"SELECT round(corr(list_distance(a.x, b.x), list_distance(a.x[1:16], b.x[1:16])), 6) AS dist_cor FROM {_X} a JOIN {_X} b ON a.vec_id < b.vec_id")
def _(spark, d):
    x = D.vectors(spark, d)
    return rounded(criteria.distance_correlation(x, x.select("id", F.slice("x", 1, 16).alias("x"))))


# labels of four "fits": customers by segment, by nation, by region-like groups and by balance quarter
_LABELS = "SELECT c_custkey AS id, f::INT AS fit, CASE f WHEN 0 THEN ascii(c_mktsegment) % 5 WHEN 1 THEN c_nationkey % 5 WHEN 2 THEN c_nationkey % 3 ELSE (c_custkey * 7) % 4 END::BIGINT AS label FROM customer, range(4) AS t(f)"


def _label_table(spark, d):
    c = D.table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    label = F.when(F.col("fit") == 0, F.ascii("c_mktsegment") % 5).when(F.col("fit") == 1, F.col("c_nationkey") % 5).when(F.col("fit") == 2, F.col("c_nationkey") % 3).otherwise((F.col("c_custkey") * 7) % 4)
    return c.withColumn("fit", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(F.col("c_custkey").alias("id"), "fit", label.cast("bigint").alias("label"))


@query("ari_adjacent", f"""WITH l AS ({_LABELS}), p AS (SELECT a.fit, a.label AS a, b.label AS b, count(*) AS n FROM l a JOIN l b ON a.id = b.id AND b.fit = a.fit + 1 GROUP BY ALL),
t AS (SELECT fit, sum(n * (n - 1) / 2) AS pairs, sum(n) AS total FROM p GROUP BY fit), sa AS (SELECT fit, sum(m * (m - 1) / 2) AS sa FROM (SELECT fit, a, sum(n) AS m FROM p GROUP BY ALL) GROUP BY fit), sb AS (SELECT fit, sum(m * (m - 1) / 2) AS sb FROM (SELECT fit, b, sum(n) AS m FROM p GROUP BY ALL) GROUP BY fit)
SELECT fit, round((pairs - sa * sb / (total * (total - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (total * (total - 1) / 2)), 6) AS ari FROM t JOIN sa USING (fit) JOIN sb USING (fit)""")
def _(spark, d):
    return rounded(criteria.adjacent_ari(_label_table(spark, d)))


@query("cluster_flow", f"""WITH l AS ({_LABELS}), k AS (SELECT id, row_number() OVER (ORDER BY label, id) AS key FROM l WHERE fit = 2),
c AS (SELECT fit, l.id, label, key, avg(key) OVER (PARTITION BY fit, label) AS centre FROM l JOIN k USING (id)),
o AS (SELECT *, dense_rank() OVER (PARTITION BY fit ORDER BY centre, label) AS block, row_number() OVER (PARTITION BY fit ORDER BY centre, label, key) AS r FROM c)
SELECT fit, id, label, round(r + (block - 1) * (SELECT count(*) FROM k) / max(block) OVER (PARTITION BY fit), 6)::DOUBLE AS position FROM o""")
def _(spark, d):
    return rounded(criteria.flow_layout(_label_table(spark, d), 2))


# four "runs" that group the nations by quarters of their trade with each of four nations
_RUNS = f"SELECT row AS id, col::INT AS run, (ntile(4) OVER (PARTITION BY col ORDER BY value, row))::INT AS label FROM (SELECT i AS row, j AS col, v AS value FROM ({D.TRADE})) WHERE col < 4"
_CONSENSUS = f"WITH l AS ({_RUNS}), c AS (SELECT a.id AS i, b.id AS j, avg(CASE WHEN a.label = b.label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS value FROM l a JOIN l b ON a.run = b.run GROUP BY ALL)"


def _runs(spark, d):
    y = C.to_cells(spark, _network(spark, d), list(range(25)), list(range(25)))
    return y.where("col < 4").select(F.col("row").alias("id"), F.col("col").cast("int").alias("run"), F.ntile(4).over(Window.partitionBy("col").orderBy("value", "row")).alias("label"))


@query("consensus_matrix", f"{_CONSENSUS} SELECT i, j, round(value, 6) AS value FROM c")
def _(spark, d):
    return rounded(criteria.consensus(_runs(spark, d)))


@query("consensus_dispersion_pac", f"{_CONSENSUS} SELECT round(avg(4 * pow(value - 0.5, 2)), 6) AS dispersion, round(avg(CASE WHEN i > j THEN CASE WHEN value > 0.1 AND value < 0.9 THEN 1.0 ELSE 0.0 END END), 6)::DOUBLE AS pac FROM c")
def _(spark, d):
    return rounded(criteria.consensus_measures(_runs(spark, d)))


_HASH = "((123 + {i}::BIGINT * 7919 + {j}::BIGINT * 104729) * 48271) % 1000003"


@query("folds_element", f"SELECT row, col, ntile(5) OVER (ORDER BY {_HASH.format(i='row', j='col')}, row, col)::INT AS fold FROM (SELECT i + 1 AS row, j + 1 AS col FROM ({D.QUANTITY}))")
def _(spark, d):
    y = D.quantity(spark, d)
    r, c = F.dense_rank().over(Window.orderBy("row")), F.dense_rank().over(Window.orderBy("col"))  # labels of a model-sized matrix
    rows, cols = y.select("row").distinct().withColumn("r", r.cast("bigint")), y.select("col").distinct().withColumn("c", c.cast("bigint"))
    grid = rows.select("r").crossJoin(cols.select("c"))
    return prep.folds(grid.select(F.col("r").alias("row"), F.col("c").alias("col")), 5, "row", "col")


@query("folds_column", "SELECT id, ntile(5) OVER (ORDER BY ((123 + id * 7919) * 48271) % 1000003, id)::INT AS fold FROM (SELECT o_orderkey AS id FROM orders)")
def _(spark, d):
    return prep.folds(D.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), 5, "id")


@query("folds_contiguous", "SELECT id, ntile(4) OVER (ORDER BY id)::INT AS fold FROM (SELECT c_custkey AS id FROM customer)")
def _(spark, d):
    return prep.folds(D.table(spark, d, "customer").select(F.col("c_custkey").alias("id")), 4, "id", shuffle=False)


@query("folds_upper_triangle", f"WITH u AS (SELECT i, j, ntile(5) OVER (ORDER BY {_HASH.format(i='i', j='j')}, i, j)::INT AS fold FROM ({D.TRADE}) WHERE i <= j) SELECT i AS row, j AS col, fold FROM u UNION ALL SELECT j, i, fold FROM u WHERE i < j")
def _(spark, d):
    return prep.upper_triangle_folds(C.to_cells(spark, _network(spark, d), list(range(25)), list(range(25))), 5)




_SHARES = "SELECT row_number() OVER (ORDER BY v DESC, j)::INT AS rank, sum(v) OVER (ORDER BY v DESC, j) / sum(v) OVER () AS r2 FROM (SELECT c_nationkey AS j, sum(o_totalprice) AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"


@query("elbow", f"""WITH k AS ({_SHARES}), s AS (SELECT rank, (rank - 1.0) / (count(*) OVER () - 1) AS x, (r2 - min(r2) OVER ()) / (max(r2) OVER () - min(r2) OVER ()) AS y FROM k)
SELECT rank, round(abs(x - y) / sqrt(2), 6) AS distance FROM s ORDER BY abs(x - y) DESC, rank LIMIT 1""")
def _(spark, d):
    """Of the share of all revenue that the largest nations have, by their number."""
    spent = D.table(spark, d, "orders", "o_custkey", "o_totalprice").join(D.table(spark, d, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    spent = spent.groupBy("c_nationkey").agg(F.sum("o_totalprice").alias("v"))
    largest = Window.orderBy(F.desc("v"), "c_nationkey")  # a row a nation
    curve = spent.select(F.row_number().over(largest).alias("rank"), (F.sum("v").over(largest) / F.sum("v").over(Window.partitionBy())).alias("r2"))
    return rounded(criteria.elbow(curve))


_DRAWS = "SELECT l_linenumber::VARCHAR AS basis, l_returnflag AS covariate, l_orderkey * 10 + l_linenumber AS replicate, l_discount * l_quantity AS value FROM lineitem"


@query("boot_summary", f"""WITH d AS ({_DRAWS}), e AS (SELECT basis, covariate, avg(value) AS estimate FROM d GROUP BY ALL)
SELECT basis, covariate, round(estimate, 6) AS estimate, round(stddev_samp(value), 6) AS bse, round(quantile_cont(value, 0.025), 6) AS ci_low, round(quantile_cont(value, 0.975), 6) AS ci_high,
round(least(1.0, 2 * least(avg(CASE WHEN value >= 2 * estimate THEN 1.0 ELSE 0.0 END), 1 - avg(CASE WHEN value >= 2 * estimate THEN 1.0 ELSE 0.0 END))), 6)::DOUBLE AS p_value FROM d JOIN e USING (basis, covariate) GROUP BY basis, covariate, estimate""")
def _(spark, d):
    li = D.table(spark, d, "lineitem", "l_linenumber", "l_returnflag", "l_orderkey", "l_discount", "l_quantity")
    draws = li.select(F.col("l_linenumber").cast("string").alias("basis"), F.col("l_returnflag").alias("covariate"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("replicate"), (F.col("l_discount") * F.col("l_quantity")).alias("value"))
    return rounded(criteria.bootstrap_summary(draws, draws.groupBy("basis", "covariate").agg(F.avg("value").alias("estimate"))))


# ---------------------------------------------------------------- time series


def _series_matrix(spark, d):
    y, rows, _ = C.to_numpy(D.series(spark, d).select(F.col("var").alias("row"), F.col("t").alias("col"), "value"))
    return y, rows


def _ar_program():
    """X and Theta of a fixed two-lag fit on the daily series, in a program over s(k, t, v)."""
    p = Program(f"raw AS ({D.SERIES}), s AS (SELECT dense_rank() OVER (ORDER BY var) - 1 AS k, t, value AS v FROM raw), n AS (SELECT max(t) AS m FROM s)")
    y = p.source("SELECT k AS i, t - 2 AS j, v FROM s WHERE t >= 2", (5, 0))
    a = p.source("SELECT k AS i, t - 1 AS j, v FROM s WHERE t >= 1 AND t < (SELECT m FROM n) UNION ALL SELECT k + 5, t, v FROM s WHERE t < (SELECT m FROM n) - 1 UNION ALL SELECT 10, t, 1.0::DOUBLE FROM s WHERE k = 0 AND t < (SELECT m FROM n) - 1", (11, 0))
    s_ya, s_aa = y @ a.T, a @ a.T
    x, c = p.const(_start(5, 2)), p.const(np.ones((2, 11)))
    for _ in range(ITERATIONS):
        x, c = steps.core_eu(p, x, c, s_ya, s_aa)
    return p, x, c


def _columns(p: Program, m: Matrix, low: int, high: int) -> Matrix:
    return p.add(f"SELECT i, j - {low} AS j, v FROM {m.name} WHERE j >= {low} AND j < {high}", (m.shape[0], high - low))


def _forecast_sql(ahead: int = 3) -> str:
    p, x, c = _ar_program()
    last = [p.source(f"SELECT k AS i, 0::BIGINT AS j, v FROM s WHERE t = (SELECT m FROM n) - {k}", (5, 1)) for k in (0, 1)]
    t1, t2, t0 = _columns(p, c, 0, 5), _columns(p, c, 5, 10), _columns(p, c, 10, 11)
    parts = []
    for h in range(ahead):
        new = x @ (t1 @ last[0] + t2 @ last[1] + t0)
        parts.append(f"SELECT i, {h + 1}::BIGINT AS h, round(v, 6) AS value FROM {new.name}")
        last = [new, last[0]]
    return p.select(" UNION ALL ".join(parts))


def ar_fit(spark, d) -> tuple[Fit, np.ndarray, np.ndarray]:
    """The two-lag fit of the daily series: (fit, full series, design)."""
    y, _ = _series_matrix(spark, d)
    target, a = ts.design(y, 2)
    return nmf(target, a, 2, init=_start(5, 2), fixed_iterations=ITERATIONS), y, a


@query("ar_forecast", _forecast_sql)
def _(spark, d):
    fit, y, _ = ar_fit(spark, d)
    out = ts.forecast(fit.x, fit.c, y, 2, 3)
    return rounded(spark.createDataFrame([(i, h + 1, float(v)) for (i, h), v in np.ndenumerate(out)], "i bigint, h bigint, value double"))


def _irf_sql() -> str:
    p, x, c = _ar_program()
    g1, g2 = _columns(p, c, 0, 5) @ x, _columns(p, c, 5, 10) @ x
    psi = [p.const(np.eye(2)), g1]
    for _ in range(2, 5):
        psi.append(g1 @ psi[-1] + g2 @ psi[-2])
    order = p.add(f"SELECT k AS i, 0::BIGINT AS j, row_number() OVER (ORDER BY c, k) - 1 AS v FROM (SELECT j AS k, sum((i + 1) * v) / 5 AS c FROM {x.name} GROUP BY j)", (2, 1)).name
    return p.select(" UNION ALL ".join(f"SELECT {h}::BIGINT AS h, oi.v::BIGINT AS i, oj.v::BIGINT AS j, round(m.v, 6) AS value FROM {m.name} m JOIN {order} oi ON oi.i = m.i JOIN {order} oj ON oj.i = m.j" for h, m in enumerate(psi)))


@query("ar_irf", _irf_sql)
def _(spark, d):
    fit, _, _ = ar_fit(spark, d)
    psi = ts.impulse_response(ts.latent(fit.x, fit.c, 2).g, 4)
    return rounded(spark.createDataFrame([(h, i, j, float(v)) for (h, i, j), v in np.ndenumerate(psi)], "h bigint, i bigint, j bigint, value double"))


@query("ar_latent")
def _(spark, d):
    fit, _, _ = ar_fit(spark, d)
    found = ts.latent(fit.x, fit.c, 2)
    rows = [("root", k, float(r.real), float(r.imag)) for k, r in enumerate(found.roots)] + [("radius", 0, found.radius, 0.0), ("radius_of_sum", 0, found.radius_of_sum, 0.0)]
    rows += [("mean_y", k, float(v), 0.0) for k, v in enumerate([] if found.mean_y is None else found.mean_y)]
    known = ts.identification(fit.x, fit.c)
    for name, values in (("separability", found.separability), ("anchor", known.anchors), ("pure", known.pure), ("column_sum", found.column_sums)):
        rows += [(name, k, float(v), 0.0) for k, v in enumerate([] if values is None else values)]
    return rounded(spark.createDataFrame(rows, "name string, k int, re double, im double"))


@query("ar_stationarity")
def _(spark, d):
    fit, _, _ = ar_fit(spark, d)
    rows = [(m, *(ts.stationarity(fit.x, fit.c, 2, m)[k] for k in ("radius", "stationary", "low", "high"))) for m in ("latent", "companion")]
    return rounded(spark.createDataFrame(rows, "method string, radius double, stationary boolean, low double, high double"))


@query("latent_bootstrap")
def _(spark, d):
    y, _ = _series_matrix(spark, d)
    target, a = ts.design(y, 1)
    fit = nmf(target, a, 2, maxit=300, epsilon=1e-6)
    return rounded(ts.infer_latent(spark, fit, target, a, 1, draws=24, maxit=300, epsilon=1e-6)[0])


@query("degree_cv")
def _(spark, d):
    return rounded(resample.degree_cv(spark, _series_matrix(spark, d)[0], 2, (1, 2, 3), maxit=300))


# ---------------------------------------------------------------- resampling, inference, other models


@query("ecv")
def _(spark, d):
    return rounded(resample.ecv(spark, _dense_revenue(spark, d)[0], None, (1, 2, 3), maxit=500))


@query("ecv_signed")
def _(spark, d):
    y, a = _dense_revenue(spark, d)
    return rounded(resample.ecv(spark, y - y.mean(), a, (1, 2), family="signed", maxit=100))


@query("ecv_rrr")
def _(spark, d):
    y1, y2, *_ = _halves(spark, d)
    return rounded(resample.ecv(spark, y1, y2, (1, 2), family="rrr", maxit=200))


@query("ecv_net")
def _(spark, d):
    return rounded(resample.ecv(spark, _network(spark, d), None, (1, 2, 3), family="net", maxit=200))


@query("cv")
def _(spark, d):
    y, a = _dense_revenue(spark, d)
    return rounded(resample.cv(spark, y, a, (1, 2, 3), maxit=500))


@query("cv_signed")
def _(spark, d):
    y, a = _dense_revenue(spark, d)
    return rounded(resample.cv(spark, y - y.mean(), a, (1, 2), family="signed", maxit=100))


@query("cv_rrr")
def _(spark, d):
    y1, y2, *_ = _halves(spark, d)
    return rounded(resample.cv(spark, y1, y2, (1, 2), family="rrr", maxit=200))


@query("ffb_cv")
def _(spark, d):
    y1, y2, *_ = _halves(spark, d)
    return rounded(resample.ffb_cv(spark, y1 / y1.max(), y2 / y2.max(), 2, 3, maxit=200))


@query("rank_net")
def _(spark, d):
    y = _network(spark, d)
    return rounded(resample.rank_curve(spark, y / y.max(), None, (1, 2, 3), 3, family="net", maxit=100))


@query("cv_identity")
def _(spark, d):
    return rounded(resample.cv(spark, _dense_revenue(spark, d)[0], None, (1, 2, 3), maxit=500))


@query("bicv")
def _(spark, d):
    y = C.to_numpy(D.quantity(spark, d))[0]
    return rounded(resample.bicv(spark, y, (1, 2, 3), maxit=500))


@query("rank_curve")
def _(spark, d):
    return rounded(resample.rank_curve(spark, _dense_revenue(spark, d)[0], None, (1, 2, 3), maxit=500))


@query("consensus_curve")
def _(spark, d):
    return rounded(resample.consensus_curve(spark, _dense_revenue(spark, d)[0], None, (2, 3), runs=8, maxit=300))


@query("ard_rank")
def _(spark, d):
    return resample.ard_rank(spark, C.to_numpy(D.quantity(spark, d))[0], 5, runs=6, maxit=1000)[0]


@query("beta_cv")
def _(spark, d):
    y, a = _dense_revenue(spark, d)
    d2 = ((y[:, :, None] - y[:, None, :]) ** 2).sum(axis=0)
    scale = 1 / (2 * np.median(d2[d2 > 0]))
    return resample.beta_cv(spark, y, d2, 2, [scale * f for f in (0.1, 1.0, 10.0)], maxit=300)


@query("inference_onestep")
def _(spark, d):
    y, a = _dense_revenue(spark, d)
    return rounded(infer.infer(spark, nmf(y, a, 2, maxit=2000), y, a, draws=200))


@query("refit_bootstrap")
def _(spark, d):
    y, a = _dense_revenue(spark, d)
    return rounded(infer.infer(spark, nmf(y, a, 2, maxit=2000), y, a, draws=32, method="refit", refit_maxit=2000))


@query("network_inference")
def _(spark, d):
    y = _network(spark, d)
    fit = nmf_net(y, 3, maxit=500)
    return rounded(infer.infer_network(spark, fit, y, draws=100))


@query("rrr_inference")
def _(spark, d):
    y1, y2, *_ = _halves(spark, d)
    return rounded(infer.infer_rrr(spark, nmf_rrr(y1, y2, 2, maxit=1000), y1, y2, draws=100))


@query("ffb_bootstrap")
def _(spark, d):
    y1, y2, *_ = _halves(spark, d)
    fit = nmf_ffb(y1 / 10, y2 / 10, 2, l2_ortho=1.0, c1_l1=0.1, maxit=500)
    return rounded(infer.infer_ffb(spark, fit, y1 / 10, y2 / 10, draws=24, maxit=300))


@query("split_roles")
def _(spark, d):
    y, rows, _ = C.to_numpy(D.quantity(spark, d))
    found = mixed.split_roles(y, rows)
    return rounded(spark.createDataFrame([(k, n, float(v), n in found["exogenous"]) for k, (n, v) in enumerate(zip(found["order"], found["influence"], strict=True))], "k int, name string, influence double, exogenous boolean"))


@query("mixed_effects")
def _(spark, d):
    y, a = _dense_revenue(spark, d)
    model = mixed.nmf_mixed(y, a, 2, outer=60, inner=20)
    return rounded(spark.createDataFrame([tuple(map(float, (model.sigma2, model.tau2, model.icc, model.df_u(), model.nll)))], "sigma2 double, tau2 double, icc double, df_u double, nll double"))


@query("mixed_inference")
def _(spark, d):
    y, a = _dense_revenue(spark, d)
    return rounded(mixed.infer_mixed(spark, mixed.nmf_mixed(y, a, 2, outer=60, inner=20), y, a))


@query("mixed_ecv")
def _(spark, d):
    return rounded(mixed.ecv_mixed(spark, _dense_revenue(spark, d)[0], None, (1, 2), outer=20, inner=10))


@query("hclust_cpcc")
def _(spark, d):
    y = _dense_revenue(spark, d)[0]
    rows = criteria.cluster_criteria(y, [(f"rank{q}", nmf(y, None, q, maxit=500).c) for q in (2, 3)])
    return rounded(spark.createDataFrame([tuple(r.values()) for r in rows], "fit string, rank int, silhouette double, cpcc double, dist_cor double, hard double"))


@query("fit_summary")
def _(spark, d):
    return rounded(describe.summary(spark, revenue_fit(spark, d, "cov")), 4)


@query("objective_trace")
def _(spark, d):
    return rounded(describe.trace_table(spark, revenue_fit(spark, d, "cov")))


@query("dot_text")
def _(spark, d):
    y1, y2, *_ = _halves(spark, d)
    ar, _, _ = ar_fit(spark, d)
    texts = [("YXA", describe.fit_dot(revenue_fit(spark, d, "cov"))), ("net", describe.fit_dot(nmf_net(_network(spark, d), 2, maxit=100))), ("rrr", describe.fit_dot(nmf_rrr(y1, y2, 2, maxit=100))), ("ar", describe.ar_dot(ar))]
    return spark.createDataFrame(texts, "model string, dot string")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Cluster shares of each nation's revenue profile, with its likeliest cluster."""
    _, b, _, _ = _factors(spark, d)
    prob = criteria.membership(b)
    label = criteria.hard_labels(b).select("col", "label")
    nation = D.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("col"), F.col("n_name").alias("nation"))
    return rounded(prob.join(label, "col").join(F.broadcast(nation), "col").select("nation", F.col("row").alias("basis"), F.col("value").alias("share"), "label"))  # 25 nations


from . import queries_blocks, queries_description, queries_dynamics, queries_sums, queries_weighted  # noqa: E402, F401 - they register theirs
