"""The driver tables as the matrices that the queries work on: for Spark, and as DuckDB SQL of (i, j, v) from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import cells as C


def table(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*columns) if columns else df


def revenue(spark: SparkSession, d: str) -> DataFrame:
    """Segment x nation cells: order revenue in millions."""
    o = table(spark, d, "orders", "o_custkey", "o_totalprice")
    c = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return C.from_long(joined, "c_mktsegment", F.col("c_nationkey").cast("bigint"), F.col("o_totalprice") / 1e6)


def regions(spark: SparkSession, d: str) -> DataFrame:
    """Region x nation cells, 0 or 1."""
    return C.one_hot(table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"), F.format_string("r%d", "n_regionkey").alias("label")), "key", "label")


def quantity(spark: SparkSession, d: str) -> DataFrame:
    """Type x brand cells: quantity sold, in thousands."""
    li = table(spark, d, "lineitem", "l_partkey", "l_quantity")
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_type")
    return C.from_long(li.join(p, F.col("l_partkey") == F.col("p_partkey")), "p_type", "p_brand", F.col("l_quantity") / 1e3)


def trade(spark: SparkSession, d: str) -> DataFrame:
    """Nation x nation adjacency of trade, symmetric, in tens of millions."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_extendedprice")
    o, c = table(spark, d, "orders", "o_orderkey", "o_custkey"), table(spark, d, "customer", "c_custkey", "c_nationkey")
    s = table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    edges = joined.groupBy("c_nationkey", "s_nationkey").agg((F.sum("l_extendedprice") / 1e7).alias("w"))
    return C.from_edges(edges.select(F.col("c_nationkey").cast("bigint").alias("a"), F.col("s_nationkey").cast("bigint").alias("b"), "w"), "a", "b", "w")


def spending(spark: SparkSession, d: str) -> DataFrame:
    """Priority x customer cells: order totals, in hundred thousands, of the customers with orders."""
    return C.from_long(table(spark, d, "orders", "o_orderpriority", "o_custkey", "o_totalprice"), "o_orderpriority", F.col("o_custkey").cast("bigint"), F.col("o_totalprice") / 1e5)


def markets(spark: SparkSession, d: str) -> DataFrame:
    """Segment x customer cells, 0 or 1."""
    return C.one_hot(table(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("key"), "c_mktsegment"), "key", "c_mktsegment")


def series(spark: SparkSession, d: str) -> DataFrame:
    """(t, var, value): events a day by type, in hundreds."""
    s = C.from_series(table(spark, d, "events", "ts", "event_type"), "ts", "day", "event_type")
    return s.withColumn("value", F.col("value") / 100)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, x ARRAY<DOUBLE>) of the embeddings."""
    return table(spark, d, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))


SEGMENTS = "(SELECT c_mktsegment AS seg, row_number() OVER (ORDER BY c_mktsegment) - 1 AS i FROM (SELECT DISTINCT c_mktsegment FROM customer))"
REVENUE_CELLS = "SELECT c_mktsegment AS row, c_nationkey::BIGINT AS col, sum(o_totalprice / 1e6) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"
REVENUE = f"SELECT s.i::BIGINT AS i, n.n_nationkey::BIGINT AS j, coalesce(r.value, 0.0) AS v FROM {SEGMENTS} s CROSS JOIN nation n LEFT JOIN ({REVENUE_CELLS}) r ON r.row = s.seg AND r.col = n.n_nationkey"
SPENDING = "SELECT dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS i, j, v FROM (SELECT o_orderpriority, o_custkey::BIGINT AS j, sum(o_totalprice / 1e5) AS v FROM orders GROUP BY ALL)"
MARKETS = f"SELECT s.i, c_custkey::BIGINT AS j, 1.0::DOUBLE AS v FROM customer JOIN {SEGMENTS} s ON s.seg = c_mktsegment WHERE c_custkey IN (SELECT o_custkey FROM orders)"
REGIONS = "SELECT r_regionkey::BIGINT AS i, n_nationkey::BIGINT AS j, CASE WHEN n_regionkey = r_regionkey THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM region, nation"
QUANTITY_CELLS = "SELECT p_type AS row, p_brand AS col, sum(l_quantity / 1e3) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"
_TYPES = "(SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM (SELECT DISTINCT p_type AS t FROM part JOIN lineitem ON l_partkey = p_partkey))"
_BRANDS = "(SELECT b, row_number() OVER (ORDER BY b) - 1 AS j FROM (SELECT DISTINCT p_brand AS b FROM part JOIN lineitem ON l_partkey = p_partkey))"
QUANTITY = f"SELECT t.i::BIGINT AS i, b.j::BIGINT AS j, coalesce(q.value, 0.0) AS v FROM {_TYPES} t CROSS JOIN {_BRANDS} b LEFT JOIN ({QUANTITY_CELLS}) q ON q.row = t.t AND q.col = b.b"
_TRADE_EDGES = "SELECT c_nationkey::BIGINT AS a, s_nationkey::BIGINT AS b, sum(l_extendedprice) / 1e7 AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"
TRADE_CELLS = f"SELECT row, col, sum(w) / 2 AS value FROM (SELECT a AS row, b AS col, w FROM ({_TRADE_EDGES}) UNION ALL SELECT b, a, w FROM ({_TRADE_EDGES})) GROUP BY ALL"
TRADE = f"SELECT x.n_nationkey::BIGINT AS i, y.n_nationkey::BIGINT AS j, coalesce(t.value, 0.0) AS v FROM nation x CROSS JOIN nation y LEFT JOIN ({TRADE_CELLS}) t ON t.row = x.n_nationkey AND t.col = y.n_nationkey"
_DAYS = "(SELECT unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), INTERVAL 1 DAY)) AS day FROM events)"
SERIES = f"""SELECT date_diff('day', (SELECT min(ts) FROM events), g.day)::BIGINT AS t, e.event_type AS var, coalesce(n.c, 0) / 100.0::DOUBLE AS value
FROM {_DAYS} g CROSS JOIN (SELECT DISTINCT event_type FROM events) e LEFT JOIN (SELECT date_trunc('day', ts) AS day, event_type, count(*) AS c FROM events GROUP BY ALL) n ON n.day = g.day AND n.event_type = e.event_type"""
