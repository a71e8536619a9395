"""Pairs of blocks: several blocks and files a side against plain loops, and what the plans move."""

import math

import numpy as np
import pytest
from oracle import SF
from pyspark.sql import functions as F

from factorlab.functions.dense import distances
from factorlab.operators import algebra, criteria, prep
from factorlab.plans import queries as Q


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1300, 3))
    frame = lambda m, first: spark.createDataFrame([(first + i, [float(v) for v in m[i]]) for i in range(len(m))], "id long, x array<double>")
    return x, frame(x, 0), frame(x[:600] + 0.5, 5000)


def exchanges(df) -> tuple[int, int]:
    """Cartesian products and exchanges of a plan."""
    return df._jdf.queryExecution().sparkPlan().toString().count("Cartesian"), df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def square(df, n: int, m: int, first: int = 0) -> np.ndarray:
    rows = df.toPandas()
    assert len(rows) == n * m
    out = np.full((n, m), np.nan)
    out[rows["u"], rows["v"] - first] = rows["value"]
    return out


@pytest.mark.parametrize("kind", prep.KERNELS)
def test_kernels_of_several_blocks_move_no_copies(spark, data, kind):
    x, u, v = data
    made = prep.kernel(u, v, kind, (1.0, 1.0) if kind == "periodic" else 0.5)
    assert exchanges(made) == (1, 0)
    y = x[:600] + 0.5
    d2 = ((x[:, None] - y) ** 2).sum(axis=2)
    norm = lambda m: np.sqrt((m**2).sum(axis=1))
    want = {"gaussian": np.exp(-0.5 * d2), "exponential": np.exp(-0.5 * np.sqrt(d2)), "periodic": np.exp(-np.sin(np.sqrt(d2)) ** 2), "linear": x @ y.T, "normalized_linear": x @ y.T / np.outer(norm(x), norm(y)), "polynomial": (x @ y.T + 0.5) ** 2}[kind]
    assert np.allclose(square(made, 1300, 600, 5000), np.maximum(want, 0))


def test_symmetric_pairs_are_computed_once_and_given_both_ways(spark, data):
    x, u, _ = data
    spent = spark.sparkContext.accumulator(0)

    def value(a, b):
        spent.add(a.shape[0] * b.shape[0])
        return algebra.squared_distances(a, b)

    made = algebra.pairwise(u, u, value, symmetric=True)
    assert exchanges(made) == (1, 0)
    got = square(made, 1300, 1300)
    assert np.allclose(got, ((x[:, None] - x) ** 2).sum(axis=2)) and np.array_equal(got, got.T)
    blocks = [r[0] for r in algebra._blocks(u).select(F.size("id")).collect()]
    assert len(blocks) > 2 and spent.value == (sum(blocks) ** 2 + sum(n * n for n in blocks)) // 2
    twice = u.where("id < 700").union(u.where("id < 5"))  # repeated ids are rows of their own
    assert algebra.pairwise(twice, twice, symmetric=True).groupBy("u").count().agg(F.sum("count"), F.max("count")).first()[:] == (705**2, 1410)
    assert algebra.pairwise(u.where("id < 0"), u.where("id < 0"), symmetric=True).count() == 0


def test_kernels_of_a_table_with_itself_take_less_room(spark, data, tmp_path):
    x, u, _ = data
    other = u.withColumn("id", F.col("id") + 0)  # two sides: each pair for itself
    room = []
    for v in (u, other):
        prep.kernel(u, v, "linear").write.parquet(str(tmp_path / str(len(room))))
        room.append(sum(f.stat().st_size for f in (tmp_path / str(len(room))).glob("*.parquet")))
    assert room[0] < 0.75 * room[1]
    assert np.allclose(square(spark.read.parquet(str(tmp_path / "0")), 1300, 1300), np.maximum(x @ x.T, 0))


def test_files_of_pairs_keep_their_dictionary(spark, data, tmp_path):
    x, u, v = data
    made = algebra.pairwise(u, v, lambda a, b: np.floor(np.abs(np.sin(1e4 * algebra.squared_distances(a, b))) * 1e5))
    made.coalesce(1).write.parquet(str(tmp_path / "pairs"))
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 4 * 1300 * 600  # plain doubles: 8 bytes each
    want = np.floor(np.abs(np.sin(1e4 * ((x[:, None] - x[:600] - 0.5) ** 2).sum(axis=2))) * 1e5)
    assert np.abs(square(spark.read.parquet(str(tmp_path / "pairs")), 1300, 600, 5000) - want).max() <= 1
    key, limit = next(iter(algebra.PAIR_FILES.items()))
    spark.conf.set(key, str(2 * limit))  # what is set already stays
    prep.kernel(u, v)
    assert spark.conf.get(key) == str(2 * limit)
    spark.conf.unset(key)


@pytest.mark.parametrize("symmetric", [False, True])
def test_pairs_leave_a_worker_as_arrays(spark, data, symmetric):
    x, u, _ = data
    named = u.where("id < 700").select(F.concat(F.lit("n"), "id").alias("id"), "x")
    made = algebra.pairwise(named, named, symmetric=symmetric)
    assert "posexplode" in made._jdf.queryExecution().executedPlan().toString()
    rows = made.select(F.expr("int(substr(u, 2))").alias("u"), F.expr("int(substr(v, 2))").alias("v"), "value")
    assert np.allclose(square(rows, 700, 700), ((x[:700, None] - x[:700]) ** 2).sum(axis=2))


def test_kernels_for_gaps_of_several_blocks_move_no_copies(spark, data):
    x, u, v = data
    holes = v.select("id", F.transform("x", lambda e, k: F.when((F.col("id") + k) % 4 != 0, e)).alias("x"))
    y = np.where((np.arange(5000, 5600)[:, None] + np.arange(3)) % 4 != 0, x[:600] + 0.5, np.nan)
    made = prep.kernel_partial(u, holes, 0.5)
    assert exchanges(made) == (1, 0)
    d2, seen = np.nansum((x[:, None] - y) ** 2, axis=2), (~np.isnan(y)).sum(axis=1)
    assert np.allclose(square(made, 1300, 600, 5000), np.exp(-0.5 * 3 / seen * d2))
    mixed = prep.Mixture(np.array([1.0]), np.zeros((1, 3)), np.ones((1, 3)))
    made = prep.kernel_expected(u, holes, 0.5, mixed)
    assert exchanges(made) == (1, 0)
    assert np.allclose(square(made, 1300, 600, 5000), prep.expected_kernel(x, y, mixed, 0.5))


def test_null_vectors_miss_all_in_the_partial_kernel(spark, data):
    _, u, v = data
    odd = v.select("id", F.when(F.col("id") % 100 != 0, F.col("x")).alias("x"))
    null = np.arange(5000, 5600) % 100 == 0
    whole = square(prep.kernel_partial(u, v, 0.5), 1300, 600, 5000)
    assert np.allclose(square(prep.kernel_partial(u, odd, 0.5), 1300, 600, 5000), np.where(null, 0.0, whole))
    nulls = v.select("id", F.lit(None).cast("array<double>").alias("x"))
    assert not square(prep.kernel_partial(u, nulls, 0.5), 1300, 600, 5000).any()
    assert prep.kernel_partial(u.where("id < 0"), nulls).count() == 0


def test_nearest_and_bandwidth_of_several_blocks(spark, data):
    x, u, v = data
    least = algebra.nearest_squared(u, u)
    assert exchanges(least) == (1, 1)  # minima of the rows
    d = distances(x.T) + np.where(np.eye(1300) > 0, np.inf, 0)
    assert np.allclose(prep.nearest(u).toPandas().set_index("u")["value"].sort_index(), d.min(axis=1))
    assert prep.bandwidth(u, grid=[0]).first()["beta"] == pytest.approx(1 / (2 * np.median(d.min(axis=1)) ** 2))


def test_silhouette_and_distance_correlation_of_several_blocks(spark, data):
    x, u, _ = data
    labels = u.select("id", (F.col("id") % 3).cast("int").alias("label"))
    assert criteria.silhouette(u, labels).first()[0] == pytest.approx(criteria.dense_silhouette(distances(x.T), np.arange(1300) % 3))
    at = np.triu_indices(1300, 1)
    made = criteria.distance_correlation(u, u.select("id", F.slice("x", 1, 2).alias("x")))
    assert exchanges(made) == (1, 1)  # six sums
    assert made.first()[0] == pytest.approx(np.corrcoef(distances(x.T)[at], distances(x[:, :2].T)[at])[0, 1])


def test_pairs_of_text_ids_and_of_no_rows(spark, data):
    x, u, v = data
    named = u.where("id < 700").select(F.concat(F.lit("n"), "id").alias("id"), "x")
    got = prep.kernel(named, v, "linear").groupBy("u").count().toPandas()
    assert len(got) == 700 and (got["count"] == 600).all()
    assert prep.kernel(u.where("id < 0"), v).count() == prep.kernel(u, v.where("id < 0")).count() == prep.nearest(u.where("id < 1")).count() == 0


@pytest.mark.parametrize("name", [*(f"kernel_{kind}" for kind in prep.KERNELS), "kernel_gaussian_partial"])
def test_kernel_queries_round_pairs_without_decimals(spark, name):
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "round(" not in plan and "rint(" in plan.lower()


def test_pairs_are_rounded_half_away_from_zero(spark):
    rng = np.random.default_rng(5)
    odd = [0.0078125, -0.0078125, 0.0234375, 0.5, 1e-7, 5e-7, -0.0, 1e305, -1e305, 12345678.1234567, 2.0**60, math.inf, -math.inf, math.nan, None]
    rows = [(i, v) for i, v in enumerate(odd + [float(v) for v in rng.normal(size=2000)] + [float(v) for v in rng.exponential(1e-4, 2000)])]
    both = spark.createDataFrame(rows, "id int, value double")
    got, want = (f(both).toPandas()["value"].to_numpy(float) for f in (Q.rounded_pairs, Q.rounded))
    assert np.array_equal(got, want, equal_nan=True) and not np.signbit(got[6])
