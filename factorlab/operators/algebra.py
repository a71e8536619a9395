"""Matrix algebra over cells and over sample rows."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored


def matmul(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cells of the product: an equi-join on the inner index and a sum with map-side combine."""
    a = left.select("row", F.col("col").alias("inner"), F.col("value").alias("x"))
    b = right.select(F.col("row").alias("inner"), "col", F.col("value").alias("y"))
    return a.join(b, "inner").groupBy("row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def transposed(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def whole(vector: str) -> Column:
    """Whether the vector is there and without null or NaN; what isn't whole takes no part in products and distances."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double"))), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of vectors; other lengths than the first one's are an error, not a shift of all that follows."""
    lengths = pc.list_value_length(column)
    if column.null_count or pc.min(lengths).as_py() != pc.max(lengths).as_py():
        raise ValueError("vectors differ in length")
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def gram(samples: DataFrame, left: str, right: str) -> DataFrame:
    """(i, j, value): sum over samples of left_i * right_j, for array columns of equal length in every row.

    Samples of which either vector is null, or holds a null or NaN, are left out. Every task folds its Arrow batches into one block, so what is shuffled is one block a task, whatever the rows.
    """

    def fold(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = _matrix(batch.column(0)).T @ _matrix(batch.column(1))
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int64)), pa.array(j.ravel().astype(np.int64)), pa.array(total.ravel())], ["i", "j", "value"])

    parts = samples.where(whole(left) & whole(right)).select(F.col(left).alias("left"), F.col(right).alias("right")).mapInArrow(fold, "i bigint, j bigint, value double")
    return parts.groupBy("i", "j").agg(F.sum("value").alias("value"))


def gram_numpy(samples: DataFrame, left: str, right: str) -> np.ndarray:
    """gram() on the driver; it is as large as the model."""
    rows = gram(samples, left, right).toPandas()
    out = np.zeros((int(rows.i.max()) + 1, int(rows.j.max()) + 1)) if len(rows) else np.zeros((0, 0))
    out[rows.i.to_numpy(), rows.j.to_numpy()] = rows.value.to_numpy()
    return out


def statistics(samples: DataFrame, n_rows: int, n_covariates: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(YA', AA', squared norm of Y, least value) of samples (y, a) in one pass; a task gives one block. Samples of which either
    vector isn't whole are left out."""
    size = n_rows * n_covariates + n_covariates**2 + 1

    def fold(batches):
        total, low = np.zeros(size), np.inf
        for batch in batches:
            if batch.num_rows:
                y, a = _matrix(batch.column(0)), _matrix(batch.column(1))
                total += np.concatenate([(y.T @ a).ravel(), (a.T @ a).ravel(), [float((y**2).sum())]])
                low = min(low, y.min(), a.min())
        if low < np.inf:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total), pa.array(np.full(size, low))], ["k", "v", "low"])

    rows = samples.where(whole("y") & whole("a")).select("y", "a").mapInArrow(fold, "k bigint, v double, low double").groupBy("k").agg(F.sum("v").alias("v"), F.min("low").alias("low")).toPandas().sort_values("k")
    if not len(rows):
        return np.zeros((n_rows, n_covariates)), np.zeros((n_covariates, n_covariates)), 0.0, 0.0
    v, cut = rows.v.to_numpy(), n_rows * n_covariates
    return v[:cut].reshape(n_rows, n_covariates), v[cut:-1].reshape(n_covariates, n_covariates), float(v[-1]), float(rows.low.min())


def gram_cells(left: DataFrame, right: DataFrame) -> DataFrame:
    """(row, row2, value): sum over shared columns, for sparse cells."""
    b = right.select(F.col("row").alias("row2"), "col", F.col("value").alias("y"))
    return left.join(b, "col").groupBy("row", "row2").agg(F.sum(F.col("value") * F.col("y")).alias("value"))


#: Rows of the blocks in which pairs are computed, bytes of vectors in a file of blocks, and rows of a batch that leaves a task.
BLOCK_ROWS, FILE_BYTES, BATCH_ROWS = 512, 16 << 20, 1 << 17

#: How Parquet writes files of pairs: a dictionary holds all values of six digits in [0, 1], and a page, after the first of which it
#: is kept or given up, has the rows to show what it saves. Else most files of pairs are plain doubles, several times as large.
PAIR_FILES = {"parquet.dictionary.page.size": 8 << 20, "parquet.page.row.count.limit": 1 << 20}


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (id, x, ..) in blocks of at most BLOCK_ROWS, each column as an array, written down in files of about FILE_BYTES.

    block: the block's number, even and odd by turns within a file and from file to file.
    """
    found = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("p")).first()
    some = math.ceil(2 * math.sqrt(rows.sparkSession.sparkContext.defaultParallelism))  # files of two sides: four tasks a core
    files = min(-(-found["n"] // BLOCK_ROWS), max(some, -(-found["n"] * 8 * (found["p"] or 0) // FILE_BYTES)))

    names = [*rows.columns, "block"]

    def cut(batches):
        number = TaskContext.get().partitionId() * ((1 << 40) + 1)
        for batch in batches:
            edges = pa.array([*range(0, batch.num_rows, BLOCK_ROWS), batch.num_rows], pa.int32())
            numbers = pa.array(np.arange(number, number + len(edges) - 1))
            number += len(numbers)
            yield pa.RecordBatch.from_arrays([*(pa.ListArray.from_arrays(edges, c) for c in batch.columns), numbers], names)

    return stored(rows.repartition(max(1, files)).mapInArrow(cut, ", ".join([*(f"`{c}` array<{t}>" for c, t in rows.dtypes), "block bigint"])))


def codes(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of both sides as whole numbers in their order, equal where the ids are."""
    both = pc.rank(pa.concat_arrays([left, right]), sort_keys="ascending", tiebreaker="dense").to_numpy()
    return both[: len(left)].astype(np.int64), both[len(left) :].astype(np.int64)


def in_blocks(u: DataFrame, v: DataFrame, fold, schema: str, gaps: bool = False, once: bool = False) -> DataFrame:
    """fold(left, right) over all pairs of a block of u and one of v; gives a list of arrays, the columns of schema.

    u and v are rows (id, x ARRAY<DOUBLE>, ..); left and right are dicts of arrays, x (and q) as matrices of a row each. Rows
    whose id or vector is null, or holds a null or NaN, take no part; with gaps, nulls in vectors come as NaN. Vectors of
    different length are an error. Blocks are written down once, and files of blocks meet in a Cartesian product: no block is
    shuffled or copied. A task reads v's files one at a time beside a file of u, and holds one of v's and a pair of blocks.
    once, for a v that is u: of two blocks only one order is folded, and left and right have the block's number as block.
    """
    vectors = lambda rows: [c for c in ("x", "q") if c in rows.columns]
    kept = lambda rows: rows.where(reduce(lambda a, c: a & ((F.size(c) > 0) if gaps else whole(c)), vectors(rows), F.col("id").isNotNull()))
    u, v = kept(u), kept(v)
    a = _blocks(u)
    b = a if once or u.sameSemantics(v) else _blocks(v)
    named = lambda blocks, side: blocks.select(*[F.col(c).alias(f"{c}_{side}") for c in blocks.columns])
    tasks = 4 * u.sparkSession.sparkContext.defaultParallelism  # of neighbouring file pairs, so that sums of a row of u meet in a task
    left, right = named(a, "a"), named(b, "b").hint("shuffle_replicate_nl")
    if once:  # by turns, so that each task has about half of its pairs
        m, n = F.col("block_a"), F.col("block_b")
        both = left.join(right, (m == n) | (((m + n) % 2 == 1) == (m < n))).coalesce(tasks)
    else:
        both = left.drop("block_a").crossJoin(right.drop("block_b")).coalesce(tasks)
    u.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")  # a pair of blocks at least
    sides = [(c, *c.rsplit("_", 1)) for c in both.columns]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                got: dict[str, dict] = {"a": {}, "b": {}}
                for position, (_, c, side) in enumerate(sides):
                    part = batch.column(position).slice(k, 1)
                    part = part if c == "block" else part.flatten()
                    got[side][c] = _matrix(part) if c in ("x", "q") else part
                made = fold(got["a"], got["b"])
                out = pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in made], names)
                yield from (out.slice(at, BATCH_ROWS) for at in range(0, out.num_rows, BATCH_ROWS))

    return both.mapInArrow(run, schema)


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Between all rows of x and of y, by one matrix product; where that cancels, from the differences."""
    norms = (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)
    out = norms - 2 * (x @ y.T)
    i, j = np.nonzero(out <= 1e-6 * norms)
    for k in range(0, len(i), 65_536):
        some = slice(k, k + 65_536)
        out[i[some], j[some]] = ((x[i[some]] - y[j[some]]) ** 2).sum(axis=1)
    return out


def id_type(rows: DataFrame) -> str:
    return rows.schema["id"].dataType.simpleString()


def pairwise(u: DataFrame, v: DataFrame, value=squared_distances, gaps: bool = False, symmetric: bool = False) -> DataFrame:
    """(u, v, value) for every row of u (id, x) and of v (id, x): squared distances, or value of the two matrices.

    Rows without a whole vector give no pairs; with gaps, nulls come as NaN. The product of the two is the result asked for; v is the side to keep small (landmarks).
    symmetric: value doesn't change when the sides do. Where v is u, each pair of blocks is then computed once and given both
    ways, row by row, so that equal values lie near each other; the result's files take less room by that.
    What leaves a worker is a row of u with all of a block as two arrays, which Spark takes apart in generated code: a row for
    each pair would cost more on its way out of Arrow than the kernel itself. The session's Parquet files are then written as
    PAIR_FILES says, but for what is set already.
    """
    conf = u.sparkSession.conf
    for key, limit in PAIR_FILES.items():
        conf.set(key, conf.get(key, str(limit)))
    u, v = u.select("id", "x"), v.select("id", "x")
    once = symmetric and u.sameSemantics(v)

    def fold(left, right):
        n, m = len(left["id"]), len(right["id"])
        made = value(left["x"], right["x"])
        edges = pa.array(np.arange(0, n * m + 1, m), pa.int32())
        rows = [left["id"], *(pa.ListArray.from_arrays(edges, x) for x in (right["id"].take(pa.array(np.tile(np.arange(m), n))), pa.array(made.ravel())))]
        return [*rows, np.full(n, left["block"][0] != right["block"][0])] if once else rows

    rows = in_blocks(u, v, fold, f"u {id_type(u)}, v array<{id_type(v)}>, value array<double>" + (", twice boolean" if once else ""), gaps, once)
    if not once:
        return rows.select("u", "v", F.posexplode("value").alias("at", "value")).select("u", F.col("v")[F.col("at")].alias("v"), "value")
    ways = F.when(F.col("twice"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    cells = rows.select("u", "v", "value", F.explode(ways).alias("back")).select("u", "v", "back", F.posexplode("value").alias("at", "value"))
    one, other = F.col("u"), F.col("v")[F.col("at")]
    return cells.select(F.when(F.col("back"), other).otherwise(one).alias("u"), F.when(F.col("back"), one).otherwise(other).alias("v"), "value")


def nearest_squared(u: DataFrame, v: DataFrame) -> DataFrame:
    """(u, value): the least squared distance of each row of u to a row of v of another id; no pair leaves a task.

    Rows without a whole vector are compared with none and give no row.
    """

    def fold(left, right):
        d = squared_distances(left["x"], right["x"])
        a, b = codes(left["id"], right["id"])
        d[a[:, None] == b] = np.inf
        least = d.min(axis=1)
        here = np.flatnonzero(least < np.inf)
        return [left["id"].take(pa.array(here)), least[here]]

    return in_blocks(u.select("id", "x"), v.select("id", "x"), fold, f"u {id_type(u)}, value double").groupBy("u").agg(F.min("value").alias("value"))
