"""Nearest neighbours by an inverted multi-index: both halves of a vector are quantised apart, so a cell is a pair of centroids.

1. K centroids a half come from a bounded sample (k-means in NumPy on the driver); K grows with the rows. Every vector gets its
   cell. Equal vectors are one entry with its smallest ids: no other can be among the nearest. Cells are packed into units of
   at most UNIT entries; a cell of more is dealt out over several.
2. A query goes through the centroid pairs by summed distance (of inner products: their negative) with a heap, until the cells
   it has visited hold `reach` entries. It is sent once to each unit that has one of its cells, with the sum at which it ended.
3. In a unit, queries in blocks of at most BLOCK meet its entries in one matrix product; only entries of visited cells count,
   and the best of each query are scored anew in double precision. The best of all units are the result.

reach isn't guessed: up to TUNING queries are compared with all entries, and reach is what as many of their true neighbours
need as `recall` asks for. In data without structure that is a share of all entries; no index can do much better there.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import freed, stored, to_python

NEAREST, RECALL = 20, 0.96
#: Vectors of the sample from which centroids are learned, k-means steps, entries for each cell, and most centroids a half.
SAMPLE, STEPS, PER_CELL, MOST_CENTROIDS = 16_384, 10, 64, 1024
#: Queries that are compared with all entries to find how far a query has to go.
TUNING = 256
#: Entries of a unit and queries of a block.
UNIT, BLOCK = 4096, 1024


@dataclass
class Model:
    """Centroids of both halves, number of entries of each cell, and of each cell its first unit and the number of its units."""

    halves: tuple[np.ndarray, np.ndarray]
    kind: np.dtype
    counts: np.ndarray | None = None
    unit: np.ndarray | None = None
    units: np.ndarray | None = None

    @property
    def at(self) -> int:
        return self.halves[0].shape[1]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """The nearest centroid of each half, as one number."""
        i, j = (np.argmin((c * c).sum(axis=1) - 2 * (x @ c.T), axis=1) for c, x in zip(self.halves, (vectors[:, : self.at], vectors[:, self.at :]), strict=True))
        return i.astype(np.int64) * len(self.halves[1]) + j

    def distances(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Negative inner products of the query's halves with the centroids; of a query always the same bits."""
        return tuple(-(c * x).sum(axis=1) for c, x in zip(self.halves, (query[: self.at], query[self.at :]), strict=True))

    def visited(self, query: np.ndarray, reach: int) -> tuple[float, list[int]]:
        """Cells by ascending summed distance until they hold reach entries, ties included; and the last sum."""
        one, two = self.distances(query)
        first, second = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
        one, two = one[first].tolist(), two[second].tolist()
        heap, seen, cells, last = [(one[0] + two[0], 0, 0)], 0, [], np.inf
        while heap and (seen < reach or heap[0][0] == last):
            last, a, b = heapq.heappop(heap)
            cell = int(first[a]) * len(two) + int(second[b])
            if self.counts[cell]:
                seen += self.counts[cell]
                cells.append(cell)
            if b + 1 < len(two):
                heapq.heappush(heap, (one[a] + two[b + 1], a, b + 1))
            if b == 0 and a + 1 < len(one):
                heapq.heappush(heap, (one[a + 1] + two[0], a + 1, 0))
        return float(last), cells

    def packed(self) -> None:
        """Deals the cells' entries out over units, neighbouring cells together."""
        self.unit, self.units = np.zeros(len(self.counts), np.int64), np.ones(len(self.counts), np.int64)
        now = size = 0
        for cell in np.flatnonzero(self.counts):
            n = int(self.counts[cell])
            if size and size + n > UNIT:
                now, size = now + 1, 0
            self.unit[cell], self.units[cell] = now, -(-n // UNIT)
            size += n
            if n > UNIT:
                now, size = now + int(self.units[cell]), 0


def k_means(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids by Lloyd's steps from k distinct points; an empty cluster keeps its centroid."""
    distinct = np.unique(points, axis=0)
    centroids = distinct[np.sort(rng.permutation(len(distinct))[:k])]
    for _ in range(STEPS):
        nearest = np.argmin((centroids * centroids).sum(axis=1) - 2 * (points @ centroids.T), axis=1)
        size = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centroids)
    return centroids


def matrix(column: pa.Array, kind: np.dtype) -> np.ndarray:
    """Rows of an array of bytes of equally long vectors, in double precision."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)


def _vectors(rows: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, int]:
    """(id, vector) of the rows that take part, and their vectors' length."""
    x = F.col("vector")
    whole = rows.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector}`").alias("vector")).where(F.col("id").isNotNull() & (F.size("vector") > 0))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = whole.where(F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False)))
    lengths = whole.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()
    return (whole.where(F.size("vector") == lengths["length"]), lengths["length"]) if lengths else (whole, 0)


def _coded(whole: DataFrame, model: Model) -> DataFrame:
    """(id, key, vector as bytes, cell), written down; equal vectors have one key."""

    def run(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(model.kind) + model.kind.type(0)  # -0 becomes 0
            x = flat.reshape(batch.num_rows, -1)
            raw = [r.tobytes() for r in x]
            cells = model.cells(x.astype(np.float64)) if len(x) else np.zeros(0, np.int64)
            keys = [xxhash.xxh3_128_digest(r) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(raw, pa.binary()), pa.array(cells, pa.int64())], ["id", "key", "vector", "cell"])

    return stored(to_python(whole).mapInArrow(run, "id bigint, key binary, vector binary, cell bigint"))


def _entries(coded: DataFrame, keep: int) -> DataFrame:
    """(key, vector, cell, ids): distinct vectors, each with its `keep` smallest distinct ids in order; written down."""
    order = Window.partitionBy("key").orderBy("id")  # a task's rows of a vector are cut to its smallest ids before they are dealt
    ranked = coded.select("key", "id").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= keep)
    ids = ranked.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    once = coded.groupBy("key").agg(F.first("vector").alias("vector"), F.first("cell").alias("cell"))
    return stored(once.join(ids, "key"))


def _best(scored: DataFrame, keep: int) -> DataFrame:
    """The keep best entries (query, score, ids) of each query: by score, then by smallest id."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.get("ids", F.lit(0)))
    return scored.withColumn("k", F.row_number().over(order)).where(F.col("k") <= keep).drop("k")


def _top(scores: np.ndarray, keep: int) -> np.ndarray:
    """Indices of the keep largest finite scores and of those within rounding of the last."""
    finite = np.flatnonzero(np.isfinite(scores))
    if len(finite) <= keep:
        return finite
    values = scores[finite]
    least = np.partition(values, len(values) - keep)[len(values) - keep]
    return finite[values >= least - 1e-9 * max(1.0, np.abs(values).max())]


def _exact(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision; of a pair always the same bits."""
    return (x * query).sum(axis=1)


def _tuned(entries: DataFrame, model: Model, queries: DataFrame, n_queries: int, keep: int, recall: float) -> int:
    """The reach at which a share `recall` of the true nearest entries of up to TUNING queries is found."""
    share = min(1.0, TUNING / max(1, n_queries))
    drawn = queries.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * TUNING).select("key", "vector").toPandas()
    if not len(drawn):
        return keep
    asked = np.stack([np.frombuffer(v, model.kind).astype(np.float64) for v in drawn["vector"]])
    own = [bytes(k) for k in drawn["key"]]

    def run(batches):
        best = [[] for _ in own]
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, cells, scores = batch.column(0).to_pylist(), batch.column(2).to_pylist(), matrix(batch.column(1), model.kind) @ asked.T
            for q, mine in enumerate(best):
                mine += [(-float(scores[k, q]), keys[k], cells[k]) for k in _top(scores[:, q], keep) if keys[k] != own[q]]
                best[q] = heapq.nsmallest(keep, mine)
        rows = [(q, -s, c) for q, mine in enumerate(best) for s, _, c in mine]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.float64(), pa.int64()))], ["query", "score", "cell"])

    found = to_python(entries.select("key", "vector", "cell")).mapInArrow(run, "query int, score double, cell bigint")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "cell")
    true = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= keep).select("query", "cell").toPandas()
    needed = []
    for q, mine in true.groupby("query"):
        one, two = model.distances(asked[q])
        sums = np.add.outer(one, two).ravel()
        by_sum = np.argsort(sums, kind="stable")
        upto = np.empty(len(sums), np.int64)
        upto[by_sum] = np.cumsum(model.counts[by_sum])
        needed += upto[mine["cell"].to_numpy()].tolist()
    return int(np.quantile(needed, recall, method="higher")) if needed else keep


def nearest(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = NEAREST, recall: float = RECALL) -> DataFrame:
    """(query_id, rank from 1, id, score): of each row for which is_query (of the column id) holds, the k nearest other rows.

    Nearness is the inner product in double precision, ties go to the smaller id. Ids are whole numbers. Rows whose id or vector
    is null, or whose vector is empty, zero, of another length than most (ties: than the shortest), or holds a null or a
    non-finite number take no part. Rows that repeat an id and its vector count once. With several vectors an id is several
    entries; as a query it asks with the one of the smallest key, and finds none of its own id. Fewer than k others are all
    found. Other columns are not read. recall: share of the true neighbours that the tuning asks for.
    """
    whole, length = _vectors(rows, id_col, vector)
    spark = rows.sparkSession
    if not length:
        return spark.createDataFrame([], f"query_id bigint, rank int, {id_col} bigint, score double")
    n = whole.count()
    rng = np.random.default_rng(7)
    share = min(1.0, SAMPLE / n)
    sample = whole.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * SAMPLE).select("vector").toPandas()["vector"]
    kind = np.dtype(np.float32 if dict(whole.dtypes)["vector"] == "array<float>" else np.float64)
    points = np.array([np.asarray(x, np.float64) for x in sample]).reshape(len(sample), length)
    centroids = int(np.clip(2 ** round(np.log2(max(1.0, n / PER_CELL)) / 2), 1, MOST_CENTROIDS))
    model = Model(tuple(k_means(x, centroids, rng) for x in (points[:, : (length + 1) // 2], points[:, (length + 1) // 2 :])), kind)

    coded = _coded(whole, model)
    # an id can have several vectors: as many entries are no candidates of a query
    own = coded.select("id", "key").distinct().groupBy("id").count().agg(F.max("count")).first()[0]
    keep = k + own
    entries = _entries(coded, keep)
    counts = entries.groupBy("cell").count().toPandas()  # as many rows as cells at most: MOST_CENTROIDS squared
    model.counts = np.zeros(len(model.halves[0]) * len(model.halves[1]), np.int64)
    model.counts[counts["cell"].to_numpy(np.int64)] = counts["count"].to_numpy(np.int64)
    model.packed()

    asking = stored(coded.select("id", "key").where(is_query).groupBy("id").agg(F.min("key").alias("key")))
    freed(coded)
    queries = entries.join(asking.select("key").distinct(), "key", "left_semi").select("key", "vector")
    reach = max(_tuned(entries, model, queries, asking.count(), keep, recall), 4 * keep)
    shared = spark.sparkContext.broadcast(model)  # three numbers a cell, MOST_CENTROIDS squared cells at most

    def sent(batches):
        """A row for each unit that has a visited cell."""
        model = shared.value
        for batch in batches:
            keys, vectors, units, sums = [], [], [], []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                last, cells = model.visited(np.frombuffer(raw, model.kind).astype(np.float64), reach)
                mine = sorted({u for c in cells for u in range(model.unit[c], model.unit[c] + model.units[c])})
                keys += [key] * len(mine)
                vectors += [raw] * len(mine)
                units += mine
                sums += [last] * len(mine)
                if len(keys) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(vectors, pa.binary()), pa.array(units, pa.int64()), pa.array(sums, pa.float64())], ["query", "asked", "unit", "last"])
                    keys, vectors, units, sums = [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(vectors, pa.binary()), pa.array(units, pa.int64()), pa.array(sums, pa.float64())], ["query", "asked", "unit", "last"])

    def dealt(batches):
        """Each entry's unit; those of a crowded cell go to one of its units by their key."""
        model = shared.value
        for batch in batches:
            cells = batch.column(2).to_numpy().astype(np.int64)
            salt = np.array([int.from_bytes(x[:7], "little") for x in batch.column(0).to_pylist()], np.int64)
            units = model.unit[cells] + salt % model.units[cells]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), pa.array(units, pa.int64())], ["vector", "cell", "ids", "unit"])

    visits = stored(to_python(queries).mapInArrow(sent, "query binary, asked binary, unit bigint, last double"))
    blocks = visits.groupBy("unit").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    visits_in = visits.join(blocks, "unit").select("unit", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int").alias("block"), "query", "asked", "last")
    placed = to_python(entries.select("key", "vector", "cell", "ids")).mapInArrow(dealt, "vector binary, cell bigint, ids array<bigint>, unit bigint")
    copies = placed.join(blocks, "unit").select("unit", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vector", "cell", "ids")

    def search(asked: pa.Table, known: pa.Table) -> pa.Table:
        out = ([], [], [])
        if asked.num_rows and known.num_rows:
            model = shared.value
            x, q = matrix(known.column("vector").combine_chunks(), model.kind), matrix(asked.column("asked").combine_chunks(), model.kind)
            cells = known.column("cell").to_numpy()
            i, j = np.divmod(cells, len(model.halves[1]))
            scores, ids = q @ x.T, known.column("ids").to_pylist()
            for a, (query, last) in enumerate(zip(asked.column("query").to_pylist(), asked.column("last").to_pylist(), strict=True)):
                one, two = model.distances(q[a])
                at = _top(np.where(one[i] + two[j] <= last, scores[a], -np.inf), keep)
                exact = _exact(x[at], q[a]).tolist()
                for s, b in sorted(zip(exact, at.tolist(), strict=True), key=lambda m: (-m[0], ids[m[1]][0]))[:keep]:
                    out[0].append(query)
                    out[1].append(s)
                    out[2].append(ids[b])
        return pa.table([pa.array(out[0], pa.binary()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.list_(pa.int64()))], names=["query", "score", "ids"])

    found = visits_in.groupBy("unit", "block").cogroup(copies.groupBy("unit", "block")).applyInArrow(search, "query binary, score double, ids array<bigint>")
    lists = stored(_best(found, keep).groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("best")))  # keep rows each
    freed(visits)
    others = asking.join(lists, asking["key"] == lists["query"]).select(F.col("id").alias("query_id"), F.explode("best").alias("x")).select("query_id", "x.score", F.explode("x.ids").alias("id")).where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return others.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, F.col("id") % 20 == 0)
