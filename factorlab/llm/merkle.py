"""Merkle manifest of a dataset: a tree of eight-way runs per group, a tree over the groups, and every row's proof.

Levels come from windows: partitioned by group and parent index, an ordered full-frame collect_list gives the run that is
both the parent's preimage and, without the node itself, its siblings; the run's first row then stands for the parent on
the next level. A leaf's place in its group comes from ranges of (group, id): rows are numbered within their range, and a
range's offset is a sum over the ranges before it, so no group is ever sorted in one task.

Levels are written down on the way up (an eighth of the one below each) and joined on the way down, where a node's path is
its own siblings and its parent's path. A path is an array of (left, right): what stands before and after the node in its
run. The proof is its hash, and folding any leaf along it gives the root that this leaf would have.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import freed, in_ranges, stored, unused
from .urls import LOWER, UPPER

WIDTH = 8
_PATH = "array<struct<left:string,right:string>>"


def hashed(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated; none of them may be null."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """`-` for null, else the value's UTF-8 byte count, `:` and the value; numbers are written in decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _facts(ranges: DataFrame, group: str) -> DataFrame:
    """For each range and group in it: _first (row of it), _before (rows of the group in the ranges before), n (in all)."""
    counts = ranges.groupBy("_range", group).agg(F.count("*").alias("_rows"), F.min("_row").alias("_first"))
    within = Window.partitionBy(group)  # as many rows as the group has ranges
    before = F.sum("_rows").over(within.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumns({"_before": F.coalesce(before, F.lit(0)), "n": F.sum("_rows").over(within)}).drop("_rows")


def _numbered(ranges: DataFrame, facts: DataFrame, group: str) -> DataFrame:
    """The rows of ranges with at (number in the group, from 0) and what facts has beside its own columns."""
    more = [c for c in facts.columns if c not in ("_range", "_first", "_before", group)]
    facts = facts.withColumnRenamed("_range", "_in").withColumnRenamed(group, "_of")
    both = ranges.join(facts, (F.col("_range") == F.col("_in")) & F.col(group).eqNullSafe(F.col("_of")))
    return both.withColumn("at", F.col("_before") + F.col("_row") - F.col("_first")).select(*[c for c in ranges.columns if c not in ("_range", "_row")], "at", *more)


def _run(nodes: DataFrame) -> DataFrame:
    """nodes (g, at, hash, ..) with up (the parent's index) and run (the hashes below the parent, in order)."""
    nodes = nodes.withColumn("up", F.floor(F.col("at") / WIDTH).cast("bigint"))
    whole = Window.partitionBy("g", "up").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return nodes.withColumn("run", F.collect_list("hash").over(whole))


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """From nodes (g, at, n, hash), numbered within g, the levels above them until every g has one node; each written down."""
    out, most = [nodes], nodes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    while most > 1:
        runs = _run(out[-1].where("n > 1")).where(f"at % {WIDTH} = 0")  # one row for each parent
        parents = runs.select("g", F.col("up").alias("at"), F.ceil(F.col("n") / WIDTH).cast("bigint").alias("n"), hashed(F.array_join("run", "")).alias("hash"))
        out.append(stored(parents))
        most = -(-most // WIDTH)
    return out


def _siblings() -> Column:
    own = (F.col("at") % WIDTH).cast("int")
    left, right = F.slice("run", F.lit(1), own), F.slice("run", own + 2, F.lit(WIDTH))
    return F.array(F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right")))


def _paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest level's columns with path and subroot; tops (g, path, subroot) has those of each group's last node."""
    above = None
    for level in reversed(levels):
        last = level.where("n = 1").join(tops, "g")
        if above is None:
            above = last
        else:
            known = above.select("g", F.col("at").alias("up"), F.col("path").alias("higher"), "subroot")
            inner = _run(level.where("n > 1")).join(known, ["g", "up"]).withColumn("path", F.concat(_siblings(), "higher"))
            above = last.unionByName(inner.select(last.columns))
    return above


def manifest(rows: DataFrame, leaf: Column, group: str = "lang", id_col: str = "doc_id", other: Column | None = None) -> DataFrame:
    """All rows and columns, with leaf, subroot, root, proof_sha256, folded_root and verified.

    leaf: hash of a row's content. other: the hash that is folded along the row's path instead (default: the leaf), so
    that verified tells whether it is the one in the tree. Groups are ordered null first, then by their bytes; leaves of
    a group by id (null first), then by leaf. Rows that repeat another wholly are leaves of their own, next to it. A lone
    leaf is its group's subroot, and a lone group's subroot is the root. No rows give no rows. A column of rows that has
    one of these names (in any case) is replaced; others keep their values.
    """
    made = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    kept = [c for c in rows.columns if c.lower() not in made]
    # the caller's columns travel as one struct beside the leaf, so that none of our names can clash with theirs
    (name,) = unused(rows, "other")
    rows = rows.withColumn(name, leaf if other is None else other)
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{group}`").cast("string").alias("lang"), F.col(f"`{id_col}`").alias("id"), leaf.alias("hash"), F.col(name).alias("other"))
    packed = stored(packed)  # ranges are drawn from a sample: the hashes would be made twice
    ranges = in_ranges(packed, ["lang", "id", "hash"])
    freed(packed)
    facts = stored(_facts(ranges, "lang"))

    # the groups, one row each; g is a group's number
    groups = in_ranges(facts.select("lang").distinct().withColumn("all", F.lit(0)), ["all", "lang"])
    n_groups = F.lit(groups.count()).cast("bigint")
    numbers = _numbered(groups, _facts(groups, "all"), "all").select(F.col("at").alias("g"), F.col("lang").alias("_lang"))
    known = facts.join(numbers, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")
    bottom = stored(_numbered(ranges, known, "lang").select("row", "hash", "other", "g", "at", "n"))
    freed(ranges, facts, groups)
    levels = _levels(bottom)

    subroots = reduce(DataFrame.unionByName, [x.where("n = 1").select("g", "hash") for x in levels])
    tree = _levels(stored(subroots.select(F.lit(0).alias("g"), F.col("g").alias("at"), n_groups.alias("n"), "hash")))
    first = tree[-1].where("n = 1").select("hash").first()
    root = F.lit(first[0] if first else None).cast("string")
    end = tree[0].sparkSession.range(1).select(F.lit(0).alias("g"), F.expr("array()").cast(_PATH).alias("path"), F.lit("").alias("subroot"))
    tops = _paths(tree, end).select(F.col("at").alias("g"), "path", F.col("hash").alias("subroot"))

    proof = hashed(F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), ""))
    folded = F.aggregate("path", F.col("other"), lambda acc, x: hashed(x["left"], acc, x["right"]))
    out = _paths(levels, tops).select("row", F.col("hash").alias("leaf"), "subroot", root.alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    out = out.select(*[F.col("row").getField(c).alias(c) for c in kept], *made[:4], "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
    return out


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    fields = lambda text: [encoded(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")] + [encoded(text)]
    lowered = F.translate("text", UPPER, LOWER)
    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    leaf = hashed(*fields(F.col("text")))
    hashes = docs.select("doc_id", "lang", leaf.alias("first"), F.when(tampered, hashed(*fields(lowered))).otherwise(leaf).alias("second"))
    out = manifest(hashes, F.col("first"), other=F.col("second"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _sql_encoded(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"


_FIELDS = " || ".join(_sql_encoded(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWERED = f"translate(text, '{UPPER}', '{LOWER}')"
#: CRC-32 of the decimal id, bit by bit: a byte joins the state before the first of its eight steps.
_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''),
           lambda c: CASE WHEN c = '' THEN []::UBIGINT[] ELSE [ascii(c), 0, 0, 0, 0, 0, 0, 0]::UBIGINT[] END))),
           lambda s, x: xor(xor(s, x) >> 1, (xor(s, x) & 1) * 3988292384::UBIGINT)), 4294967295::UBIGINT)"""


def _sql_run(frame: str) -> str:
    return f"coalesce(string_agg(hash, '') OVER (PARTITION BY level, g, pos // 8 ORDER BY pos ROWS BETWEEN {frame}), '')"


OP11_SQL = f"""
WITH RECURSIVE hashes AS (
  SELECT doc_id, lang, row_number() OVER () AS r, sha256({_FIELDS} || {_sql_encoded("text")}) AS leaf,
         CASE WHEN {_CRC} % 3 = 0 THEN sha256({_FIELDS} || {_sql_encoded(_LOWERED)}) ELSE sha256({_FIELDS} || {_sql_encoded("text")}) END AS other
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g
  FROM hashes
), nodes AS (
  SELECT 0 AS level, g, pos, n, leaf AS hash FROM leaves
  UNION ALL
  SELECT level + 1, g, pos // 8, (max(n) + 7) // 8, sha256(string_agg(hash, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY level, g, pos // 8
), top AS (
  SELECT 0 AS level, 0 AS g, g AS pos, (SELECT count(*) FROM nodes WHERE n = 1) AS n, hash FROM nodes WHERE n = 1
  UNION ALL
  SELECT level + 1, g, pos // 8, (max(n) + 7) // 8, sha256(string_agg(hash, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, g, pos // 8
), runs AS (
  SELECT level, g, pos, n, {_sql_run("UNBOUNDED PRECEDING AND 1 PRECEDING")} AS before, {_sql_run("1 FOLLOWING AND UNBOUNDED FOLLOWING")} AS after FROM nodes
), top_runs AS (
  SELECT level, g, pos, n, {_sql_run("UNBOUNDED PRECEDING AND 1 PRECEDING")} AS before, {_sql_run("1 FOLLOWING AND UNBOUNDED FOLLOWING")} AS after FROM top
), folds AS (
  SELECT r, g, 0 AS level, pos, other AS acc, '' AS proof FROM leaves
  UNION ALL
  SELECT r, g, level + 1, pos // 8, sha256(before || acc || after), proof || before || after FROM folds JOIN runs USING (level, g, pos) WHERE n > 1
), ended AS (
  SELECT r, g, acc, proof, hash AS subroot FROM folds JOIN nodes USING (level, g, pos) WHERE n = 1
), top_folds AS (
  SELECT r, 0 AS g, 0 AS level, g AS pos, acc, proof, subroot FROM ended
  UNION ALL
  SELECT r, g, level + 1, pos // 8, sha256(before || acc || after), proof || before || after, subroot FROM top_folds JOIN top_runs USING (level, g, pos) WHERE n > 1
)
SELECT doc_id, leaf, subroot, hash AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = hash AS verified
FROM top_folds JOIN top USING (level, g, pos) JOIN leaves USING (r) WHERE top.n = 1
"""
