"""Helpers that the text operators share: Arrow access, word hashing, native span maths; storage is the library's."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.storage import freed, stored  # noqa: F401 - the text operators take them from here

#: Words of a tokenless text split: bytes.split() cuts at exactly \x20 and \x09-\x0D.
BLOCK = 256


# ---------------------------------------------------------------- Arrow and words

#: Most bytes of a batch that goes to a Python worker; what a worker holds is a small multiple of it.
BATCH_BYTES = "2m"


def to_python(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches bounded by BATCH_BYTES from here on (a single longer text is a batch)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row; null gives b''."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


class WordHash(dict):
    """word -> 64-bit hash, remembered; emptied when it gets large, so memory stays bounded."""

    limit = 65_536

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Odd 64-bit factors, one for each place in a word window, from the golden ratio's bits.
_FACTORS = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF for k in range(64)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of MurmurHash3 (its published constants), a bijection of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; fewer words than that are one run; none give none."""
    n = len(hashes)
    width = min(width, n)
    if not n:
        return hashes
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total += mixed(hashes[k : n - width + 1 + k] + _FACTORS[k]) * _FACTORS[k]
    return mixed(total + np.uint64(width))


# ---------------------------------------------------------------- order


def in_ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows in ranges of ascending order, written down with _range and _row (a row's number in its range, from 0).

    Equal rows are told apart by where they were read, so that no crowd of them fills one range.
    """
    by = [F.col(c).asc_nulls_first() for c in (*order, "_read")]
    sorted_rows = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_read")
    place = F.col("_place")  # the range in the upper bits, the row's number in the lower 33
    placed = sorted_rows.withColumn("_place", F.monotonically_increasing_id())
    return stored(placed.withColumns({"_range": F.shiftright(place, 33), "_row": place.bitwiseAND((1 << 33) - 1)}).drop("_place"))


# ---------------------------------------------------------------- native arrays


def running(values: Column, zero: Column, step) -> Column:
    """Running totals of an array, by `step`, in blocks, so that n values cost about n ** 1.5 copies and not n ** 2."""

    def within(array: Column) -> Column:
        return F.aggregate(
            array,
            F.struct(zero.alias("at"), F.expr("array()").cast(f"array<{'bigint'}>").alias("all")),
            lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["all"], F.array(step(acc["at"], x))).alias("all")),
            lambda acc: acc["all"],
        )

    def joined(blocks: Column) -> Column:
        ends = within(F.transform(blocks, lambda b: F.element_at(b, -1)))
        later = lambda e, b, k: let(F.get(e, k - 1), lambda before: F.transform(b, lambda x: step(before, x)))
        return let(ends, lambda e: F.flatten(F.transform(blocks, lambda b, k: F.when(k == 0, b).otherwise(later(e, b, k)))))

    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: within(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))
    return let(values, lambda v: F.when(F.size(v) == 0, F.expr("array()").cast("array<bigint>")).otherwise(let(cut(v), joined)))


def spans(text: Column, pattern: str, may: Column | None = None) -> Column:
    """array<struct<start,end,found>> of the leftmost non-overlapping matches; code points, end exclusive.

    The pieces between the matches and the matches tell by their lengths where each match lies. may: a cheaper condition
    without which there is no match.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(found: Column) -> Column:
        lengths = F.transform(found, lambda x: F.length(x).cast("bigint"))
        steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), lengths, lambda p, n: F.length(p) + n)
        return let(steps, lambda x: F.zip_with(running(x, F.lit(0).cast("bigint"), lambda a, y: a + y), found, lambda e, x: F.struct((e - F.length(x)).alias("start"), e.alias("end"), x.alias("found"))))

    any_ = text.rlike(pattern) if may is None else may & text.rlike(pattern)
    return F.when(any_, let(found, placed)).otherwise(F.expr("array()").cast("array<struct<start:bigint,end:bigint,found:string>>"))


#: Characters of the chunks in which a text's parts are looked up, so that n parts of a text don't cost n walks through it.
CHUNK = 32_768


def replaced(text: Column, found: Column, put) -> Column:
    """text with the union of the found spans (sorted by start) replaced by put(its characters that are new there)."""

    def rebuilt(x: Column) -> Column:
        def part(a: Column, b: Column) -> Column:
            inside = lambda c: F.substring(F.get(x["chunks"], c), (F.greatest(a - c * CHUNK, F.lit(0)) + 1).cast("int"), (F.least(b, (c + 1) * CHUNK) - F.greatest(a, c * CHUNK)).cast("int"))
            first, last = F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")
            return F.when(a < b, F.array_join(F.transform(F.sequence(first, last), inside), "")).otherwise("")

        before = lambda k: F.when(k == 0, F.lit(0).cast("bigint")).otherwise(F.get(x["ends"], k - 1))
        one = lambda s, k: let(before(k), lambda at: F.concat(part(at, s["start"]), F.when(s["end"] > at, put(s["end"] - F.greatest(s["start"], at))).otherwise("")))
        return F.concat(F.array_join(F.transform(x["found"], one), ""), part(F.element_at(x["ends"], -1), x["size"]))

    def with_ends(f: Column) -> Column:
        ends = running(F.transform(f, lambda s: s["end"]), F.lit(0).cast("bigint"), lambda a, x: F.greatest(a, x))
        chunks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / CHUNK).cast("int")), lambda c: F.substring(text, c * CHUNK + 1, F.lit(CHUNK)))
        return let(F.struct(f.alias("found"), ends.alias("ends"), chunks.alias("chunks"), F.length(text).cast("bigint").alias("size")), rebuilt)

    return F.when(F.size(found) > 0, let(found, with_ends)).otherwise(text)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, so that a step's own columns can't clash with the caller's."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (f"_{name}{'_' * k}" for k in range(len(taken) + 1)) if n.lower() not in taken) for name in names]


def let(value: Column, then) -> Column:
    """then(value) with value computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def written(found: Column) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
