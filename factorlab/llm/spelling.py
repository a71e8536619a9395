"""Spelling variants: words one insertion, deletion or replacement apart, by merging errata tries along heavy paths.

The words form a trie; of a node's branches the one that most words take is heavy, the others are light, so a word leaves
heavy paths O(log n) times. At a fork every word x = p c t of a light branch c is merged into the rest of the fork's subtree

* with c replaced by the heavy branch's letter h: does p h t end there too? Two light branches meet in p _ t;
* with c skipped: does p t end there? Only where t doesn't begin with c, else a deeper fork sees the same pair;
* with h put before it, as the heavy branch with h skipped: does p h c t end there?

A word's end counts as a branch, for which only the last of these is possible. A coinciding end is a pair one edit apart, and
every such pair comes out once: at the fork where the two words part, at least one of them is on a light branch.

The trie is cut into chunks of sorted words. A fork whose words all lie in one chunk is merged there, small to large. A fork
that may reach beyond its chunk (a prefix of the chunk's first or last word) has its light words write down the strings with
which they would meet others, and these are joined with all words. Which branch of such a fork is heavy is read from exact
counts of the most frequent short prefixes; a fork not among them has light branches only. Any choice gives the same pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import freed, in_ranges, stored, text_bytes, to_python

LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: One in so many of a document's runs loses a letter.
ERRORS = 31
#: Distinct words after which a worker hands on its counts, and bytes of the words of a chunk of the trie.
FLUSH_WORDS, CHUNK_BYTES = 200_000, 1 << 20
#: Letters up to which a string is its own key, and rows of the batches that a worker hands on.
LONG, BLOCK_ROWS = 64, 20_000
#: Of the prefixes shorter than TOP_LENGTH, the TOP_FORKS with the most words have a heavy branch beyond chunks.
TOP_LENGTH, TOP_FORKS = 6, 20_000

_RUN = re.compile(rf"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")


def letter_runs(raw: bytes) -> list[str]:
    """Maximal runs of letters, A-Z lowered (bytes.lower() lowers no other); those too short to be words are left out."""
    return _RUN.findall(raw.lower().decode("utf-8", "replace"))


def variants(doc_id, runs: list[str]) -> list[tuple[str, int]]:
    """(word, n) of a document's runs, where one in ERRORS by the hash of `doc_id:run` has lost a letter."""
    start, out = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), []
    for run, n in Counter(runs).items():
        h = zlib.crc32(run.encode(), start)
        if h % ERRORS == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        out.append((run, n))
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): all words of at least LEAST_LENGTH letters and their occurrences, at least `least` in all texts.

    Null and empty texts have no words; a null id is written as nothing before the `:`. Rows that repeat count again.
    """

    def block(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches):
        counts = defaultdict(int)
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                for word, n in variants(doc_id, letter_runs(raw)):
                    counts[word] += n
                if len(counts) > FLUSH_WORDS:
                    yield block(counts)
                    counts.clear()
        yield block(counts)

    words = to_python(docs.select(id_col, text)).mapInArrow(run, "word string, n bigint")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def heavy_branches(words: DataFrame) -> dict[str, str]:
    """The branch that most words take after each of the TOP_FORKS most frequent prefixes below TOP_LENGTH; `` is the end."""
    lengths = F.sequence(F.lit(0), F.least(F.length("word"), F.lit(TOP_LENGTH - 1)))
    forks = words.select("word", F.explode(lengths).alias("k")).select(F.expr("left(word, k)").alias("prefix"), F.expr("substring(word, k + 1, 1)").alias("branch"))
    counts = forks.groupBy("prefix", "branch").agg(F.count("*").alias("n"))
    best = counts.groupBy("prefix").agg(F.sum("n").alias("all"), F.max(F.struct("n", "branch")).alias("best"), F.count("*").alias("branches"))
    rows = best.where("branches > 1").orderBy(F.desc("all"), "prefix").limit(TOP_FORKS).select("prefix", "best.branch").collect()
    return {r[0]: r[1] for r in rows}


#: Two bases for the digests of long strings, and their modulus and inverses.
_PRIME = (1 << 61) - 1
_BASES = (0x9E3779B97F4A7C15 % _PRIME, 0xC2B2AE3D27D4EB4F % _PRIME)
_BACK = tuple(pow(b, -1, _PRIME) for b in _BASES)


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


class Keys:
    """Keys of a word and of what edits make of it: the string itself up to LONG letters, else 122 bits of a polynomial of its
    letters, of which an edit changes two terms; so the edits of a long word cost no copy of it."""

    def __init__(self, word: str):
        self.word, self.sums = word, None

    def _digest(self, k: int, put: str, skip: int) -> str:
        if self.sums is None:
            self.sums = []
            for base in _BASES:
                total, power, sums, powers = 0, 1, [0], [1]
                for c in self.word:
                    total = (total + ord(c) * power) % _PRIME
                    power = power * base % _PRIME
                    sums.append(total)
                    powers.append(power)
                self.sums.append((sums, powers))
        out = []
        for (sums, powers), base, back in zip(self.sums, _BASES, _BACK, strict=True):
            rest = sums[-1] - sums[k + skip]
            rest = rest * (base if len(put) > skip else back if len(put) < skip else 1)
            out.append((sums[k] + (ord(put) * powers[k] if put else 0) + rest) % _PRIME)
        return f"#{out[0]:016x}{out[1]:016x}"

    def __call__(self, k: int = 0, put: str = "", skip: int = 0) -> str:
        """Of the word with `skip` letters (0 or 1) from k on replaced by put (a letter or nothing)."""
        if len(self.word) + len(put) - skip <= LONG:
            return self.word[:k] + put + self.word[k + skip :]
        return self._digest(k, put, skip)


class Chunk:
    """A run of the sorted distinct words with counts; finds what meets in it, and tells what might meet words elsewhere.

    near and best: for each word the number of its near words and the (-n, index) of the most frequent one, as far as found
    here. beyond() gives (key, length, index); length -1 asks for the word of this key, else light words of a fork of that
    length meet in key. It gives at most four for each letter and end of the words.
    """

    def __init__(self, words: list[str], counts: list[int], top: dict[str, str]):
        self.words, self.counts, self.top = words, counts, top
        self.index = {w: k for k, w in enumerate(words)}
        self.near, self.best = [0] * len(words), [None] * len(words)
        self.first, self.last = (words[0], words[-1]) if words else ("", "")
        todo = [(0, len(words))] if words else []
        while todo:
            lo, hi = todo.pop()
            k = _common(words[lo], words[hi - 1])
            branches = self._branches(lo, hi, k)
            todo += [(begin, end) for _, begin, end in branches if end - begin > 1]
            # a prefix of the chunk's first or last word may have words elsewhere
            if len(branches) > 1 and _common(words[lo], self.first) < k and _common(words[lo], self.last) < k:
                self._merge(k, branches)

    def _branches(self, lo: int, hi: int, k: int) -> list[tuple[str, int, int]]:
        """(letter, or `` for the end, first, last + 1) of the branches of the words from lo to hi after k letters."""
        words, out, at = self.words, [], lo
        while at < hi:
            letter, begin = words[at][k : k + 1], at
            while at < hi and words[at][k : k + 1] == letter:
                at += 1
            out.append((letter, begin, at))
        return out

    def _met(self, a: int, n: int, b: int) -> None:
        found = (-self.counts[b], b)
        self.near[a] += n
        if self.best[a] is None or found < self.best[a]:
            self.best[a] = found

    def _look(self, a: int, word: str) -> None:
        if (b := self.index.get(word)) is not None:
            self._met(a, 1, b)
            self._met(b, 1, a)

    def _merge(self, k: int, branches: list[tuple[str, int, int]]) -> None:
        """The light branches of a fork into the others, small to large."""
        heavy = max(branches, key=lambda b: b[2] - b[1])[0]
        meeting = defaultdict(list)
        for letter, begin, end in branches:
            for a in range(begin, end) if letter != heavy else ():
                word = self.words[a]
                prefix, rest = word[:k], word[k + 1 :]
                if heavy:
                    self._look(a, prefix + heavy + word[k:])
                if letter:
                    if heavy:
                        self._look(a, prefix + heavy + rest)
                    if not rest.startswith(letter):
                        self._look(a, prefix + rest)
                    meeting[rest].append(a)
        for group in meeting.values():
            if len(group) > 1:
                group.sort(key=lambda a: (-self.counts[a], a))
                for a in group:
                    self._met(a, len(group) - 1, group[a == group[0]])

    def beyond(self):
        """What the forks on the ways to the first and the last word ask for."""
        for word in dict.fromkeys((self.first, self.last)) if self.words else ():
            shared = -1 if word == self.first else _common(self.first, word)
            lo, hi, keys = 0, len(self.words), {}
            for k in range(len(word) + 1):
                branches = self._branches(lo, hi, k)
                if k > shared:
                    heavy = self.top.get(word[:k]) if k < TOP_LENGTH else None
                    for letter, begin, end in branches:
                        for a in range(begin, end) if letter != heavy else ():
                            key = keys.get(a) or keys.setdefault(a, Keys(self.words[a]))
                            if heavy:
                                yield key(k, heavy), -1, a
                            if letter:
                                if heavy:
                                    yield key(k, heavy, 1), -1, a
                                if self.words[a][k + 1 : k + 2] != letter:
                                    yield key(k, "", 1), -1, a
                                yield key(k, "", 1), k, a
                lo, hi = next(((begin, end) for letter, begin, end in branches if letter == word[k : k + 1]), (lo, lo))
                keys = {a: x for a, x in keys.items() if lo <= a < hi} if k >= TOP_LENGTH else keys


def near_words(words: DataFrame) -> DataFrame:
    """(place, word, n, n_near, best_n, best) for each of the distinct words (word, n): the number of its near words, and the
    most frequent of them (ties: the smallest in code-point order) by its place; 0 and nulls where there is none.

    Places ascend with the words. Null words are left out; no words give no rows. The result is written down.
    """
    words = in_ranges(words.where("word IS NOT NULL").select("word", "n"), ["word"])
    top = words.sparkSession.sparkContext.broadcast(heavy_branches(words))  # TOP_FORKS prefixes below TOP_LENGTH
    schema = "place bigint, n bigint, key string, length int, n_near bigint, best_n bigint, best bigint"

    def block(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["place", "n", "key", "length", "n_near", "best_n", "best"])

    def found_in(words, counts, start):
        chunk, rows = Chunk(words, counts, top.value), []
        for a, (word, n, near, best) in enumerate(zip(words, counts, chunk.near, chunk.best, strict=True)):
            rows.append((start + a, n, Keys(word)(), -2, near, best and -best[0], best and start + best[1]))
            if len(rows) >= BLOCK_ROWS:
                yield block(rows)
                rows = []
        for key, length, a in chunk.beyond():
            rows.append((start + a, counts[a], key, length, None, None, None))
            if len(rows) >= BLOCK_ROWS:
                yield block(rows)
                rows = []
        if rows:
            yield block(rows)

    def run(batches):
        kept, counts, start, size = [], [], 0, 0
        for batch in batches:
            places = batch.column(2).to_pylist()
            for word, n, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), places, strict=True):
                if kept and (place != start + len(kept) or size > CHUNK_BYTES):  # another range, or the chunk is full
                    yield from found_in(kept, counts, start)
                    kept, counts, size = [], [], 0
                start = start if kept else place
                kept.append(word)
                counts.append(n)
                size += len(word) + 8
        if kept:
            yield from found_in(kept, counts, start)

    placed = words.withColumn("place", F.shiftleft("_range", 33) + F.col("_row"))
    found = stored(to_python(placed.select("word", "n", "place")).mapInArrow(run, schema))
    known = found.where("length = -2").select("key", F.col("place").alias("other"), F.col("n").alias("other_n"))
    pairs = stored(found.where("length = -1").select("place", "n", "key").join(known, "key").select("place", "n", "other", "other_n"))

    # light words that meet in a key differ in one letter each, so they are as many as letters at most; none is paired with all
    # others: the first of them is the best for all but itself, for which it is the second
    fork = Window.partitionBy("key", "length")
    ranked = fork.orderBy(F.desc("n"), "place")
    first = F.struct("n", "place")
    met = found.where("length >= 0").select("place", "n", F.count("*").over(fork).alias("size"), F.row_number().over(ranked).alias("k"), F.first(first).over(ranked).alias("one"), F.lead(first).over(ranked).alias("two"))
    met = met.where("size > 1").select("place", (F.col("size") - 1).alias("n_near"), F.when(F.col("k") == 1, F.col("two")).otherwise(F.col("one")).alias("x"))

    one = F.lit(1).cast("bigint")
    rows = found.where("length = -2 AND n_near > 0").select("place", "n_near", "best_n", "best")
    rows = rows.union(pairs.select("place", one, "other_n", "other")).union(pairs.select("other", one, "n", "place")).union(met.select("place", "n_near", "x.n", "x.place"))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    linked = rows.groupBy("place").agg(F.sum("n_near").alias("n_near"), best.alias("x")).select("place", "n_near", (-F.col("x.less")).alias("best_n"), "x.best")
    out = stored(placed.select("place", "word", "n").join(linked, "place", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0))))
    freed(words, found, pairs)
    return out


def spelling_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for distinct words (word, n).

    form: the most frequent near word, if it is at least ratio times as frequent; root: where the forms lead in the end, the
    word itself if it has none. ratio is over 1, so forms never run in a circle; ways double in length with each join.
    """
    if ratio <= 1:
        raise ValueError("forms must be more frequent than their words")
    near = near_words(words)
    ways = stored(near.where(F.col("best_n") >= ratio * F.col("n")).select("place", F.col("best").alias("form"), F.col("best").alias("root"), F.lit(True).alias("moved")))
    while ways.where("moved").limit(1).count():
        further = ways.select(F.col("place").alias("root"), F.col("root").alias("next"))
        longer = ways.join(further, "root", "left").select("place", "form", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        before, ways = ways, stored(longer)
        freed(before)
    names = near.select("place", "word")
    named = ways.join(near.select(F.col("place").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n")), "form").join(names.select(F.col("place").alias("root"), F.col("word").alias("root_word")), "root")
    out = near.join(named.select("place", F.col("form_word").alias("form"), "form_n", F.col("root_word").alias("root")), "place", "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = stored(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    return spelling_forms(words).select("word", "form", "root", "n", "n_near", "form_n")
