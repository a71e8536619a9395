"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Text is normalised to words (A-Z lower-cased; ASCII letters and digits and all other characters form words). The items go
into one automaton over words; a document streams through it, word by word, and the length of the longest match that ends
at each word is tracked. Where it reaches WINDOW words, all words of the match are hit: each window of a match inside an
item is a window of that item. An item of fewer words is one window; it is found as a suffix of the current match. Items
that hold a window are known for each automaton state that a window ends in.

Items are read in shards of about SHARD_WORDS words. A shard's words are broadcast, and each Python worker builds its
automaton from them once. Several shards are passes over the documents one after another, each written down before the next
begins, so driver and workers hold one shard at a time; hits of all shards are united.
"""

from __future__ import annotations

import hashlib
import re
import sys
import uuid
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freed, stored, text_bytes, to_python, unused

WINDOW = 10
SHARD_WORDS = 200_000
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: The same words in the original text, for cutting.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


@dataclass
class Automaton:
    """Generalised suffix automaton of word sequences; state 0 is the root."""

    window: int = WINDOW
    vocabulary: dict = field(default_factory=dict)
    moves: list = field(default_factory=lambda: [{}])
    link: list = field(default_factory=lambda: [0])
    length: list = field(default_factory=lambda: [0])
    items: dict = field(default_factory=dict)  # state of a full window: ids of the items that hold it
    short: dict = field(default_factory=dict)  # state: {words of a short item: ids}

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.moves.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.moves) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of q for the strings that end as p + word does; from there on p's suffixes lead to it."""
        copy = self._state(self.length[p] + 1, dict(self.moves[q]), self.link[q])
        self.link[q] = copy
        while True:
            if self.moves[p].get(word) != q:
                return copy
            self.moves[p][word] = copy
            if not p:
                return copy
            p = self.link[p]

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in (self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words):
            known = self.moves[last].get(word)
            if known is not None:
                last = known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while word not in self.moves[p]:
                self.moves[p][word] = new
                if not p:
                    break
                p = self.link[p]
            else:
                q = self.moves[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
            last = new

    def mark(self, words: list[bytes], item) -> None:
        """Notes the windows of an item that was added; call it when all items are in."""
        size, state = min(self.window, len(words)), 0
        for k, word in enumerate(words):
            state = self.moves[self._suffix(state, size - 1)][self.vocabulary[word]]
            if k >= size - 1:
                at = self._suffix(state, size)
                if size == self.window:
                    self.items.setdefault(at, set()).add(item)
                else:
                    self.short.setdefault(at, {}).setdefault(size, set()).add(item)

    def _suffix(self, state: int, length: int) -> int:
        """The state of the suffix of at most `length` words."""
        while state and self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def ready(self) -> Automaton:
        """Links each state to the nearest suffix that is a short item's end."""
        self.near = [0] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.near[s] = s if s in self.short else self.near[self.link[s]]
        return self

    def hits(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Word intervals [start, end) that windows cover, merged, and the ids of the items whose windows occur."""
        spans: list[list[int]] = []
        found: set = set()
        states: set[int] = set()
        moves, link, length, near, window, any_short = self.moves, self.link, self.length, self.near, self.window, bool(self.short)
        s = n = 0
        ids = map(self.vocabulary.get, words)
        for i, w in enumerate(ids):
            if w is None:
                s = n = 0
                continue
            to = moves[s].get(w)
            while to is None and s:
                s = link[s]
                n = length[s]
                to = moves[s].get(w)
            if to is None:
                n = 0
                continue
            s = to
            n += 1
            start = i + 1
            if n >= window:
                start = i + 1 - n
                states.add(s)
            elif any_short:
                u = near[s]
                while u:
                    for size, items in self.short[u].items():
                        if size <= n:
                            start = min(start, i + 1 - size)
                            found |= items
                    u = near[link[u]]
            if any_short and n >= window:
                u = near[s]
                while u:
                    for size, items in self.short[u].items():
                        if size <= n:
                            found |= items
                    u = near[link[u]]
            if start <= i:
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        for s in states:
            # the last `window` words; earlier windows of the match were ends of matches before
            found |= self.items.get(self._suffix(s, window), set())
        return spans, found


def automata(items: list[tuple], window: int = WINDOW, shard_words: int = SHARD_WORDS) -> list[Automaton]:
    """Automata of (id, text) rows, in shards of at most shard_words words (a longer item is a shard by itself)."""
    shards, part, size = [], [], 0
    for item, text in sorted(items, key=lambda r: (str(r[0]), r[1] or "")):
        words = words_of((text or "").encode("utf-8", "replace"))
        if not words:
            continue
        if part and size + len(words) > shard_words:
            shards.append(part)
            part, size = [], 0
        part.append((item, words))
        size += len(words)
    out = []
    for part in [*shards, part] if part else shards:
        a = Automaton(window)
        for _, words in part:
            a.add(words)
        for item, words in part:
            a.mark(words, item)
        out.append(a.ready())
    return out


def shards_of(items, shard_words: int):
    """Lists of (id, text) rows of at most shard_words words (a longer item is one by itself); items without words go."""
    part, size = [], 0
    for item, text in items:
        n = len(words_of((text or "").encode("utf-8", "replace")))
        if part and size + n > shard_words:
            yield part
            part, size = [], 0
        if n:
            part.append((item, text))
            size += n
    yield part


#: The automaton that this worker built last, with its shard's number.
_built: dict = {}


def _automaton(number: str, items: list[tuple], window: int) -> Automaton:
    if number not in _built:
        _built.clear()
        _built[number] = next(iter(automata(items, window, sys.maxsize)), None) or Automaton(window).ready()
    return _built[number]


def match_benchmark(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS,
    names: tuple[str, str, str] = ("n_words", "hit_spans", "hit_items"),
) -> DataFrame:
    """docs with n_words, hit_spans (merged word intervals [start, end)) and hit_items (ids as strings, sorted).

    Null and empty texts have no words and no hits, items without a word no windows, null item ids no name (they hit, but
    aren't listed). Every row is judged by itself; columns of these names (names: other ones) are replaced. The items are
    the stated test sets; the driver reads them shard by shard, never the documents.
    """
    out = docs.drop(*names)
    out = out.withColumns(dict(zip(names, (F.lit(0).cast("bigint"), F.expr("array()").cast("array<array<bigint>>"), F.expr("array()").cast("array<string>")), strict=True)))
    at, schema = out.columns.index(text), out.schema
    items = benchmark.select(F.col(item_id).cast("string"), item_text).where(F.col(item_text).isNotNull())

    def matched(out: DataFrame, part: list[tuple]) -> DataFrame:
        number = uuid.uuid4().hex
        shared = docs.sparkSession.sparkContext.broadcast(part)  # at most shard_words words

        def run(batches):
            a = _automaton(number, shared.value, window)
            for batch in batches:
                n, spans, found_items = [], batch.column(-2 + batch.num_columns).to_pylist(), batch.column(-1 + batch.num_columns).to_pylist()
                for k, raw in enumerate(text_bytes(batch.column(at))):
                    words = words_of(raw)
                    n.append(len(words))
                    found, ids = a.hits(words)
                    if found:
                        spans[k] = merged([*spans[k], *found])
                        found_items[k] = sorted({*found_items[k], *(x for x in ids if x is not None)})
                kinds = pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *(pa.array(v, t) for v, t in zip((n, spans, found_items), kinds, strict=True))], batch.schema.names)

        return to_python(out).mapInArrow(run, schema)

    last = None
    for part in shards_of(items.toLocalIterator(), shard_words):
        if last is not None:
            before, out = out, stored(matched(out, last))
            freed(before)
        last = [tuple(r) for r in part]
    return matched(out, last)


def merged(spans: list[list[int]]) -> list[list[int]]:
    """The union of intervals, sorted; touching ones are joined."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and out[-1][1] >= start:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def cut(text: str, spans: list[list[int]]) -> str:
    """text without the words of the intervals and what stands between them; a cut leaves one line break."""
    at = [m.span() for m in WORD.finditer(text)]
    parts, last = [], 0
    for start, end in spans:
        parts.append(text[last : at[start][0]].rstrip())
        last = at[end - 1][1]
    parts.append(text[last:].lstrip())
    return "\n".join(x for x in parts if x)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", most_coverage: float = 0.5, n_chars: str | None = None, **options) -> DataFrame:
    """docs without the benchmark: hit spans are cut out of text, and rows of which more than most_coverage is hit go.

    Rows without a hit stay exactly as they are, null and empty texts too. n_chars: a column to set to the new length.
    """
    names = unused(docs, "n_words", "hit_spans", "hit_items")
    n_words, hit_spans, _ = names
    found = match_benchmark(docs, benchmark, text, names=tuple(names), **options)
    hit = F.aggregate(hit_spans, F.lit(0).cast("bigint"), lambda a, s: a + F.get(s, F.lit(1)) - F.get(s, F.lit(0)))
    found = found.where(hit <= F.lit(most_coverage) * F.greatest(n_words, F.lit(1)))
    at, marks = found.columns.index(text), found.columns.index(hit_spans)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for k, spans in enumerate(batch.column(marks).to_pylist()):
                if spans:
                    texts[k] = cut(texts[k], spans)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = to_python(found).mapInArrow(run, found.schema)
    if n_chars:
        out = out.withColumn(n_chars, F.when(F.size(hit_spans) > 0, F.length(text)).otherwise(F.col(n_chars)).cast(docs.schema[n_chars].dataType))
    return out.select(docs.columns)


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = match_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda a, s: a + F.get(s, F.lit(1)) - F.get(s, F.lit(0)))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS n, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), sized AS (
  SELECT item_id, words, least(10, len(words)) AS m FROM b WHERE len(words) > 0
), windows AS (
  SELECT DISTINCT item_id, m, array_to_string(words[i:i + m - 1], ' ') AS w FROM (SELECT item_id, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM sized)
), places AS (
  SELECT n, m, i, array_to_string(words[i:i + m - 1], ' ') AS w
  FROM (SELECT n, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM windows) WHERE len(words) >= m)
), met AS (
  SELECT n, item_id, i, m FROM places JOIN windows USING (m, w)
), hit AS (
  SELECT n, count(DISTINCT i + k) AS n_hit FROM met, range(10) AS t(k) WHERE k < m GROUP BY n
), named AS (
  SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT n, item_id::VARCHAR AS item FROM met) GROUP BY n
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (n) LEFT JOIN named USING (n)
"""
