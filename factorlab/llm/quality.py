"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

Each rule looks at lazily computed statistics of a document. On a bounded sample the planner measures, for every rule, the
time it adds (statistics that chosen rules have already computed are free) and the share of the survivors it rejects;
greedily the rule with most rejections per second comes next. The order decides only how soon a document is rejected and
by which rule; the verdict is the same in any order.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, text_bytes, to_python, windows_of

SPACE = bytes([0x20, *range(9, 14)])
CONTINUED = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
REPEAT_WINDOW = 8
#: Of the planner's sample: about how many documents, and characters of a piece taken at random of a longer text.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 200_000

_hashes = WordHash()


class Doc:
    """A text's statistics, each computed when first asked for."""

    def __init__(self, raw: bytes, known: dict | None = None):
        self.raw, self.known = raw, known or {}

    def __getattr__(self, name: str):
        if name not in STATS:
            raise AttributeError(name)
        if name not in self.known:
            self.known[name] = STATS[name](self)
        return self.known[name]


def _repeat_words(doc: Doc) -> int:
    """Words that lie in a window of 8 words which the text has twice or more."""
    n = len(doc.hashes)
    if n <= REPEAT_WINDOW:
        return 0
    found = windows_of(doc.hashes, REPEAT_WINDOW)
    order = np.argsort(found, kind="stable")
    same = found[order][1:] == found[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(found), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    change = np.zeros(n + 1, np.int64)
    change[np.flatnonzero(twice)] += 1
    change[np.flatnonzero(twice) + REPEAT_WINDOW] -= 1
    return int((np.cumsum(change) > 0).sum())


STATS = {
    "words": lambda d: d.raw.split(),
    "n_words": lambda d: len(d.words),
    "hashes": lambda d: _hashes.array(d.words),
    "word_chars": lambda d: len(d.raw.translate(None, CONTINUED + SPACE)),
    "n_symbols": lambda d: len(d.raw) - len(d.raw.translate(None, SYMBOLS)),
    "n_capitals": lambda d: len(d.raw) - len(d.raw.translate(None, CAPITALS)),
    "lines": lambda d: [x for x in d.raw.split(b"\n") if x.strip()],
    "n_dup_lines": lambda d: len(d.lines) - len(set(d.lines)),
    "n_repeat_words": _repeat_words,
    "n_stutters": lambda d: int((d.hashes[1:] == d.hashes[:-1]).sum()),
}


@dataclass(frozen=True)
class Rule:
    """rejects(doc) is true for a document that must go."""

    name: str
    rejects: object


RULES = (
    Rule("few_words", lambda d: d.n_words < 20),
    Rule("repeated_windows", lambda d: 100 * d.n_repeat_words > 30 * d.n_words),
    Rule("symbols", lambda d: 5 * d.n_symbols > d.n_words),
    Rule("capitals", lambda d: 2 * d.n_capitals > d.word_chars),
    Rule("duplicate_lines", lambda d: 10 * d.n_dup_lines > 6 * len(d.lines)),
    Rule("stutters", lambda d: 4 * d.n_stutters > d.n_words),
    Rule("word_length", lambda d: d.word_chars < 2 * d.n_words or d.word_chars > 15 * d.n_words),
)
BASE_RULES = ("few_words", "repeated_windows")


def planned(sample: list[bytes], rules=RULES) -> list[Rule]:
    """rules in the order of rejections per second on the survivors of those before; ties keep the given order."""
    rest, order, alive = list(rules), [], [Doc(x) for x in sample]
    while rest:
        scores = []
        for rule in rest:
            copies = [Doc(d.raw, dict(d.known)) for d in alive]
            began = time.process_time()
            rejected = sum(bool(rule.rejects(d)) for d in copies)
            scores.append((rejected / (time.process_time() - began + 1e-7), rule))
        best = max(scores, key=lambda x: x[0])[1]
        alive = [d for d in alive if not best.rejects(d)]
        order.append(best)
        rest.remove(best)
    return order


def plan_cascade(docs: DataFrame, text: str = "text", rules=RULES) -> list[Rule]:
    """The order for a random sample of about SAMPLE_DOCS of all rows (an empty one keeps the given order).

    Of a text longer than SAMPLE_CHARS a piece at a random place is taken. The sample decides nothing but the order.
    """
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    start = F.floor(F.rand(8) * F.greatest(F.length(text) - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    near = docs.select(text).where(F.col(text).isNotNull()).where(F.rand(7) < share).select(F.substring(F.col(text), start, F.lit(SAMPLE_CHARS)))
    return planned([r[0].encode("utf-8", "replace") for r in near.collect()], rules)


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by.

    rejected_by names the first rule of the planned order that rejects (null: kept). As the counts are asked for, they are
    computed for every row; only filter_quality() saves what the short circuit saves. Null and empty texts have no words
    and are rejected. Rows with the same id are judged each by itself; other columns of docs are not read.
    """
    order = [(r.name, rules.index(r)) for r in plan_cascade(docs, text, rules)]
    kind = docs.schema[id_col].dataType.simpleString()
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches):
        cascade = [(name, rules[k].rejects) for name, k in order]
        base = [r.rejects for r in rules if r.name in BASE_RULES]
        for batch in batches:
            rows = {c: [] for c in (*counts, "base_failed", "kept", "rejected_by")}
            for raw in text_bytes(batch.column(1)):
                d = Doc(raw)
                first = next((name for name, rejects in cascade if rejects(d)), None)
                failed = any(rejects(d) for rejects in base)
                for c in counts:
                    rows[c].append(getattr(d, c))
                rows["base_failed"].append(failed)
                rows["kept"].append(first is None and not failed)
                rows["rejected_by"].append(first)
            types = [pa.int64()] * len(counts) + [pa.bool_(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(rows.values(), types, strict=True))], [id_col, *rows])

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} bigint" for c in counts) + ", base_failed boolean, kept boolean, rejected_by string"
    return to_python(docs.select(id_col, text)).mapInArrow(run, schema)


def filter_quality(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of docs, all columns, that no rule rejects; each row stops at the first rule that rejects it.

    Null texts count as empty; texts of any length are judged whole, rows that repeat each; nothing is added, so no name can
    clash; no rows give none.
    """
    order = [rules.index(r) for r in plan_cascade(docs, text, rules)]
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            keep = [not any(rules[k].rejects(d) for k in order) for d in map(Doc, text_bytes(batch.column(at)))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return to_python(docs).mapInArrow(run, docs.schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge_quality(docs).drop("rejected_by")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), stats AS (
  SELECT doc_id, n, text, words, lines, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_stutters
  FROM d
), windows AS (
  SELECT n, i, array_to_string(words[i:i + 7], ' ') AS w FROM (SELECT n, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)
), twice AS (
  SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, w) AS c FROM windows) WHERE c > 1
), repeated AS (
  SELECT n, count(DISTINCT i + k) AS r FROM twice, range(8) AS t(k) GROUP BY n
), judged AS (
  SELECT *, coalesce(r, 0) AS n_repeat_words, n_words < 20 OR 100 * coalesce(r, 0) > 30 * n_words AS base_failed FROM stats LEFT JOIN repeated USING (n)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR 5 * n_symbols > n_words OR 2 * n_capitals > word_chars OR 10 * n_dup_lines > 6 * len(lines)
            OR 4 * n_stutters > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM judged
"""
