"""Language identification by cross-parsing entropy against suffix automata of labelled text.

For each language a suffix automaton of normalised sample text is built. A text is parsed into phrases, each the longest
match found in a language's sample; few phrases mean that the text looks like the sample. The number of phrases times the
bits that one costs (log2 of the sample's length), per character, estimates the cross-entropy; the least one wins.

Every symbol of a language's sample has a code of its own there; a symbol that the sample lacks is a phrase by itself.
Parsing starts again at the root after each phrase, so the automaton is used as a table of moves in which a failing move
already holds its restart; samples of more than SYMBOLS symbols have a sparse table. A whole text is one parse. For speed it
is cut into runs of RUN characters that step through the tables side by side in numpy: first all from the root, then
again, each from the state in which the run before it ended, until no end changes; a state soon forgets where it began.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import to_python

#: Documents of a language that are learned from, characters of the piece that is taken of each, and the number of
#: languages beyond which learning is refused; they bound what the driver holds and what is broadcast.
SAMPLE_DOCS, PIECE_CHARS, MOST_LANGUAGES = 150, 160, 2000
RUN, TOGETHER = 256, 1_500_000
#: Most codes of a dense table of moves.
SYMBOLS = 64
RESTART = np.int32(1 << 30)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


@functools.cache
def letters() -> np.ndarray:
    """Lower-case form of each code point that is a letter, 0 of others; forms of several characters keep the first."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
    return out


def normalised(points: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Lower-case letters; each run of other characters is one space."""
    out = lower[points]
    space = out == 0
    out[space] = 32
    return out[~(space & np.concatenate([[False], space[:-1]]))]


def suffix_automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Moves of each state of the suffix automaton of codes; the root comes first."""
    moves, link, length, last = [{}], [-1], [0], 0
    for c in codes.tolist():
        new, p = len(moves), last
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


class Dense:
    """The automaton's moves with restarts: a missing move goes where the root goes, marked as a new phrase.

    Codes are 1 to width - 2 for the sample's symbols, width - 1 for all others; 0 is padding and stays in its state.
    """

    def __init__(self, moves: list[dict[int, int]], width: int):
        self.width = width
        root = np.zeros(width, np.int32)
        root[list(moves[0])] = list(moves[0].values())
        out = np.tile(root | RESTART, (len(moves), 1))
        for state, to in enumerate(moves):
            out[state, list(to)] = list(to.values())
        out[:, 0] = np.arange(len(out))
        self.moves = out.ravel()

    def step(self, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.moves[at * self.width + row]


class Sparse:
    """The same for many symbols: each state's first move by itself, the further ones by search."""

    def __init__(self, moves: list[dict[int, int]], width: int):
        self.width = width
        root = np.zeros(width, np.int32)
        root[list(moves[0])] = list(moves[0].values())
        self.missing = root | RESTART
        self.root = np.where(root > 0, root, RESTART)
        self.code, self.target, self.many = np.full(len(moves), -1, np.int32), np.zeros(len(moves), np.int32), np.zeros(len(moves), bool)
        keys, values = [-1], [0]
        for state, to in enumerate(moves):
            if state and to:
                self.code[state], self.target[state] = next(iter(to.items()))
                self.many[state] = len(to) > 1
                for c in sorted(to) if len(to) > 1 else ():
                    keys.append(state * width + c)
                    values.append(to[c])
        self.keys, self.values = np.array(keys, np.int64), np.array(values, np.int32)

    def step(self, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        first = self.code[at] == row
        to = np.where(at == 0, self.root[row], np.where(first, self.target[at], self.missing[row]))
        more = np.flatnonzero(self.many[at] & ~first)
        if len(more):
            wanted = at[more] * self.width + row[more]
            found = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hit = self.keys[found] == wanted
            to[more[hit]] = self.values[found[hit]]
        return np.where(row == 0, at, to)


class Model:
    """Languages, their tables, and the symbols of all samples together."""

    def __init__(self, samples: dict[str, list[str]]):
        lower = letters()
        texts = {k: normalised(code_points("\n".join(samples[k])), lower) for k in sorted(samples)}
        texts = {k: v for k, v in texts.items() if len(v)}
        self.symbols = np.unique(np.concatenate([*texts.values(), np.array([32], np.uint32)]))
        self.languages = list(texts)
        code = self.codes()
        self.own, self.tables = [], []
        for v in texts.values():
            known = np.unique(code[v])
            own = np.full(len(self.symbols) + 2, len(known) + 1, np.int64)  # a symbol's code in this language
            own[known], own[0] = np.arange(1, len(known) + 1), 0
            self.own.append(own)
            self.tables.append((Dense if len(known) + 2 <= SYMBOLS else Sparse)(suffix_automaton(own[code[v]]), len(known) + 2))
        self.bits = [float(np.log2(len(v) + 1)) for v in texts.values()]

    def codes(self) -> np.ndarray:
        """Code of each code point: 1 on for the symbols of any sample, the one after them for all others."""
        other = len(self.symbols) + 1
        out = np.full(0x110000, other, np.min_scalar_type(other))
        out[self.symbols] = np.arange(1, other)
        return out

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases that each text (codes) needs, by language; an empty one needs none."""
        parts = np.array([-(-len(t) // RUN) for t in texts], np.int64)
        flat, first = np.zeros(int(parts.sum()) * RUN, np.int64), np.cumsum(parts) - parts
        for t, k in zip(texts, first.tolist(), strict=True):
            flat[k * RUN : k * RUN + len(t)] = t
        runs, owner = flat.reshape(-1, RUN), np.repeat(np.arange(len(texts)), parts)
        inner = np.ones(len(owner) + 1, bool)  # runs that another one of their text precedes
        inner[first[parts > 0]] = inner[-1] = False
        out = np.zeros((len(self.tables), len(texts)), np.int64)
        for k, (own, moves) in enumerate(zip(self.own, self.tables, strict=True)):
            counts, begin, end = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
            todo = np.arange(len(owner))
            while len(todo):
                for some in np.array_split(todo, -(-len(todo) // 8192)):
                    counts[some], end[some] = self._parsed(moves, own, runs[some].T, begin[some])
                after = todo[inner[todo + 1]] + 1
                todo = after[begin[after] != end[after - 1]]
                begin[todo] = end[todo - 1]
            out[k] = np.bincount(owner, counts, len(texts))
        return out + (parts > 0)  # the phrase that is open at the end

    @staticmethod
    def _parsed(moves, own: np.ndarray, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(restarts, last state) of runs (columns of codes) that begin in the states at."""
        n = np.zeros(rows.shape[1], np.int64)
        for row in np.ascontiguousarray(own[rows]):
            to = moves.step(at, row)
            n += to >= RESTART
            at = (to & (RESTART - 1)).astype(np.int64)
        return n, at

    def judge(self, texts: list[str | None], lower: np.ndarray, code: np.ndarray):
        """(language or und, score, whether it has a letter) of each text; memory follows TOGETHER, not the number of texts."""
        for texts_now in _grouped(texts):
            rows = [normalised(code_points(t), lower) if t else np.zeros(0, np.uint32) for t in texts_now]
            rows = [r if (r != 32).any() else r[:0] for r in rows]  # no letter
            counts = self.phrases([code[r] for r in rows])
            cost = counts * np.array(self.bits)[:, None] / np.maximum(1, np.array([len(r) for r in rows]))
            best = cost.argmin(axis=0) if len(cost) else np.zeros(len(rows), int)
            # share of the best under weights 2^-(bits), of at most 40 characters, so that long texts keep a scale
            weigh = np.exp2(-(cost - cost.min(axis=0, initial=np.inf)) * np.minimum(40, [max(1, len(r)) for r in rows]))
            share = 1 / np.maximum(1.0, weigh.sum(axis=0))
            for r, b, s in zip(rows, best, share, strict=True):
                yield (self.languages[b], float(s), True) if len(r) and self.languages else ("und", 0.0, len(r) > 0)


def _grouped(texts: list[str | None]):
    """texts in consecutive groups of about TOGETHER characters."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size > TOGETHER:
            yield group
            group, size = [], 0
    if group:
        yield group


def held_out(id_col: str) -> Column:
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 3) == 1


def learn_languages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """The model of a bounded sample: per language up to sample_docs documents, those of smallest hash, and of each a piece
    of PIECE_CHARS characters at a place that its hash chooses (a shorter text is taken whole).

    Only rows with text, id and lang, and whose crc32(id as text) mod 3 is not 1, are learned from. Without any, all texts
    are und. All languages are learned; more than MOST_LANGUAGES of them are an error. Counts per language choose a hash
    limit first, so no language's rows have to be sorted.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = rows.groupBy("lang").count()
    n = counts.count()
    if n > MOST_LANGUAGES:
        raise ValueError(f"{n} languages; MOST_LANGUAGES bounds the model")
    if not n:
        return Model({})
    hashed = F.xxhash64("id", F.lit("language sample"))
    near = rows.join(F.broadcast(counts), "lang").where(F.pmod(hashed, F.lit(1_000_000)) * F.col("count") < 3_000_000 * sample_docs)  # counts: MOST_LANGUAGES rows
    start = F.pmod(F.xxhash64("id", F.lit("place")), F.greatest(F.length("text") - PIECE_CHARS + 1, F.lit(1))).cast("int") + 1
    pieces = near.select("lang", F.substring(F.col("text"), start, F.lit(PIECE_CHARS)).alias("text"), hashed.alias("key"))
    sample = pieces.withColumn("k", F.row_number().over(_by("lang"))).where(F.col("k") <= sample_docs).orderBy("lang", "k").collect()  # n * sample_docs pieces
    chosen: dict[str, list[str]] = {}
    for r in sample:
        chosen.setdefault(r["lang"], []).append(r["text"])
    return Model(chosen)


def _by(lang: str):
    from pyspark.sql import Window

    return Window.partitionBy(lang).orderBy("key", "text")


def identify(docs: DataFrame, model: Model, text: str = "text", letter: str | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred (und: null text, no letter, or a model without languages) and score (0 to 1); columns of these
    names (names: other ones) are replaced. letter: name of a further column that tells whether the text has a letter,
    whatever the model.

    Each whole text is parsed; ties go to the language first in order.
    """
    out = docs.drop(*names, *([letter] if letter else []))
    at = out.columns.index(text)
    new = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), *([T.StructField(letter, T.BooleanType())] if letter else [])]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_LANGUAGES * SAMPLE_DOCS * PIECE_CHARS

    def run(batches):
        m = shared.value
        lower, code = letters(), m.codes()
        for batch in batches:
            found = list(m.judge(batch.column(at).to_pylist(), lower, code))
            told = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *told[: len(new)]], [*batch.schema.names, *(f.name for f in new)])

    return to_python(out).mapInArrow(run, T.StructType([*out.schema.fields, *new]))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = learn_languages(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
