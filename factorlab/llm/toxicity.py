"""Toxicity by non-negative positive-unlabelled learning.

A linear numpy classifier is trained from confirmed toxic examples (P) and unlabelled text (U). With class prior pi and
the logistic loss l, the risk is  pi * E_P[l(z)] + max(0, E_U[l(-z)] - pi * E_P[l(-z)]):  the second term estimates the
risk on the clean part of U, which can't be negative; where its estimate falls below zero the step goes against it, which
keeps the classifier from memorising P. Features are hashed words, their beginnings and byte n-grams; what counts is whether
a text has them, not how often, so one insult in a long text weighs as much as in a short one. Only features are used that P's
texts have more often than U's, by odds and beyond chance. Words end at ASCII that is no letter or digit and at Unicode's
spaces; longer ones, as in unspaced scripts, are read in pieces that share no n-gram and leave none out, each counting as a
word, so every byte of a text reaches its score. Two numbers (slope and offset) are then fitted on labelled rows that were not
in P or U, clean ones too: this supervised calibration is outside the positive-unlabelled risk and can be left out; it only
lets a score read as a probability.

The sample is written to the shared folder, one text an id. A first pass counts each feature's texts on the executors, a
second brings the SELECTED features alone, so the driver holds at most rows * SELECTED places however long the texts are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freed, stored, text_bytes, to_python

#: Most rows of each kind that are learned from, as train_toxicity() takes them; the bound on what the driver holds.
POSITIVE, UNLABELLED, CALIBRATION = 2000, 5000, 2500
DIMENSIONS, PREFIXES, GRAM = 1 << 18, (4, 5, 6, 7, 8), 5
#: Features that the classifier may use: so many at most of those whose share of P's texts exceeds that of U's by so much in
#: log odds and in standard errors.
SELECTED, LEAST_ODDS, LEAST_ERRORS = 8000, 0.5, 1.7
#: Most steps, and the change of the risk over SETTLED steps, relative to it, at which training ends.
STEPS, SETTLED, CHANGE = 1600, 100, 1e-3
TOXIC_AT = 0.7

#: A-Z to a-z; other ASCII that is no letter or digit to a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

#: Spaces and line ends beyond ASCII: U+0085, 00A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000.
_SPACES = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Bytes of a word, or of a piece of a longer one.
PIECE = 64


def features(word: bytes) -> list[int]:
    """Hashed features of a word: itself, its beginnings and its byte n-grams, with its ends marked.

    A piece of a longer word has a space where the word goes on: it has the n-grams, and the beginnings if it is the first.
    """
    first, last = word[:1] != b" ", word[-1:] != b" "
    marked = b"<" * first + word.strip(b" ") + b">" * last
    grams = {marked[i : i + GRAM] for i in range(int(first), len(marked) - GRAM + 1)}
    if first:
        grams |= {marked[:n] for n in PREFIXES}
    if first and last:
        grams.add(marked)
    return [xxhash.xxh32_intdigest(g) & (DIMENSIONS - 1) for g in grams]


def pieces(word: bytes) -> list[bytes]:
    """A word, or pieces of PIECE bytes of a longer one, each n-gram lying in one of them."""
    if len(word) <= PIECE:
        return [word]
    starts = range(0, len(word) - GRAM + 1, PIECE - GRAM + 1)
    return [b" " * (s > 0) + word[s : s + PIECE] + b" " * (s + PIECE < len(word)) for s in starts]


def words_of(raw: bytes) -> list[bytes]:
    words = (raw if raw.isascii() else _SPACES.sub(b" ", raw)).translate(_TABLE).split()
    return [p for w in words for p in pieces(w)] if max(map(len, words), default=0) > PIECE else words


class _Remembered(dict):
    limit = 300_000

    def __init__(self, make):
        self.make = make

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = self.make(word)
        return value


def held_out(doc_id: str) -> Column:
    """Rows that nothing is learned from; null for a null id, which isn't learned from either."""
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3) == 1


def _sampled(docs: DataFrame, labels: DataFrame, id_col: str, positive: int = POSITIVE, unlabelled: int = UNLABELLED, calibration: int = CALIBRATION) -> DataFrame:
    """Ids with their role (p, u or c), bounded by the three numbers; the smallest hashes are taken."""
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    kept_out = F.floor(crc / 3) % 5 == 0
    some = lambda df, n, role: df.orderBy(F.xxhash64(id_col), id_col).limit(n).select(id_col, F.lit(role).alias("role"), *([F.col("toxic")] if role == "c" else [F.lit(None).cast("int").alias("toxic")]))
    marked = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(id_col).agg(F.max("toxic").cast("int").alias("toxic")).where(crc % 3 != 1)
    p = some(marked.where((F.col("toxic") == 1) & ~kept_out), positive, "p")
    c = some(marked.where(kept_out), calibration, "c")
    u = some(docs.select(id_col).where(F.col(id_col).isNotNull() & (crc % 3 != 1) & ~kept_out).distinct(), unlabelled, "u")
    return p.unionByName(c).unionByName(u)


def present(raw: bytes, known: _Remembered) -> np.ndarray:
    """The features that a text has, in order; known gives those of a word. Memory follows the text's distinct words."""
    found: set[int] = set()
    for word in set(words_of(raw)):
        found.update(known[word])
    return np.fromiter(sorted(found), np.int32, len(found))


def _sample_table(docs: DataFrame, wanted: DataFrame, id_col: str, text: str) -> DataFrame:
    """(role, toxic, text) of the wanted documents, written down; of an id's several texts the least is taken."""
    # wanted is bounded by the numbers given to _sampled()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(wanted.withColumnRenamed(id_col, "id")), "id")
    return stored(rows.groupBy("id", "role", "toxic").agg(F.min("text").alias("text")).select("role", "toxic", "text"))


def contrasted(sample: DataFrame, n_positive: int, n_unlabelled: int, selected: int = SELECTED) -> np.ndarray:
    """The features that more of P's texts have than of U's: at most `selected`, those furthest beyond chance."""

    def counts(batches):
        known, n = _Remembered(features), np.zeros((2, DIMENSIONS), np.int64)
        for batch in batches:
            for role, raw in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                n[0 if role == "p" else 1, present(raw, known)] += 1
        used = np.flatnonzero(n.any(axis=0))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(x[used]) for x in n)], ["f", "p", "u"])

    rows = to_python(sample.where("role <> 'c'").select("role", "text")).mapInArrow(counts, "f bigint, p bigint, u bigint")
    table = rows.groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).orderBy("f").toPandas()  # at most DIMENSIONS rows
    if not len(table):
        return np.zeros(0, np.int32)
    f, p, u = (table[c].to_numpy(float) for c in ("f", "p", "u"))
    odds = np.log((p + 0.5) / (n_positive + 1)) - np.log((u + 0.5) / (n_unlabelled + 1))
    p, u = p / n_positive, u / n_unlabelled
    errors = (p - u) / np.sqrt(p * (1 - p) / n_positive + u * (1 - u) / n_unlabelled + 1e-12)
    fit = np.flatnonzero((odds > LEAST_ODDS) & (errors > LEAST_ERRORS))
    return np.sort(f[fit[np.lexsort((f[fit], -errors[fit]))][:selected]]).astype(np.int32)


def _vectors(sample: DataFrame, use: np.ndarray):
    """(roles, toxic, number of features in use a row, their places in use) of the sample's rows."""

    def run(batches):
        known = _Remembered(features)
        for batch in batches:
            ids = []
            for raw in text_bytes(batch.column(2)):
                i = present(raw, known)
                ids.append(np.searchsorted(use, i[np.isin(i, use)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["role", "toxic", "ids"])

    table = to_python(sample).mapInArrow(run, "role string, toxic int, ids array<int>").toArrow()
    ids = table.column("ids").combine_chunks()
    return np.array(table.column("role").to_pylist(), "U1"), np.array([x or 0 for x in table.column("toxic").to_pylist()]), np.diff(np.asarray(ids.offsets)), np.asarray(ids.flatten())


def risk(z: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """(prior * E_P[l(z)], E_U[l(-z)] - prior * E_P[l(-z)], the gradient of the step by z); positive: mask of P, others are U."""
    p, u = positive, ~positive
    toxic, s = np.logaddexp(0, z), 1 / (1 + np.exp(-np.clip(z, -40, 40)))  # l(-z): what it costs to call a clean row toxic
    clean = toxic[u].mean() - prior * toxic[p].mean()
    g = np.zeros(len(z))
    if clean >= 0:
        g[p], g[u] = -prior / p.sum(), s[u] / u.sum()  # l'(z) - (-l)'(-z) is -1 for every row of P
    else:  # step against the term below zero
        g[p], g[u] = prior * s[p] / p.sum(), -s[u] / u.sum()
    return prior * float(np.logaddexp(0, -z[p]).mean()), float(clean), g


def nnpu(lengths: np.ndarray, ids: np.ndarray, positive: np.ndarray, prior: float, steps: int = STEPS, l2: float = 1e-5, rate: float = 0.05, dimensions: int = DIMENSIONS):
    """Weights and offset of the linear classifier of rows with the features ids (lengths: how many a row), by Adam's steps
    until the risk settles; positive: mask of the rows of P, the others are U."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    w, b = np.zeros(dimensions), -float(np.log(1 / max(prior, 1e-6) - 1))
    m, v, mb, vb, before = np.zeros(dimensions), np.zeros(dimensions), 0.0, 0.0, np.inf
    for t in range(1, steps + 1):
        z = np.bincount(row, w[ids], len(lengths)) + b
        own, clean, g = risk(z, positive, prior)
        if t % SETTLED == 0:
            now = own + max(0.0, clean)
            if abs(before - now) <= CHANGE * now:
                break
            before = now
        gw, gb = np.bincount(ids, g[row], dimensions) + l2 * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, b


def calibrated(z: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope (above 0) and offset of a logistic curve through labelled rows, by Newton steps; the plain logit without both labels."""
    if len(set(toxic.tolist())) < 2:
        return 1.0, 0.0
    scale = max(z.std(), 1e-9)
    x, a, y = np.stack([(z - z.mean()) / scale, np.ones(len(z))]), np.array([1.0, 0.0]), toxic.astype(float)
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(a @ x, -30, 30)))
        h = (x * (s * (1 - s) + 1e-9)) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x @ (s - y) + 1e-3 * a)
        a = a - step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
    slope = max(a[0], 1e-3) / scale
    return float(slope), float(a[1] - slope * z.mean())


def train_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", prior: float | None = None, *, positive: int = POSITIVE, unlabelled: int = UNLABELLED, calibration: int = CALIBRATION, calibrate: bool = True
):
    """Weights and offset of the score's logit. Without any positive example: weights 0 and a low offset.

    Labels are read only of rows whose crc32(id as text) mod 3 is not 1. prior: the share of toxic text; None takes the
    share among the calibration rows. positive, unlabelled, calibration: most rows of each kind that are learned from.
    calibrate: False keeps the positive-unlabelled logit as it is. Rows that repeat an id give its least text; a null id or
    label isn't learned from; null texts count as empty. Columns beside those named aren't read.
    """
    sample = _sample_table(docs, _sampled(docs, labels, id_col, positive, unlabelled, calibration), id_col, text)
    n = {r["role"]: r["count"] for r in sample.groupBy("role").count().collect()}
    if "p" not in n or "u" not in n:
        freed(sample)
        return np.zeros(DIMENSIONS), -5.0
    use = contrasted(sample, n["p"], n["u"])
    roles, toxic, lengths, ids = _vectors(sample, use)
    freed(sample)
    c = roles == "c"
    prior = prior or min(0.5, max(0.005, float(toxic[c].mean()) if c.any() else 0.05))
    train = np.repeat(~c, lengths)
    small, b = nnpu(lengths[~c], ids[train], roles[~c] == "p", prior, dimensions=max(1, len(use)))
    slope, offset = 1.0, 0.0
    if calibrate and c.any():
        z = np.bincount(np.repeat(np.arange(c.sum()), lengths[c]), small[ids[~train]], c.sum()) + b
        slope, offset = calibrated(z, toxic[c])
    w = np.zeros(DIMENSIONS)
    w[use] = small[: len(use)]
    return w * slope, b * slope + offset


def score_toxicity(docs: DataFrame, weights: np.ndarray, offset: float, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, score (0 to 1), predicted (1 from TOXIC_AT on). Null and empty texts get the score of no word at all; rows
    that repeat, or have a null id, are scored each; columns beside those named aren't read; no rows give none."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))  # DIMENSIONS numbers, whatever the corpus

    def run(batches):
        w = shared.value.astype(float)
        used = set(np.flatnonzero(w).tolist())
        known = _Remembered(lambda word: tuple(f for f in features(word) if f in used))
        for batch in batches:
            z = np.array([w[present(raw, known)].sum() for raw in text_bytes(batch.column(1))], float) + offset
            score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= TOXIC_AT).astype(np.int32))], [id_col, "score", "predicted"])

    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return to_python(docs.select(id_col, text)).mapInArrow(run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weights, offset = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return score_toxicity(docs, weights, offset).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
