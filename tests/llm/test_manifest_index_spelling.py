"""The manifest, the nearest neighbours and the spelling variants against brute force, and on odd input."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import SF  # noqa: E402

from factorlab.llm import merkle, multiindex, spelling  # noqa: E402

# ---------------------------------------------------------------- op 11


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def written(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def manifest_of(rows):
    """rows (id, group, leaf, other) -> Counter of (id, leaf, subroot, root, proof, folded, verified)."""
    out = Counter()
    order = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    groups = sorted({r[1] for r in rows}, key=order)
    members = {g: sorted((r for r in rows if r[1] == g), key=lambda r: (order(r[0]), r[2])) for g in groups}
    trees = {g: tree([r[2] for r in members[g]]) for g in groups}
    top = tree([trees[g][-1][0] for g in groups]) if groups else None
    for place, g in enumerate(groups):
        for i, r in enumerate(members[g]):
            folded, proof = r[3], ""
            for levels, k in ((trees[g], i), (top, place)):
                for nodes in levels[:-1]:
                    run = nodes[k // 8 * 8 : k // 8 * 8 + 8]
                    left, right = "".join(run[: k % 8]), "".join(run[k % 8 + 1 :])
                    folded, proof, k = digest(left, folded, right), proof + left + right, k // 8
            out[r[0], r[2], trees[g][-1][0], top[-1][0], digest(proof), folded, folded == top[-1][0]] += 1
    return out


MADE = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_manifest_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for group, n in ((None, 9), ("", 1), ("a", 70), ("b", 8), ("Z", 65), ("é", 2), *((f"g{k:02d}", rng.randint(1, 3)) for k in range(70))):
        for _ in range(n):
            leaf = digest(str(rng.random()))
            rows.append((rng.choice([None, *range(-3, 60)]), group, leaf, leaf if rng.random() < 0.7 else digest("other")))
    rows += [(5, "a", digest("same"), digest("same"))] * 20
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id int, lang string, first string, second string, `a.b` string").repartition(7)
    got = merkle.manifest(df, F.col("first"), other=F.col("second"))
    assert got.columns == ["doc_id", "lang", "first", "second", "a.b", *MADE]
    assert Counter(tuple(r) for r in got.select("doc_id", *MADE).collect()) == manifest_of(rows)


def test_manifest_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    made = []
    for r in rows:
        tampered = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        text = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]) if tampered and r["text"] is not None else r["text"]
        made.append((r["doc_id"], r["lang"], digest(*map(written, r)), digest(*map(written, (*r[:4], text)))))
    assert Counter(tuple(r) for r in merkle.op11_merkle_manifest(spark, SF).collect()) == manifest_of(made)


def test_manifest_of_odd_tables(spark):
    schema = "doc_id int, lang string, Leaf string, row string, hash string, g int, at int"
    none = spark.createDataFrame([], schema)
    assert merkle.manifest(none, F.lit("00")).count() == 0
    one = merkle.manifest(spark.createDataFrame([(None, None, "old", "r", "h", 1, 2)], schema), F.lit("ab"))
    assert one.columns == ["doc_id", "lang", "row", "hash", "g", "at", *MADE]
    r = one.first()
    assert (r["leaf"], r["subroot"], r["root"], r["folded_root"], r["verified"], r["row"], r["at"]) == ("ab", "ab", "ab", "ab", True, "r", 2) and r["proof_sha256"] == digest("")
    assert spark.range(1).select(merkle.encoded(F.lit("é")).alias("a"), merkle.encoded(F.lit(None).cast("string")).alias("b"), merkle.encoded(F.lit(-12)).alias("c"), merkle.encoded(F.lit("")).alias("d")).first()[:] == ("2:é", "-", "3:-12", "0:")


# ---------------------------------------------------------------- op 12


def neighbours(vectors, query, k):
    """(id, score) of the k nearest rows (id, vector) of other ids."""
    q = next(v for i, v in sorted(((i, tuple(v)) for i, v in vectors), key=lambda x: x[1]) if i == query)
    seen = {(i, tuple(v)) for i, v in vectors if i != query}
    return sorted(((i, float(np.dot(np.array(v, float), np.array(q, float)))) for i, v in seen), key=lambda x: (-x[1], x[0]))[:k]


def test_neighbours_in_a_small_table_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5)]) for i in range(150)]
    rows = [(i, v) for i, v in rows if any(v)]
    copies = [(1000 + i, [1.0, 2.0, 0.0, 0.0, -1.0]) for i in range(60)]
    odd = [(200, None), (220, []), (240, [0.0] * 5), (260, [1.0, None, 0.0, 0.0, 0.0]), (280, [float("nan"), 1.0, 0.0, 0.0, 0.0]), (300, [float("inf"), 1.0, 0.0, 0.0, 0.0]), (320, [1.0, 2.0]), (None, [1.0] * 5)]
    frame = spark.createDataFrame(rows + copies + odd + copies[:5], "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).repartition(5)
    got = defaultdict(list)
    for r in multiindex.nearest(frame, F.col("id") % 20 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i, _ in rows + copies if i % 20 == 0}
    for q, found in got.items():
        want = neighbours(rows + copies, q, 20)
        assert [(k, i) for k, i, _ in sorted(found)] == [(k + 1, i) for k, (i, _) in enumerate(want)]
        assert np.allclose([s for _, _, s in sorted(found)], [s for _, s in want], atol=1e-12)


def test_neighbours_when_there_are_few(spark):
    schema = "vec_id int, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0])], schema)
    got = sorted(tuple(r) for r in multiindex.nearest(few, F.col("id") % 20 == 0).collect())
    assert got == [(0, 1, 3, 1.0), (0, 2, 20, 0.0), (20, 1, 3, 1.0), (20, 2, 0, 0.0)]
    for rows in ([], [(0, None)], [(0, [0.0])]):
        assert multiindex.nearest(spark.createDataFrame(rows, schema), F.col("id") % 20 == 0).count() == 0
    assert multiindex.nearest(spark.createDataFrame([(20, [1.0])], schema), F.col("id") % 20 == 0).count() == 0
    assert multiindex.nearest(few, F.col("id") % 7 == 5).count() == 0
    several = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 3.0]), (0, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 2.0])], schema)
    got = multiindex.nearest(several, F.col("id") == 0, k=2).collect()
    assert {r["vec_id"] for r in got} == {1, 2} and len(got) == 2


@pytest.mark.parametrize("shape", ["sphere", "clusters", "norms"])
def test_neighbours_are_found(spark, shape):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    if shape == "clusters":
        x = rng.normal(size=(12, 16))[rng.integers(0, 12, 3000)] * 3 + x
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * (rng.uniform(0.2, 3, (3000, 1)) if shape == "norms" else 1)
    x = x.astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in multiindex.nearest(frame, F.col("id") % 20 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
        assert abs(r["score"] - float(x[r["query_id"]].astype(float) @ x[r["vec_id"]].astype(float))) < 1e-12
    scores = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(scores, -np.inf)
    hit = [len(got[q] & set(np.argsort(-scores[q], kind="stable")[:20].tolist())) for q in range(0, 3000, 20)]
    assert all(len(got[q]) == 20 for q in range(0, 3000, 20)) and sum(hit) / (20 * len(hit)) >= 0.9


def test_traversal_and_units():
    rng = np.random.default_rng(4)
    model = multiindex.Model((rng.normal(size=(5, 3)), rng.normal(size=(4, 2))), np.dtype(float), rng.integers(0, 30, 20))
    for _ in range(20):
        q, reach = rng.normal(size=5), int(rng.integers(1, 400))
        one, two = model.distances(q)
        sums = np.add.outer(one, two).ravel()
        last, cells = model.visited(q, reach)
        order = [c for c in np.argsort(sums, kind="stable") if model.counts[c]]
        need = next((k + 1 for k in range(len(order)) if model.counts[order[: k + 1]].sum() >= reach), len(order))
        assert cells == order[:need] and (last == sums[cells[-1]] or need == len(order))
    model.counts = np.array([0, 5000, 3, 9000, 4096, 1, 1] + [2000] * 13)
    model.packed()
    held = Counter()
    for cell, n in enumerate(model.counts):
        for k in range(n):
            held[model.unit[cell] + k % model.units[cell]] += 1
    assert max(held.values()) <= multiindex.UNIT and sum(held.values()) == model.counts.sum()


# ---------------------------------------------------------------- op 13


def spelling_of(counts, ratio=10):
    near, by_hole = {w: set() for w in counts}, defaultdict(list)
    for w in counts:
        for k in range(len(w)):
            by_hole[k, w[:k] + w[k + 1 :]].append(w)
            if (d := w[:k] + w[k + 1 :]) in near:
                near[w].add(d)
                near[d].add(w)
    for group in by_hole.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    form = {w: min(near[w], key=lambda x: (-counts[x], x), default=None) for w in counts}
    form = {w: f if f is not None and counts[f] >= ratio * counts[w] else None for w, f in form.items()}
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), form[w] and counts[form[w]])
    return out


def words_of(docs):
    total = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            total[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in total.items() if n >= 2 and len(w) >= 7}


def test_spelling_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.op13_spelling_variants(spark, SF).collect()}
    assert got == spelling_of(words_of(docs))


def test_words_of_odd_texts(spark):
    long = "ab" * 40_000
    docs = [(1, "Straße STRASSEN× Ärzteblatt÷ naïveté"), (1, "STRASSEN× x"), (None, "strassen× " * 3), (2, None), (3, ""), (4, long + " " + long), (5, "ÀÉÎÕÜÝÞ " * 2), (6, "abcdefg123abcdefg_hijklmn hijklmn"), (7, "퟿😀abcdefgh abcdefgh")]
    df = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id int, text string, n int")
    got = {r["word"]: r["n"] for r in spelling.word_counts(df).collect()}
    assert got == words_of(docs) and long in got
    assert spelling.spelling_forms(spelling.word_counts(df.where("false"))).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_forms(spelling.word_counts(df), 1)


def test_spelling_across_chunks_and_ranges(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(spelling, "CHUNK_BYTES", 400)  # in this process alone: forks of long prefixes are in chunks of workers
    stem = "".join(rng.choice("abc") for _ in range(90))
    edits = {stem[:k] + rng.choice(["", "a", "b", "z"]) + stem[k + rng.randint(0, 1) :] for k in range(0, 90, 2)}
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(3, 9))) for _ in range(700)} | edits | {"a" * k for k in range(1, 90)}
    counts = {w: rng.choice([2, 3, 30, 400]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(6)
    want = spelling_of(counts)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_forms(df).collect()}
    assert got == want


def test_chunks_of_any_size_find_every_pair():
    rng = random.Random(6)
    for turn in range(60):
        alphabet, size = ("ab", "abcé")[turn % 2], rng.choice([1, 2, 5, 1000])
        length = rng.choice([3, 6, 70])
        words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(max(1, length - 3), length))) for _ in range(rng.randint(1, 50))}
        if length == 70:
            stem = min(words)
            words = {stem} | {stem[:k] + rng.choice(["", "a", "b", stem[k : k + 1] + "a"]) + stem[k + 1 :] for k in range(0, len(stem), 3)}
        counts = {w: rng.randint(1, 50) for w in words}
        top = {w[:k]: rng.choice(["", "a", "b"]) for w in words for k in range(min(len(w) + 1, 6)) if rng.random() < 0.4}
        found, posts, ordered = Counter(), defaultdict(list), sorted(words)
        keys = {spelling.Keys(w)(): w for w in words}
        for at in range(0, len(ordered), size):
            part = ordered[at : at + size]
            chunk = spelling.Chunk(part, [counts[w] for w in part], top)
            for w, n in zip(part, chunk.near, strict=True):
                found[w] += n
            asked = list(chunk.beyond())
            assert len(asked) <= 4 * sum(len(w) + 1 for w in part)
            for key, length_of, a in asked:
                if length_of >= 0:
                    posts[length_of, key].append(part[a])
                elif key in keys:
                    found[part[a]] += 1
                    found[keys[key]] += 1
        for group in posts.values():
            for w in group:
                found[w] += len(group) - 1
        want = spelling_of(counts)
        assert all(found[w] == want[w][3] for w in words), (turn, size)
