"""MinHash near-duplicates with odd sketches; links are confirmed on whole shingle sets.

1. Each text becomes its set of distinct 5-word shingles, 128 MinHash samples of it, 32 band keys of 4 samples each, and an
   odd sketch: the samples folded into a 256-bit parity bitmap. Rows with equal sets (by a 128-bit digest) form a class,
   named by its smallest id; from here on classes are compared, so a group of copies of any size is one row.
2. Classes that share a band key are candidates. Each bucket links its members to one leader only, so the number of pairs
   is linear in the rows. A pair whose size ratio is too small, or whose sketches' XOR population count puts the estimated
   similarity 0.25 or more below the threshold (about five standard errors of 0.048), is dropped; the others are compared on
   their whole sets. Confirmed links give components. In further rounds the buckets whose members still lie in several
   components take other leaders, one of each bucket's own, and only members outside the leader's component are compared.
3. What is split even then is searched exhaustively, across components only: of each pair one is outside the bucket's most
   common component. Finer odd sketches (1,024 samples, 2,048 bits) of the few classes concerned rule pairs out whose
   estimate lies 0.08 or more below the threshold (over four standard errors of 0.017). Where a bucket would need more than
   SMALL_BUCKET ** 2 comparisons, prefix filtering replaces it (two sets as similar as asked share one of their rarest
   shingles). Comparisons are dealt out in cells of at most TILE by TILE classes, so no bucket is one task's.

Whole sets are made again from the texts of the wanted documents alone. Which these are is sent as a bitmap of fixed size;
rows it lets through by chance are joined away, so no text is ever shuffled. Each step's tables go when the next is written.

At similarity 0.75 a pair shares no band with probability (1 - 0.75^4)^32, about 5e-6.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, freed, mixed, stored, text_bytes, to_python, windows_of

WIDTH, PERCENT = 5, 75
BANDS, ROWS = 32, 4
SAMPLES, BITS = BANDS * ROWS, 256
#: Pairs whose sketches estimate less than this are no candidates: 0.25 below the threshold, about five standard errors.
LEAST_ESTIMATE = 0.5
#: Of the finer sketches, and how far below the threshold their estimate may lie: over four standard errors.
FINE_SAMPLES, FINE_BITS, FINE_SLACK = 1024, 2048, 0.08
#: Further rounds with leaders of each bucket's own.
ROUNDS = 1
#: Bits of the bitmap of wanted ids; 8 MB, whatever the corpus.
FILTER_BITS = 1 << 26
#: Buckets of up to this number squared of comparisons are searched by comparing sketches, others by prefix filtering.
SMALL_BUCKET = 4096
#: Values of a block in which minima are taken, and shingles after which a batch of whole sets leaves a Python worker.
BLOCK_VALUES, BATCH_SHINGLES = 1 << 17, 500_000
#: Classes on each side of the cells into which a bucket's comparisons are dealt.
TILE = 256

_random = np.random.default_rng(20240229)
_FACTOR = _random.integers(0, 2**63, FINE_SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _random.integers(0, 2**63, FINE_SAMPLES, dtype=np.uint64)
_ORDER = np.arange(FINE_SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_set(raw: bytes, hashes: WordHash, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; bytes.lower() lowers A-Z only, and split() cuts at \\x20 and \\x09-\\x0D."""
    return np.unique(windows_of(hashes.array(raw.lower().split()), width))


def minhash(shingles: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """Minima of the non-empty set under as many permutations of 64-bit integers."""
    least, shift, factor = None, _SHIFT[:samples], _FACTOR[:samples]
    step = BLOCK_VALUES // samples
    for k in range(0, len(shingles), step):
        part = ((shingles[k : k + step, None] ^ shift) * factor).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    mixed_samples = mixed(samples + _ORDER[:SAMPLES]).reshape(BANDS, ROWS)
    return mixed(np.add.reduce(mixed_samples * np.array([1, 3, 5, 7], np.uint64), axis=1)).view(np.int64)


def odd_sketch(samples: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parity bitmap of the samples, as bits / 64 integers; bits is a power of two."""
    at = (mixed(samples ^ _ORDER[: len(samples)]) >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def most_xor_bits(similarity: float, samples: int = SAMPLES, bits: int = BITS) -> int:
    """The XOR population count at which two odd sketches estimate this similarity: J = 1 + n / (4 k) ln(1 - 2 x / n)."""
    return int(bits / 2 * (1 - np.exp((similarity - 1) * 4 * samples / bits)))


def signatures(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row: id, n_shingles, digest of the set (null: empty), bands, sketch."""

    def run(batches):
        hashes = WordHash()
        for batch in batches:
            n, digests, bands, sketches = [], [], [], []
            for raw in text_bytes(batch.column(1)):
                s = shingle_set(raw, hashes, width)
                n.append(len(s))
                if len(s):
                    samples = minhash(s)
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bands.append(band_keys(samples))
                    sketches.append(odd_sketch(samples))
                else:
                    digests.append(None)
                    bands.append([])
                    sketches.append([])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, longs), pa.array(sketches, longs)], [id_col, "n_shingles", "digest", "bands", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    return to_python(docs.select(id_col, text)).mapInArrow(run, f"`{id_col}` {kind}, n_shingles bigint, digest binary, bands array<bigint>, sketch array<bigint>")


def id_bitmap(ids: DataFrame, id_col: str) -> np.ndarray:
    """Bitmap of FILTER_BITS bits of the ids' hashes; at most FILTER_BITS / 64 rows come to the driver."""
    bit = F.pmod(F.xxhash64(id_col), F.lit(FILTER_BITS))
    words = ids.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{id_col}`), 64L) as int))").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    rows = words.toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text: str, width: int, fine: bool = False) -> DataFrame:
    """(node, items, sketch, bands): the shingle set of each wanted id (column node); fine: with its finer sketch and its
    band keys, else null."""
    wanted = wanted.select("node").distinct()
    shared = docs.sparkSession.sparkContext.broadcast(id_bitmap(wanted, "node"))  # FILTER_BITS bits
    schema = f"node {docs.schema[id_col].dataType.simpleString()}, items array<bigint>, sketch array<bigint>, bands array<bigint>"

    def block(ids, sets):
        samples = [minhash(x, FINE_SAMPLES) if fine and len(x) else None for x in sets]
        longs = pa.list_(pa.int64())
        columns = [x.view(np.int64) for x in sets], [s if s is None else odd_sketch(s, FINE_BITS) for s in samples], [s if s is None else band_keys(s[:SAMPLES]) for s in samples]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, longs) for c in columns)], ["node", "items", "sketch", "bands"])

    def run(batches):
        hashes, bitmap = WordHash(), shared.value.view(np.uint64)
        for batch in batches:
            h = batch.column(0).to_numpy()
            hit = np.flatnonzero((bitmap[np.mod(h, FILTER_BITS) >> 6] >> np.mod(h, 64).astype(np.uint64)) & np.uint64(1))
            part = batch.take(pa.array(hit))
            kept, sets, size = [], [], 0
            for k, raw in enumerate(text_bytes(part.column(2))):
                kept.append(k)
                sets.append(shingle_set(raw, hashes, width))
                size += len(sets[-1])
                if size > BATCH_SHINGLES:
                    yield block(part.column(1).take(pa.array(kept)), sets)
                    kept, sets, size = [], [], 0
            yield block(part.column(1).take(pa.array(kept, pa.int64())), sets)

    rows = docs.where(F.col(id_col).isNotNull()).select(F.xxhash64(id_col).alias("h"), F.col(id_col), text)
    return to_python(rows).mapInArrow(run, schema).join(wanted, "node", "left_semi")


def _may_link(percent: int, fine: bool = False) -> Column:
    """Sizes and sketches of sides a and b don't rule the pair out."""
    samples, bits, slack = (FINE_SAMPLES, FINE_BITS, FINE_SLACK) if fine else (SAMPLES, BITS, 0.75 - LEAST_ESTIMATE)
    xor = sum((F.bit_count(F.get("sketch_a", F.lit(k)).bitwiseXOR(F.get("sketch_b", F.lit(k)))) for k in range(bits // 64)), F.lit(0))
    return (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (xor <= most_xor_bits(percent / 100 - slack, samples, bits))


def _side(df: DataFrame, s: str, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(s if c == "node" else f"{c}_{s}") for c in df.columns if c not in keys])


def _dealt(rows: DataFrame, key: str, slots: Column) -> DataFrame:
    """The rows (key, node, ..) with one of their key's slots, by the node."""
    return rows.withColumn("slot", F.pmod(F.xxhash64("node", key), slots).cast("int"))


def _in_slots(facts: DataFrame, slots: Column) -> DataFrame:
    """The facts, one row a key, once for each of the key's slots."""
    return facts.withColumn("slot", F.explode(F.sequence(F.lit(0), slots.cast("int") - 1)))


def _slots(size: str) -> Column:
    """Slots into which the rows of a key of this size are dealt where facts about the key are joined to them."""
    return F.ceil(F.col(size) / TILE)


def _split(rows: DataFrame, key: str) -> DataFrame:
    """The rows (key, node, root, most, ..) of keys that lie in several components, with the key's rows (size), its most common
    component (major) and how many rows are outside that (minor). most, the same in all rows of a key, is at least their
    number. Counts are aggregated by (key, root) first."""
    counts = rows.groupBy(key, "root").agg(F.count("*").alias("n_of"), F.max("most").alias("most"))
    largest = F.max(F.struct("n_of", "root"))
    several = counts.groupBy(key).agg(F.count("*").alias("roots"), F.sum("n_of").alias("size"), F.max("most").alias("most"), largest.alias("x")).where("roots > 1")
    facts = several.select(key, "size", "most", F.col("x.root").alias("major"), (F.col("size") - F.col("x.n_of")).alias("minor"))
    return _dealt(rows, key, _slots("most")).drop("most").join(_in_slots(facts, _slots("most")).drop("most"), [key, "slot"]).drop("slot")


def _across(rows: DataFrame, key: str, percent: int, keys: str | None = None) -> DataFrame:
    """Pairs (a, b) of split rows (key, node, root, n, sketch, size, major, minor) with one key, in different components,
    that may link. Side a lies outside the key's most common component; each key's comparisons are dealt out in cells.
    keys: column of all keys of a node; of those that a pair shares it then comes out under the first alone."""
    tiles = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    own = lambda n: F.pmod(F.xxhash64("node", key), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    kept = [key, "node", "root", "n", "sketch", *([keys] if keys else [])]
    a = _side(rows.where("root <> major").select(*kept, own(tiles("minor")).alias("i"), every(tiles("size")).alias("j")), "a", key, "i", "j")
    b = _side(rows.select(*kept, "major", own(tiles("size")).alias("j"), every(tiles("minor")).alias("i")), "b", key, "i", "j")
    once = (F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("major_b")) | (F.col("a") < F.col("b")))
    first = F.element_at(F.array_intersect(f"{keys}_a", f"{keys}_b"), 1) == F.col(key) if keys else F.lit(True)
    return a.join(b, [key, "i", "j"]).where(once & _may_link(percent, fine=True) & first).select("a", "b").distinct()


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches don't rule out."""
    known = classes.select("node", "n", "sketch")
    # leaders (b) come first: the exchange to a lets a hub's pairs be split
    return pairs.join(_side(known, "b"), "b").join(_side(known, "a"), "a").where(_may_link(percent)).select("a", "b").distinct()


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are as similar as asked."""
    sets = sets.select("node", "items")
    both = pairs.join(_side(sets, "b"), "b").join(_side(sets, "a"), "a")
    found = both.select("a", "b", F.size("items_a").alias("n_a"), F.size("items_b").alias("n_b"), F.size(F.array_intersect("items_a", "items_b")).alias("common"))
    return found.where(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the component's smallest node.

    Large-star and small-star steps alternate until nothing changes; each round is written to the shared folder, where it
    replaces the one before. Hubs are
    reduced by partial aggregation and joined under adaptive skew handling; nothing is collected but a count and a hash.
    """
    oriented = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = stored(oriented(edges))
    before = state(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = oriented(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        last, now = now, stored(oriented(small))
        freed(last)
        after = state(now)
        if after == before:
            break
        before = after
    out = stored(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
    freed(now)
    return out


def _prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Likely pairs (a, b) of members (node, root, n, sketch) in different components that share one of their rarest shingles.

    Of n shingles, ordered by how many members have them, sets as similar as asked share one of the first n - ceil(p n) + 1.
    """
    rows = members.select("node").join(sets, "node").select("node", F.size("items").alias("n"), F.explode("items").alias("item"))
    counts = rows.groupBy("item").count().where("count > 1")
    # shingles that no other member has can't be shared, but they take the first places
    known = rows.join(counts, "item", "left").withColumn("count", F.coalesce("count", F.lit(1)))
    ordered = known.groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("count", "item"))).alias("all"))  # one document's set
    first = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    posted = ordered.select("node", F.explode(F.slice("all", F.lit(1), first)).alias("x")).where("x.count > 1").select("node", F.col("x.item").alias("item"), F.col("x.count").alias("most")).join(members, "node")
    shared = stored(_split(posted, "item"))
    pairs = stored(_across(shared, "item", percent))
    freed(shared)
    return pairs


def _rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The members, with root, of the buckets that lie in several components, written down."""
    placed = members.withColumn("root", F.col("node")) if roots is None else members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return stored(_split(placed.select("bucket", "node", "root", "most"), "bucket"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable by links, itself included), kept.

    Null and empty texts have no shingles and are linked with nothing; a null id is never linked or dropped. Rows that
    repeat an id are one document, to which the links of each of its texts count. Only id and text are read. percent: the
    least similarity, 75 or more.
    """
    if percent < PERCENT:
        raise ValueError("bands are laid out for similarities of 0.75 and more")
    marks = stored(signatures(docs, id_col, text, width))
    known = marks.where(F.col("digest").isNotNull() & F.col(id_col).isNotNull())
    classes = stored(known.groupBy("digest").agg(F.min(id_col).alias("node"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    rows = stored(marks.select(id_col, "n_shingles", "digest"))
    freed(marks)
    places = classes.select("node", F.explode("bands").alias("bucket"))
    # written down, so that adaptive execution can split a crowded bucket's rows in the join
    crowded = stored(places.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("most")).where("most > 1"))
    members = stored(places.join(crowded, "bucket").select("bucket", "node", "first", "most"))
    freed(crowded)
    thin = stored(classes.drop("bands"))
    freed(classes)
    classes = thin

    # ids of several texts are links between the classes of these
    repeated = rows.where(F.col("digest").isNotNull()).groupBy(id_col).agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where(F.col(id_col).isNotNull() & (F.col("low") != F.col("high"))).select(id_col)
    same = rows.join(repeated, id_col).join(classes.select("digest", "node"), "digest").select(F.col(id_col).alias("a"), F.col("node").alias("b"))
    roots = rest = None
    for turn in range(ROUNDS + 1):
        if turn == 0:  # the smallest of each bucket: the same one in most buckets of a group, so few pairs
            pairs = members.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
        else:
            rest = _rooted(members, roots)
            own = F.min(F.struct(F.xxhash64("node", "bucket", F.lit(turn)).alias("h"), F.col("node").alias("b"), F.col("root").alias("root_b"))).alias("leader")
            leaders = _in_slots(rest.groupBy("bucket").agg(own, F.max("size").alias("of")), _slots("of")).select("bucket", "slot", "leader")
            pairs = _dealt(rest, "bucket", _slots("size")).join(leaders, ["bucket", "slot"]).where("root <> leader.root_b").select(F.col("node").alias("a"), F.col("leader.b").alias("b")).distinct()
        pairs = stored(likely(pairs, classes, percent))
        freed(rest)
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
        sets = stored(sets_of(docs, ends, id_col, text, width))
        roots = _joined(roots, pairs, sets, percent, None if turn else same)
        freed(pairs, sets)

    rest = _rooted(members, roots)
    freed(members)
    sets = stored(sets_of(docs, rest, id_col, text, width, fine=True))
    known = classes.select("node", "n").join(sets.select("node", "sketch", "bands"), "node")
    compared = F.col("minor") * F.col("size") <= SMALL_BUCKET**2
    pairs = _across(rest.where(compared).join(known, "node"), "bucket", percent, "bands")
    large = rest.where(~compared).select("node", "root").distinct()
    if large.limit(1).count():
        pairs = pairs.union(_prefix_pairs(large.join(known.drop("bands"), "node"), sets, percent))
    pairs = stored(pairs.distinct())
    roots = _joined(roots, pairs, sets, percent)
    freed(rest, pairs, sets)

    least = classes.where("copies > 1").select("node", F.col("node").alias("component_id"))
    named = roots.select("node", F.col("root").alias("component_id"))
    least = named.union(least.join(named, "node", "left_anti"))
    special = stored(classes.select("digest", "node").join(least, "node").select("digest", "component_id"))
    freed(classes, roots)
    out = rows.join(special, "digest", "left")
    component = F.when(F.col(id_col).isNotNull(), F.coalesce("component_id", id_col))
    return out.select(id_col, "n_shingles", component.alias("component_id"), F.coalesce(F.col(id_col) == component, F.lit(True)).alias("kept"))


def _joined(roots: DataFrame | None, pairs: DataFrame, sets: DataFrame, percent: int, known: DataFrame | None = None) -> DataFrame:
    """roots with the components that known links and the pairs' confirmed ones join, written down; roots goes."""
    links = similar(pairs, sets, percent)
    links = links if known is None else links.union(known)
    if roots is not None:
        links = links.union(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    out = components(links)
    freed(roots)
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, without those that have a near-duplicate of smaller id in their component."""
    gone = near_duplicates(docs, id_col, text, width, percent).where(~F.col("kept")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(docs.columns)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
