"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

Native DataFrame code only. Three base kinds (assign, access, hex) are found by pattern. Beside them every run of 20 or
more key characters, or what base spans leave of it, is a candidate: its encoding is inferred from the characters it uses,
and three tests judge it.

* Chi-squared uniformity over the inferred alphabet of k symbols. The null hypothesis is *ordinary text*, whose letters
  are concentrated: the statistic is then noncentral with about n * (kappa - 1) more than k - 1, kappa being the
  alphabet's size times the coincidence rate of words (0.065; at least 1.7). A small statistic speaks against text. The
  noncentrality grows with the length n, so short candidates need far more uniform letters.
* A runs test about the median and a lag-1 serial-correlation test. Their null hypothesis is randomness: sequences such
  as abcdef.. or 0101.. fail it and get the p-value 1.

The p-values of all candidates of the corpus are then cut by Benjamini-Hochberg at rate q within strata of similar
length, from a histogram of fixed size (strata x 601 bins), so nothing that grows with the corpus leaves the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, replaced, spans, unused, written

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run is tried at its first character only, as a later one can't give a longer match.
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{12,}", "hex": r"(?<![0-9a-f])[0-9a-f]{32,}"}
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Stands for each character of a base span when candidates are sought beside it.
COVERED = "\x01"
BESIDE = rf"{COVERED}?(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{20,}}+{COVERED}?"
#: Lower ends of the strata of length.
STRATA = (20, 24, 32, 48, 96, 256)
BINS_A_DECADE, MOST_BINS = 20, 600
WORDS_COINCIDE, LEAST_KAPPA = 0.065, 1.7
CONSISTENT = 2.807  # two-sided 0.5 %: beyond it runs or serial correlation contradict randomness
EMPTY = "array<struct<start:bigint,order:int,end:bigint,kind:string>>"
FOUND = "array<struct<start:bigint,end:bigint,found:string>>"


def _lower_tail(z: Column) -> Column:
    """Normal distribution function for any z, by a rational tail formula that keeps small values' relative size."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z < 0, tail).otherwise(1 - tail)


def _alphabet(core: Column) -> Column:
    kinds = [(10, "[0-9]"), (16, "[0-9a-f]"), (16, "[0-9A-F]"), (26, "[a-z]"), (32, "[A-Z2-7]"), (36, "[0-9a-z]"), (36, "[0-9A-Z]"), (52, "[A-Za-z]"), (62, "[0-9A-Za-z]")]
    out = F.when(F.lit(False), F.lit(0))
    for k, symbols in kinds:
        out = out.when(core.rlike(f"^{symbols}+$"), F.lit(k))
    return out.otherwise(F.lit(64))


def evidence(token: Column) -> Column:
    """Bins of 1/20 decade of the p-value that token is ordinary text: 0 for p = 1, at most 600."""

    def judge(core: Column) -> Column:
        return let(F.struct(_alphabet(core).cast("double").alias("k"), F.transform(F.split(core, ""), lambda c: F.ascii(c).cast("double")).alias("v")), of_values)

    def of_values(x: Column) -> Column:
        return let(F.struct(x["k"].alias("k"), x["v"].alias("v"), F.sort_array(x["v"]).alias("s"), (F.aggregate(x["v"], F.lit(0.0), lambda a, y: a + y) / F.size(x["v"])).alias("m")), of_sorted)

    def of_sorted(x: Column) -> Column:
        n = F.size(x["v"]).cast("double")
        # sum of squared counts: a symbol's (r + 1)-th copy adds 2 r + 1
        start = F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
        squares = F.aggregate(
            x["s"], start,
            lambda a, y: F.struct(y.alias("last"), F.when(a["last"] == y, a["run"] + 1).otherwise(1.0).alias("run"), (a["sum"] + F.when(a["last"] == y, 2 * a["run"] + 1).otherwise(1.0)).alias("sum")),
            lambda a: a["sum"],
        )
        middle = F.get(x["s"], F.floor(F.size(x["s"]) / 2).cast("int"))
        start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("high"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("lag"), F.lit(0.0).alias("var"))
        order = F.aggregate(
            x["v"], start,
            lambda a, y: F.struct(
                y.alias("last"), (a["high"] + F.when(y >= middle, 1.0).otherwise(0.0)).alias("high"),
                (a["runs"] + F.when(a["last"].isNull() | ((a["last"] >= middle) != (y >= middle)), 1.0).otherwise(0.0)).alias("runs"),
                (a["lag"] + F.coalesce((a["last"] - x["m"]) * (y - x["m"]), F.lit(0.0))).alias("lag"), (a["var"] + (y - x["m"]) * (y - x["m"])).alias("var"),
            ),
        )
        return let(F.struct(n.alias("n"), x["k"].alias("k"), squares.alias("squares"), order.alias("order")), of_counts)

    def of_counts(x: Column) -> Column:
        n, k, o = x["n"], x["k"], x["order"]
        more = n * (F.greatest(F.lit(LEAST_KAPPA), k * WORDS_COINCIDE) - 1)
        z_text = (k / n * x["squares"] - n - (k - 1 + more)) / F.sqrt(2 * (k - 1 + 2 * more))
        pairs = 2 * o["high"] * (n - o["high"])
        z_runs = F.try_divide(o["runs"] - pairs / n - 1, F.sqrt(F.greatest(pairs * (pairs - n), F.lit(0.0)) / (n * n * (n - 1))))
        z_serial = F.try_divide(o["lag"], o["var"]) * F.sqrt(n) + 1 / F.sqrt(n)
        consistent = (F.abs(z_runs) <= CONSISTENT) & (F.abs(z_serial) <= CONSISTENT)
        bins = F.floor(-F.log10(F.greatest(_lower_tail(z_text), F.lit(1e-300))) * BINS_A_DECADE)
        return F.when(consistent, F.least(bins, F.lit(MOST_BINS))).otherwise(F.lit(0)).cast("int")

    core = F.regexp_replace(token, "=+$", "")
    return F.when(F.length(core) >= STRATA[0], let(core, judge)).otherwise(F.lit(0))


def _stratum(length: Column) -> Column:
    out = F.lit(0)
    for k, least in enumerate(STRATA):
        out = F.when(length >= least, F.lit(k)).otherwise(out)
    return out


def _shaped(found: Column, kind: str, order: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _with_base_spans(docs: DataFrame, text: Column, base: str, runs: str) -> DataFrame:
    """docs with the base spans (column base) and whether there is a long run of key characters (column runs).

    Plain searches spare most texts the patterns.
    """
    out = docs.withColumn(runs, text.rlike(CANDIDATE))  # a run of hex digits lies in one of key characters
    keyword = let(F.lower(text), lambda t: F.exists(F.array(*map(F.lit, KEYWORDS)), lambda k: F.contains(t, k)))
    may = {"assign": keyword, "access": F.contains(text, F.lit("AKIA")), "hex": F.col(runs)}
    parts = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        found = spans(text, pattern, may[kind])
        if kind == "assign":
            found = F.filter(found, lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= 8)
        parts.append(_shaped(found, kind, order))
    return out.withColumn(base, F.sort_array(F.concat(*parts)))


def _candidates(text: Column, base: Column, runs: Column) -> Column:
    """array<struct<start,end,found>> of the runs of key characters without the base spans (sorted by start) in them.

    Of what is left beside a base span one joining character (/ + _ = -) next to it isn't part.
    """

    def trimmed(s: Column) -> Column:
        inner = F.regexp_replace(s["found"], f"^{COVERED}[/+_=-]?", "")
        cut = let(inner, lambda x: F.struct(x.alias("x"), F.regexp_replace(x, f"[/+_=-]?{COVERED}$", "").alias("found")))
        return let(cut, lambda c: let(s["start"] + F.length(s["found"]) - F.length(c["x"]), lambda at: F.struct(at.alias("start"), (at + F.length(c["found"])).alias("end"), c["found"].alias("found"))))

    def beside(t: Column) -> Column:
        return F.filter(F.transform(spans(t, BESIDE), trimmed), lambda s: s["end"] - s["start"] >= STRATA[0])

    plain = F.translate(text, COVERED, " ")
    covered = let(plain, lambda t: replaced(t, base, lambda n: F.repeat(F.lit(COVERED), n.cast("int"))))
    return F.when(~runs, F.expr("array()").cast(FOUND)).when(F.size(base) == 0, spans(text, CANDIDATE)).otherwise(let(covered, beside))


def discovery_limits(docs: DataFrame, text: str = "text", q: float = 0.01) -> list[int]:
    """For each stratum of length the least evidence that Benjamini-Hochberg at rate q accepts (one over the most: none)."""
    based = _with_base_spans(docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")), F.col("text"), "base", "runs")
    found = based.select(F.explode(F.transform(_candidates(F.col("text"), F.col("base"), F.col("runs")), lambda s: F.struct(_stratum(s["end"] - s["start"]).alias("stratum"), evidence(s["found"]).alias("bin")))).alias("c"))
    counts = found.groupBy("c.stratum", "c.bin").count().collect()  # at most 6 x 601 rows, whatever the corpus
    limits = []
    for k in range(len(STRATA)):
        of = {r["bin"]: r["count"] for r in counts if r["stratum"] == k}
        total, above, limit = sum(of.values()), 0, MOST_BINS + 1
        for b in range(MOST_BINS, 0, -1):
            above += of.get(b, 0)
            if above and total * 10 ** (-b / BINS_A_DECADE) <= q * above:
                limit = b
        limits.append(limit)
    return limits


def find_secrets(docs: DataFrame, text: str = "text", q: float = 0.01, limits: list[int] | None = None, names: tuple[str, str] | None = None) -> DataFrame:
    """docs with base_spans and spans (or names): array<struct<start,order,end,kind>> by start, then kind; code points, end exclusive.

    Null and empty texts have no spans; texts of any length are searched whole, rows that repeat each; no rows give none, and
    leave the limits where nothing is found by chance. limits: those of discovery_limits(), else they are found from docs first. The
    battery's spans (kind random) are added beside base spans and don't overlap them. The caller's columns base_spans and spans are
    replaced, and no others; names: other names for them.
    """
    if not 0 < q < 1:
        raise ValueError("q must lie between 0 and 1")
    limits = limits or discovery_limits(docs, text, q)
    names = names or ("base_spans", "spans")
    t, out = F.coalesce(F.col(text), F.lit("")), docs.drop(*(n for n in names if n != text))
    base, random, runs = unused(out, "base", "random", "runs")
    out = _with_base_spans(out, t, base, runs)
    least = lambda s: F.get(F.array(*[F.lit(x) for x in limits]), _stratum(s["end"] - s["start"]))
    out = out.withColumn(random, F.filter(_candidates(t, F.col(base), F.col(runs)), lambda s: evidence(s["found"]) >= least(s)))
    return out.withColumn(names[1], F.sort_array(F.concat(base, _shaped(F.col(random), "random", 3)))).withColumn(names[0], F.col(base)).drop(base, random, runs)


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """text with the union of the found spans (sorted by start) replaced by mark."""
    return replaced(text, found, lambda n: F.lit(mark))


def redact_secrets(docs: DataFrame, text: str = "text", q: float = 0.01) -> DataFrame:
    """docs with every secret span in text replaced by [SECRET]; nulls stay null, texts of any length are searched whole, rows
    that repeat each; no row is dropped, no other column changed, whatever its name; no rows give none."""
    limits, names = discovery_limits(docs, text, q), unused(docs, "base_spans", "spans")
    found = find_secrets(docs, text, q, limits, names)
    return found.withColumn(text, redacted(F.col(text), F.col(names[1]))).select(docs.columns)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, [*BASE, "random"]), F.sha2(written(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
