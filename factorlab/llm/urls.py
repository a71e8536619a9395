"""URL rules: host-suffix and path-prefix expressions, short hash prefixes, full digests.

Native DataFrame code only. Each URL is expanded into the expressions `host suffix + path prefix` that a rule could
equal; the distinct ones meet the rules in an equi-join on the first 8 hex digits of their SHA-256; the whole digest is
then compared, and of the rules that fit a URL the longest wins (equal length: longer host, then block before allow).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused

PREFIX_DIGITS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(verdict, host, path) rows as the rules' DataFrame."""
    rows = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("verdict", "rule_host", "rule_path"), r, strict=True)]) for r in rules])
    return spark.range(1).select(F.inline(rows))


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both are empty where the url is null or has no `://`."""
    rest = F.expr(f"CASE WHEN instr(`{url}`, '://') > 0 THEN substring(`{url}`, instr(`{url}`, '://') + 3) ELSE '' END")
    return pages.withColumn("host", F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All rows and columns of pages, with host, path, rule (null: none fits) and verdict.

    A column of pages with one of these names, in any case, is replaced (the url's too, if it has such a name). Null urls, urls
    without `://` and urls that no rule fits get the default verdict; rows that repeat are judged each. Each distinct (host,
    path) is expanded once and each distinct expression meets the rules once, both after partial aggregation. In the last
    join every page meets its place's verdict: the rows of a place with many pages are split by adaptive execution, as no
    side needs a key's rows together; rows without a host take no part in a join. Rules with a null part, or whose path neither is empty nor begins with `/`, fit no
    url. An empty rule table gives the default everywhere.
    """
    rules = rules.where("rule_host IS NOT NULL AND verdict IS NOT NULL AND (rule_path = '' OR rule_path LIKE '/%')").select(
        F.translate("rule_host", UPPER, LOWER).alias("rule_host"), "rule_path", "verdict"
    )
    rules = rules.withColumn("rule", F.concat("rule_host", "rule_path"))
    at_slash = F.col("rule_path").endswith("/")
    # One row about the rules: how many labels and slashes they reach to, and the lengths of paths that end elsewhere.
    reach = rules.agg(
        F.coalesce(F.max(F.size(F.split("rule_host", r"\."))), F.lit(0)).alias("labels"),
        F.coalesce(F.max(F.when(at_slash, F.length("rule_path") - F.length(F.replace("rule_path", F.lit("/"), F.lit(""))))), F.lit(0)).alias("slashes"),
        F.collect_set(F.when(~at_slash, F.length("rule_path"))).alias("lengths"),
    ).first()
    (own,) = unused(pages, "url")
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    pages = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{url}`").alias(own))
    pages = with_host_path(pages, own).drop(own)

    labels, parts = F.split("host", r"\."), F.split("path", "/", -1)
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(max(1, reach["labels"])))), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    slashes = F.least(F.size(parts) - 1, F.lit(reach["slashes"]))
    none = F.expr("array()").cast("array<string>")
    prefixes = F.when(slashes > 0, F.transform(F.sequence(F.lit(1), slashes), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/")))).otherwise(none)
    for length in sorted(reach["lengths"]):
        prefixes = F.concat(prefixes, F.when(F.length("path") >= length, F.array(F.substring("path", 1, length) if length else F.lit(""))).otherwise(none))
    wanted = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    digest = lambda c: F.sha2(c.cast("binary"), 256)

    has_host = F.col("host") != ""
    places = pages.where(has_host).select("host", "path").distinct().select("host", "path", F.explode(F.array_distinct(wanted)).alias("asked"))
    asked = places.select("asked").distinct().withColumn("asked_digest", digest(F.col("asked"))).withColumn("short", F.substring("asked_digest", 1, PREFIX_DIGITS))
    rules = rules.withColumn("rule_digest", digest(F.col("rule"))).withColumn("short", F.substring("rule_digest", 1, PREFIX_DIGITS))
    hits = asked.join(rules, "short").where("asked_digest = rule_digest").select("asked", "rule_host", "verdict", "rule").distinct()
    best = (
        places.join(hits, "asked")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule"), F.length("rule_host"), F.col("verdict"), F.col("rule"))).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    judged = pages.where(has_host).join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    rest = pages.where(~has_host).withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    return judged.unionByName(rest).select(*[F.col(f"`{c}`") for c in kept], "host", "path", "rule", "verdict")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n
  FROM cut
), rules(verdict, h, p) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits AS (
  SELECT n, h || p AS rule, verdict,
         row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, length(h) DESC, verdict DESC) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (n)
"""
