"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it returns is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlab.llm import decontaminate, langid, neardup, packing, secrets
from factorlab.llm.common import freed, stored, unused


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, in whatever language and also where none can be learned; null texts and others go. Rows that repeat
    are judged each, a null id or lang changes nothing; own columns get names that docs doesn't have."""
    columns = docs.columns
    letter, *names = unused(docs, "letter", "lang_pred", "score")
    found = langid.identify(docs, langid.learn_languages(docs), letter=letter, names=tuple(names))
    return found.where(letter).select(columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates. Rows of one id are one document and stay or go
    together; a null id, null and empty texts are never duplicates and stay."""
    return neardup.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly benchmark go. Null and empty texts have none and stay; rows that
    repeat, or have a null id, are each cleaned; n_chars follows the text, other columns keep their values, whatever their names."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n_chars="n_chars")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets redacted. Nulls stay null; rows that repeat are each redacted; n_chars follows the text (a
    null one stays null), other columns keep their values, whatever their names."""
    out = secrets.redact_secrets(docs)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens. A null text counts as empty: it is the end token alone; rows that
    repeat, or have a null id, are packed each; only doc_id and text are read."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("packing", packed),
]

#: SQL can express neither the trained language model nor the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        freed(before)
    return STAGES[-1][1](spark, docs, sf_dir)
