"""The training-corpus pipeline: STAGES over `documents`, each written as Parquet and read again by the next.

Every stage works on all documents that its predecessor kept, in whole texts, and returns the columns it was given, whatever
their names; the last one adds each document's n_tokens, domain, posterior and rate, which replace columns of those names.
Needed are doc_id and text; lang names the domains, n_chars is brought up to date where there is one. An empty table gives an
empty one; nulls, empty texts, ties and repeated rows are as in the stages' operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewarp.llm import decontaminate, mixing, neardup, pii, quality
from tidewarp.llm.common import carried, in_fold, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network accepts; it learns from the labels outside the held-out fold."""
    net = quality.fit(docs, table(spark, sf_dir, "labels").where(~in_fold(3, 1)))
    inner = carried(docs, F.col("text").alias("_scored"))
    return quality.score(inner, net, ("row",), "_scored").where("predicted = 1").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates: five-word shingles, 0.8."""
    return neardup.deduplicate(docs, width=5, similar=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without, or with hardly any, passages of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates; n_chars, if there is one, counts the new text."""
    out = pii.anonymise(docs, spans=None)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with n_tokens, domain, posterior and the rate that brings the domains to their target weights."""
    return mixing.mix(docs, docs.select("doc_id", F.col("lang").alias("domain")), mixing.TARGETS)[0]


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", replace_personal_data),
    ("mixing", mix_sources),
]

#: No SQL says what a trained network or a keyed permutation does; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
