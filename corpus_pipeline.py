"""The corpus pipeline: quality rules, near-dedup, decontamination, secret scans, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one reads it from Parquet.
Secrets are replaced in the text; the other stages drop rows.

Nulls: a row without text has no words and goes with the quality rules; a null doc_id, lang or source is carried, and a null source or
language is a value of its own in mixing. Empty texts go like null ones; very long texts pass every stage whole.
Ties and repeated rows: of rows that repeat doc_id and text the near duplicates stage keeps one, as of any group of copies; draws go by
doc_id, so rows of one doc_id are drawn alike. Empty tables: no documents give no rows, an empty benchmark contaminates nothing.
Extra columns of documents stay, whatever their names; the last stage adds n_tokens, probability and repeats, with an
underscore more where documents have such a column. run() deletes each stage's table when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import decontaminate, mixing, near_dedup, quality, secrets
from weft.llm._shared import drop_shared, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scans", secret_scans),
    ("mixing", mix_sources),
]

#: The secret scan decodes and parses keys, which SQL cannot; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each over the written rows of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
            if k:
                drop_shared(before)
    return docs
