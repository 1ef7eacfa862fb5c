"""The corpus pipeline: toxicity, near duplicates, decontamination, personal data, mixing.

Each stage takes the documents its predecessor kept and is written as Parquet before the
next one reads it. All but the last return the columns of ``documents``; the last returns
the mixed blocks. Null ids, null or empty texts, repeated rows and extra columns pass
through as each operator's docstring says. Workers of several stages live side by side, so
each stage takes smaller batches than an operator alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from repostrata.llm import decontaminate, mixing, pii, simhash, toxicity
from repostrata.llm.common import in_bucket, settle, table
from repostrata.session import scratch_path

BATCH_BYTES = 4 * 1024 * 1024


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; the labels of a quarter of the ids stay unseen."""
    settle(spark, BATCH_BYTES)
    labels = table(spark, sf_dir, "labels")
    return toxicity.reject(docs, toxicity.fit(docs, labels, ~in_bucket("doc_id", 4, 2)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    settle(spark, BATCH_BYTES)
    return simhash.deduplicate(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are in benchmark windows."""
    settle(spark, BATCH_BYTES)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data."""
    settle(spark, BATCH_BYTES)
    return pii.pseudonymise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources in blocks of words: one row per output slot."""
    settle(spark, BATCH_BYTES)
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", remove_benchmark),
    ("personal_data", replace_personal_data),
    ("mixing", mix),
]

# Models, fingerprints and keyed draws are not SQL; the tests compare each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate tables lie in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
