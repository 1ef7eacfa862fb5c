"""Registered queries of the corpus operators: ``(spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from repostrata.llm import (
    decontaminate, extraction, hadamard_codes, langid, lexical_search, mixing, ngram_quality, passages, pii, rules,
    simhash, token_counts, toxicity,
)
from repostrata.llm.common import in_bucket, table


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate component of every document."""
    found = simhash.groups(table(spark, folder, "documents"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


def op2_langid(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document; a fifth of the ids is never learned from."""
    docs = table(spark, folder, "documents")
    held_out = in_bucket("doc_id", 5, 0)
    net = langid.fit(docs, ~held_out & F.col("doc_id").isNotNull())
    return langid.predict(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    found = extraction.extract(table(spark, folder, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op4_ngram_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Perplexity of every document under a model of the trusted ones, and whether it is kept."""
    return ngram_quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """What a mix of all sources at their target weights takes of every document."""
    return mixing.report(table(spark, folder, "documents"))


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with surrogates for the personal data in it."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, count="n_replaced")


def op7_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that an earlier one has."""
    return passages.deduplicate(table(spark, folder, "documents"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document; a quarter of the ids is never learned from."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = in_bucket("doc_id", 4, 2)
    found = toxicity.scores(docs, toxicity.fit(docs, labels, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows found in every document."""
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base statistics of every document and whether the risk-controlled rules keep it."""
    return rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return lexical_search.rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Code and error of every vector."""
    return hadamard_codes.report(table(spark, folder, "embeddings"))


def op13_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Number of tokens of every document."""
    return token_counts.counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_langid": op2_langid,
    "op3_extraction": op3_extraction,
    "op4_ngram_quality": op4_ngram_quality,
    "op5_mixing": op5_mixing,
    "op6_pii": op6_pii,
    "op7_passages": op7_passages,
    "op8_toxicity": op8_toxicity,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality_rules": op10_quality_rules,
    "op11_search": op11_search,
    "op12_codes": op12_codes,
    "op13_tokens": op13_tokens,
}
