"""Test-to-code ratio and test inventory of commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from repostrata.functions.statements import TEST_MODULES, statements


def classify(sources: DataFrame, strict: bool = True) -> DataFrame:
    """Statement counts per file, without its content; ``parsed`` is false where the text
    is missing or not valid Python.

    Every file is parsed where it is read: the text is scanned once and never shuffled.
    """
    keys = [c for c in sources.columns if c not in ("content", "content_sha")]
    return sources.select(*keys, statements(strict)("content").alias("s")).select(*keys, "s.*")


def unparsable(classified: DataFrame) -> DataFrame:
    """Files left out of the counts."""
    return classified.where(~F.col("parsed"))


def commit_statements(classified: DataFrame) -> DataFrame:
    """Statement totals per commit and the test-to-code ratio (0 without statements)."""
    test, production = F.col("test_statements"), F.col("production_statements")
    return _per_commit(classified).agg(
        F.sum(test).alias("test_statements"), F.sum(production).alias("production_statements")
    ).withColumn("test_to_code_ratio", F.coalesce(F.try_divide(test, test + production), F.lit(0.0)))


def test_table(classified: DataFrame) -> DataFrame:
    """One row per commit: ratio, test frameworks, test classes and test functions."""
    # The frameworks are a fixed list, so the sorted set is one flag per name.
    used = {
        name: F.bool_or(F.array_contains("imports", name)).alias(f"uses_{name}")
        for name in sorted(TEST_MODULES)
    }
    test, production = F.sum("test_statements"), F.sum("production_statements")
    return (
        _per_commit(classified)
        .agg(
            F.sum(F.size("unittest_classes")).alias("test_classes"),
            F.sum(F.size("pytest_functions")).alias("test_functions"),
            F.coalesce(F.try_divide(test, test + production), F.lit(0.0)).alias("test_to_code_ratio"),
            *used.values(),
        )
        .select(
            "repo",
            "commit_hash",
            F.col("committer_date").alias("date"),
            "test_classes",
            F.array_compact(
                F.array(*[F.when(F.col(f"uses_{name}"), F.lit(name)) for name in used])
            ).alias("test_frameworks"),
            "test_functions",
            "test_to_code_ratio",
        )
    )


def _per_commit(classified: DataFrame):
    return classified.groupBy("repo", "commit_hash", "committer_date")
