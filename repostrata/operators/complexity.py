"""Entropy of how a commit's change spreads over files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from repostrata.operators.skew import join_lookup


def _changed() -> Column:
    return F.col("added_lines") + F.col("deleted_lines")


def commit_entropy(changes: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Files, added and deleted lines and entropy (bits) of each commit.

    With ``p = n/N``, ``-sum(p log2 p) = log2 N - sum(n log2 n)/N``: two plain sums, which
    Spark combines before the shuffle, instead of a window over the commit. ``carry``
    names columns of the commit to keep.
    """
    n = _changed()
    total, spread = F.col("added") + F.col("deleted"), F.col("spread")
    entropy = F.when(total > 0, F.greatest(F.log2(total) - spread / total, F.lit(0.0))).otherwise(0.0)
    return (
        changes.groupBy("repo", "commit_hash")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("added_lines").alias("added"),
            F.sum("deleted_lines").alias("deleted"),
            F.sum(F.when(n > 0, n * F.log2(n)).otherwise(0.0)).alias("spread"),
            *[F.max(c).alias(c) for c in carry],
        )
        .withColumn("entropy", entropy)
        .drop("spread")
    )


def history_complexity(changes: DataFrame) -> DataFrame:
    """Per file, the sum over its modifications of share times commit entropy."""
    entropy = commit_entropy(changes).select(
        "repo", "commit_hash", "files", (F.col("added") + F.col("deleted")).alias("changed"), "entropy"
    )
    share = F.coalesce(F.try_divide(_changed(), F.col("changed")), F.lit(0.0))
    facts = changes.select("repo", "commit_hash", "path", "added_lines", "deleted_lines")
    return (
        join_lookup(facts, entropy, ["repo", "commit_hash"], fan_in="files")
        .groupBy("repo", "path")
        .agg(F.sum(share * F.col("entropy")).alias("complexity"))
    )


def complexity_means(files: DataFrame) -> DataFrame:
    """Mean over the files of each repository of ``history_complexity``."""
    return files.groupBy("repo").agg(F.avg("complexity").alias("average_history_complexity"))
