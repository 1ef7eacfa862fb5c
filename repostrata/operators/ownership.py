"""Who wrote which share of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from repostrata.operators.history import churn_of
from repostrata.operators.skew import join_lookup


def author_file_base(
    changes: DataFrame, author: str = "author_email", churn_mode: str | None = None
) -> DataFrame:
    """Changed lines per (repository, file, author). With ``churn_mode`` also the sums
    that the line and churn metrics of a file need."""
    sums = [F.sum(F.col("added_lines") + F.col("deleted_lines")).alias("changed")]
    if churn_mode is not None:
        churn = churn_of(churn_mode)
        sums += [
            F.sum("added_lines").alias("added"),
            F.sum("deleted_lines").alias("removed"),
            F.count(F.lit(1)).alias("modifications"),
            F.sum(churn).alias("churn_total"),
            F.max(churn).alias("churn_max"),
        ]
    return changes.groupBy("repo", "path", F.col(author).alias("author")).agg(*sums)


def file_metrics(base: DataFrame, minor: float = 0.05) -> DataFrame:
    """Ownership per file from ``author_file_base``, and lines and churn if it has them.

    Shares need the total of the file, so every author meets it in a join that splits a file
    with very many authors.
    """
    sums = [c for c in base.columns if c not in ("repo", "path", "author")]
    detailed = "churn_total" in sums
    totals = [F.max(c).alias(c) if c == "churn_max" else F.sum(c).alias(c) for c in sums]
    files = base.groupBy("repo", "path").agg(
        *totals, F.max("changed").alias("top_changed"), F.count(F.lit(1)).alias("contributors")
    )
    whole = files.select("repo", "path", F.col("changed").alias("total"), "contributors")
    shares = join_lookup(base.select("repo", "path", "author", "changed"), whole, ["repo", "path"], "contributors")
    majors = shares.groupBy("repo", "path").agg(
        F.count_if(F.try_divide("changed", "total") >= F.lit(minor)).alias("majors")
    )
    minors = F.when(F.col("changed") > 0, F.col("contributors") - F.col("majors")).otherwise(0).cast("bigint")
    lines = [
        "added",
        "removed",
        F.try_divide("added", "modifications").alias("avg_added"),
        "churn_total",
        "churn_max",
        F.try_divide("churn_total", "modifications").alias("churn_avg"),
    ]
    return files.join(majors, ["repo", "path"]).select(
        "repo",
        "path",
        (F.try_divide("top_changed", "changed") * 100).alias("experience"),
        "contributors",
        minors.alias("minor_contributors"),
        *(lines if detailed else []),
    )


def file_ownership(changes: DataFrame, author: str = "author_email", minor: float = 0.05) -> DataFrame:
    """Share of the top author, contributors and minor contributors per file."""
    return file_metrics(author_file_base(changes, author), minor)


def ownership_means(files: DataFrame) -> DataFrame:
    """Means over the files of each repository of ``file_ownership``."""
    return files.groupBy("repo").agg(
        F.avg("experience").alias("average_contributor_experience"),
        F.avg("contributors").alias("average_contributors"),
        F.avg("minor_contributors").alias("average_minor_contributors"),
    )
