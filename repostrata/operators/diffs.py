"""Counts read from the diff text of a file change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _body(patch: Column) -> Column:
    """Diff lines after the file header, each preceded by a newline."""
    text = F.concat(F.lit("\n"), patch)
    start = F.locate("\n@@", text)
    return F.when(start > 0, F.substr(text, start)).otherwise(text)


def _occurrences(text: Column, part: str) -> Column:
    """How often a two-byte text occurs; plain byte search, no regular expression."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))) / 2).cast("bigint")


def diff_stats(patches: DataFrame, patch: str = "patch") -> DataFrame:
    """Add ``added``, ``deleted`` and ``hunks`` (blocks of adjacent change lines).

    Everything is counted within the row; nothing is exploded or shuffled. The possessive
    pattern takes a block of any length without recursion.
    """
    body = F.col("__body")
    return (
        patches.withColumn("__body", _body(F.col(patch)))
        .withColumns(
            {
                "added": _occurrences(body, "\n+"),
                "deleted": _occurrences(body, "\n-"),
                "hunks": F.regexp_count(body, F.lit(r"(?:\n[+-][^\n]*+)++")).cast("bigint"),
            }
        )
        .drop("__body", patch)
    )


def file_hunks(stats: DataFrame) -> DataFrame:
    """Median hunks per file, from the distinct hunk counts of the file and how often
    each occurs."""
    counted = stats.groupBy("repo", "path", "hunks").agg(F.count(F.lit(1)).alias("times"))
    return counted.groupBy("repo", "path").agg(F.percentile("hunks", 0.5, F.col("times")).alias("hunks"))


def hunk_means(files: DataFrame) -> DataFrame:
    return files.groupBy("repo").agg(F.avg("hunks").alias("average_hunks"))
