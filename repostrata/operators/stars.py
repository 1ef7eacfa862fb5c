"""Star growth of repositories over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from repostrata.operators.prefix import running


def valid_events(events: DataFrame) -> DataFrame:
    """Events that name both a user and a time."""
    return events.where(F.col("user_login").isNotNull() & F.col("starred_at").isNotNull())


def star_numbers(events: DataFrame) -> DataFrame:
    """Each star with its running number in its repository."""
    return running(
        valid_events(events).select("repo", "starred_at", "user_login"),
        ["repo"], ["starred_at", "user_login"], number="star_number",
    )


def growth_long(events: DataFrame, block: str = "day") -> DataFrame:
    """Star count at every date on which a repository gained stars.

    The running sum goes through calendar blocks: sums inside a (repository, day), plus
    the total of earlier days. A day has at most 86,400 distinct seconds and the day
    totals are few, so no window grows with the number of stars.
    """
    per_date = (
        valid_events(events)
        .groupBy("repo", F.col("starred_at").alias("date"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("block", F.date_trunc(block, "date"))
    )
    upto = Window.unboundedPreceding
    inside = Window.partitionBy("repo", "block").orderBy("date").rowsBetween(upto, 0)
    before = Window.partitionBy("repo").orderBy("block").rowsBetween(upto, -1)
    earlier = (
        per_date.groupBy("repo", "block")
        .agg(F.sum("n").alias("n"))
        .select("repo", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    )
    return (
        per_date.withColumn("so_far", F.sum("n").over(inside))
        .join(earlier, ["repo", "block"])
        .select("repo", "date", (F.col("earlier") + F.col("so_far")).alias("stargazers_count"))
    )


def growth_wide(events: DataFrame, repos: Sequence[str], block: str = "day") -> DataFrame:
    """One row per date of any star, one running count per repository.

    Counts are zero before the first star and carried forward where a repository has no
    star on a date.
    """
    names = sorted(repos)
    per_date = (
        valid_events(events)
        .groupBy(F.col("starred_at").alias("date"))
        .pivot("repo", names)
        .agg(F.count(F.lit(1)))
        .fillna(0, names)
        .withColumn("block", F.date_trunc(block, "date"))
    )
    upto = Window.unboundedPreceding
    inside = Window.partitionBy("block").orderBy("date").rowsBetween(upto, 0)
    totals = per_date.groupBy("block").agg(*[F.sum(_name(n)).alias(n) for n in names])
    upto_block = running(totals, [], ["block"], sums={f"{n}__upto": n for n in names})
    earlier = upto_block.select("block", *[(_name(f"{n}__upto") - _name(n)).alias(f"{n}__earlier") for n in names])
    return (
        per_date.select("date", "block", *[F.sum(_name(n)).over(inside).alias(n) for n in names])
        .join(earlier, "block")
        .select("date", *[(_name(n) + _name(f"{n}__earlier")).alias(n) for n in names])
    )


def growth_grid(events: DataFrame, repos: Sequence[str]) -> DataFrame:
    """The wide series in rows: every listed repository at every date."""
    names = sorted(repos)
    return growth_wide(events, names).unpivot(
        ["date"], [_name(n) for n in names], "repo", "stargazers_count"
    )


def _name(column: str):
    return F.col(f"`{column}`")
