"""Linter messages and statistics of commits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Leading columns of the lint table.
FIXED_COLUMNS = (
    "repo", "date", "commit_hash", "info", "refactor", "convention", "warning", "error", "fatal",
    "global_note", "avg_mccabe_complexity", "percent_duplicated_lines", "nb_duplicated_lines", "statement",
)
# Key prefixes of the column groups that follow.
GROUP_PREFIXES = ("undocumented", "bad_names", "code_type", "node_count")
# Statistics left out of the table.
DROPPED_PREFIXES = ("stats.by_module", "stats.dependencies", "stats.duplicated_lines")
DROPPED_KEYS = ("stats.repository_name",)


def message_counts(messages: DataFrame, by: Sequence[str] = ("repo", "commit_hash")) -> DataFrame:
    """Messages per module, per module and category, and per message id.

    ``level`` is 0 for a message id, 1 for a category, 3 for a module and 7 for the whole
    commit. Counting first keeps the rollup from copying every message.
    """
    finest = messages.groupBy(*by, "module", "category", "msg_id").agg(F.count(F.lit(1)).alias("n"))
    levels = finest.select(*by, "module", "category", "msg_id", "n").groupingSets(
        [
            [F.col(c) for c in (*by, "module", "category", "msg_id")],
            [F.col(c) for c in (*by, "module", "category")],
            [F.col(c) for c in (*by, "module")],
            [F.col(c) for c in by],
        ],
        *by, "module", "category", "msg_id",
    )
    return levels.agg(F.sum("n").alias("messages"), F.grouping_id().cast("bigint").alias("level")).select(
        *by, "module", "category", "msg_id", "level", "messages"
    )


def complexity_in(message: Column) -> Column:
    """First all-digit word of a "too complex" message; NULL when there is none."""
    digits = F.regexp_extract(message, r"(?:^|\s)([0-9]+)(?:\s|$)", 1)
    return F.nullif(digits, F.lit("")).cast("bigint")


def mccabe(messages: DataFrame, by: Sequence[str] = ("repo", "commit_hash")) -> DataFrame:
    """Mean McCabe complexity per commit; 0 without such messages."""
    value = F.when(F.col("symbol") == "too-complex", complexity_in(F.col("msg")))
    return messages.groupBy(*by).agg(
        F.coalesce(F.avg(value), F.lit(0.0)).alias("avg_mccabe_complexity")
    )


_BY_MSG = "stats.by_msg."


def with_ids(stats: DataFrame, ids: DataFrame) -> DataFrame:
    """Rename ``by_msg.<symbol>`` keys to ``by_msg.<msg_id>.<symbol>``; symbols without an id drop out.

    Only these rows are joined; all other statistics pass by.
    """
    by_msg = F.startswith("key", F.lit(_BY_MSG))
    symbol = F.substr("key", F.lit(len(_BY_MSG) + 1))
    known = stats.where(by_msg).withColumn("symbol", symbol).join(ids.select("symbol", "msg_id"), "symbol")
    named = known.withColumn("key", F.concat(F.lit(_BY_MSG), "msg_id", F.lit("."), "symbol"))
    return stats.where(~F.coalesce(by_msg, F.lit(False))).unionByName(named.select(*stats.columns))


def unknown_symbols(stats: DataFrame, ids: DataFrame) -> DataFrame:
    """Symbols of the statistics that have no message id."""
    return (
        stats.where(F.startswith("key", F.lit(_BY_MSG)))
        .select(F.substr("key", F.lit(len(_BY_MSG) + 1)).alias("symbol"))
        .distinct()
        .join(ids, "symbol", "left_anti")
    )


def table_keys(stats: DataFrame) -> DataFrame:
    """Statistics of the lint table: dropped groups removed, prefixes stripped from the key."""
    key = F.col("key")
    kept = stats
    for prefix in DROPPED_PREFIXES:
        kept = kept.where(~F.startswith(key, F.lit(prefix)))
    kept = kept.where(~key.isin(*DROPPED_KEYS))
    bare = F.regexp_replace(key, r"stats\.", "")
    return kept.withColumn("key", F.regexp_replace(bare, r"by_msg\.", ""))


def ordered_columns(columns: Sequence[str]) -> list[str]:
    """Fixed columns first, then the grouped columns sorted, then the rest sorted."""
    grouped = sorted(c for c in columns if c.startswith(GROUP_PREFIXES))
    first = [*FIXED_COLUMNS, *grouped]
    return first + sorted(c for c in columns if c not in first)


def lint_wide(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per commit with a column for each of ``keys`` and every fixed column."""
    identity = {"repo", "date", "commit_hash"}
    columns = ordered_columns(sorted(set(keys) | set(FIXED_COLUMNS)))
    values = [c for c in columns if c not in identity]
    grouped = table_keys(stats).groupBy("repo", F.col("committer_date").alias("date"), "commit_hash")
    # One aggregate instead of a pivot, which would shuffle every statistic of a commit by itself.
    wide = grouped.agg(*[F.max(F.when(F.col("key") == v, F.col("value"))).alias(v) for v in values])
    return wide.select(*[F.col(f"`{c}`") for c in columns])
