"""What the physical plans must keep: pruning, partial limits, shared shuffles."""

import pytest
from pyspark.sql import functions as F

from repostrata.operators import complexity, diffs, history, lint, metadata, ownership, stars
from repostrata.plans import tables
from repostrata.schemas import CANONICAL
from repostrata.sources.readers import read_canonical

LAZY_QUERIES = {
    "repo_totals": lambda t: history.repo_totals(t["commits"], t["file_changes"]),
    "developer_counts": lambda t: history.developer_counts(t["commits"]),
    "commit_files": lambda t: history.commit_files(t["commits"], t["file_changes"]),
    "change_set": lambda t: history.change_set(t["commits"], t["file_changes"]),
    "ownership": lambda t: ownership.file_ownership(history.attach_commits(t["commits"], t["file_changes"], ["author_email"])),
    "complexity": lambda t: complexity.history_complexity(t["file_changes"]),
    "git_table": lambda t: tables.git_table(t["commits"], t["file_changes"], t["repos"], t["file_changes"]),
    "lint_rollup": lambda t: lint.message_counts(t["lint_messages"]),
    "test_table": lambda t: tables.test_table(t["source_files"]),
    "stars_long": lambda t: stars.growth_long(t["star_events"]),
    "metadata": lambda t: metadata.metadata_table(t["repo_metadata"]),
}


@pytest.fixture(scope="module")
def canonical(spark, tmp_path_factory):
    """Empty canonical tables, too large to broadcast as far as the planner knows."""
    folder = tmp_path_factory.mktemp("tables")
    for name, schema in CANONICAL.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield {name: read_canonical(spark, name, f"{folder}/{name}") for name in CANONICAL}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY_QUERIES)
def test_no_pairs_and_no_single_partition(canonical, name):
    text = plan(LAZY_QUERIES[name](canonical))
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "Exchange SinglePartition"):
        assert forbidden not in text


def test_git_table_reads_changes_three_times(canonical):
    """Once per file base, once per commit, once for the diff texts."""
    text = plan(LAZY_QUERIES["git_table"](canonical))
    scans = [line for line in text.splitlines() if "FileScan" in line and "added_lines" in line]
    # Without adaptive execution shared shuffles show as ReusedExchange.
    assert "ReusedExchange" in text
    assert len(scans) == 2
    assert sum("patch" in line.split("ReadSchema")[-1] for line in text.splitlines() if "FileScan" in line) == 1


def test_columns_are_pruned(canonical):
    text = plan(history.file_lines(canonical["file_changes"]))
    schema = text.split("ReadSchema: ")[1]
    assert schema.startswith("struct<repo:string,path:string,added_lines:bigint,deleted_lines:bigint>")
    text = plan(tables.test_table(canonical["source_files"].withColumn("content_sha", F.sha2("path", 256))))
    assert sum("content:string" in line for line in text.splitlines() if "FileScan" in line) == 1


def test_path_suffix_and_dates_reach_the_scan(canonical):
    text = plan(tables.test_table(canonical["source_files"]))
    assert "StringEndsWith(path,.py)" in text
    text = plan(history.within(canonical["commits"], "2020-01-01", None))
    assert "GreaterThanOrEqual(committer_date" in text


def test_counts_come_before_the_rollup(canonical):
    text = plan(lint.message_counts(canonical["lint_messages"]))
    # Expand sits above the first shuffle, so it copies counts, not messages.
    assert text.index("Expand") < text.index("FileScan") and text[text.index("Expand"):].count("Exchange") == 1


def test_ownership_shares_one_aggregate(canonical):
    changes = history.attach_commits(canonical["commits"], canonical["file_changes"], ["author_email"])
    assert "ReusedExchange" in plan(ownership.file_ownership(changes))


def test_source_text_is_scanned_once_and_never_sorted(canonical):
    text = plan(tables.test_table(canonical["source_files"]))
    assert "SortAggregate" not in text
    assert sum("content:string" in line for line in text.splitlines() if "FileScan" in line) == 1


def test_diff_counts_need_no_shuffle(canonical):
    text = plan(diffs.diff_stats(canonical["file_changes"]))
    assert "Exchange" not in text and "Python" not in text and "WholeStageCodegen" in text or "*(1)" in text


def test_shuffle_partitions_grow_with_the_tables(spark, tmp_path):
    from repostrata.plans import queries
    from repostrata.sources.adapters import TestTables

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        for megabytes, partitions in ((16, "2"), (640, "40")):
            with open(tmp_path / "lineitem.parquet", "wb") as file:
                file.truncate(megabytes << 20)
            queries.spread(TestTables(spark, str(tmp_path)))
            assert spark.conf.get("spark.sql.shuffle.partitions") == partitions
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
