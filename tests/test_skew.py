"""One key with most of the rows: same results, and its work is split."""

import pytest
from pyspark.sql import functions as F

from repostrata.operators import history
from repostrata.operators.skew import join_lookup

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def small_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def facts(spark):
    return spark.range(0, 30_000, 1, 6).selectExpr("if(id % 3 < 2, -1, id % 50) as k", "id")


@pytest.mark.parametrize("chunk", [1_000, 10**9, 100])
def test_lookup_join_is_a_plain_join(facts, rows, chunk):
    counts = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = join_lookup(facts, counts, ["k"], "n", chunk)
    assert got.columns == ["k", "id", "n"]
    assert rows(got) == rows(facts.join(counts, "k"))


def test_hot_key_is_spread_over_salted_pieces(spark, facts):
    counts = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = join_lookup(facts, counts, ["k"], "n", chunk=1_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spread = joined.where("k = -1").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in spread) == 20_000 and max(r["count"] for r in spread) < 12_000


def test_hot_commit_is_split_by_adaptive_execution(spark, small_partitions):
    commits = spark.range(0, 2_000, 1, 4).selectExpr("'r' as repo", "id as commit_hash", "id as seq")
    changes = spark.range(0, 60_000, 1, 8).selectExpr(
        "'r' as repo", "if(id % 3 < 2, 7, id % 1000) as commit_hash", "concat('f', sha2(cast(id as string), 256)) as path"
    )
    found = history.commit_files(commits, changes)
    assert found.toArrow().num_rows == 60_000 + 1_000
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin(skew=true)" in text.split("Initial Plan")[0]
