import numpy as np
import pandas as pd
import pytest

from repostrata.operators.prefix import running


@pytest.fixture
def skewed(spark):
    """One key holds most of the rows and spans every block."""
    rng = np.random.default_rng(7)
    n = 4000
    key = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 40, n))
    seen = np.where(rng.random(n) < 0.02, rng.integers(0, 9, n).astype(float), np.nan)
    return pd.DataFrame({"key": key, "at": rng.permutation(n), "v": rng.integers(0, 5, n), "seen": seen})


@pytest.mark.parametrize("keys", [["key"], []])
def test_running_matches_pandas(spark, skewed, keys):
    df = spark.createDataFrame(skewed.astype({"seen": object}).where(skewed.notna(), None), "key long, at long, v long, seen double")
    got = running(df, keys, ["at"], {"total": "v"}, {"latest": "seen"}, "place", blocks=7).toPandas()
    got = got.sort_values([*keys, "at"]).reset_index(drop=True)
    want = skewed.sort_values([*keys, "at"]).reset_index(drop=True)
    groups = want.groupby(keys) if keys else want.assign(one=0).groupby("one")
    assert (got["total"] == groups["v"].cumsum()).all()
    assert (got["place"] == groups.cumcount() + 1).all()
    assert got["latest"].astype(float).equals(groups["seen"].ffill())


def test_carry_is_as_short_as_the_blocks(spark, skewed):
    df = spark.createDataFrame(skewed[["key", "at", "v"]])
    plan = running(df, ["key"], ["at"], {"total": "v"})._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_null_keys_and_no_rows(spark, rows):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, at long")
    assert rows(running(df, ["k"], ["at"], number="n")) == [("a", 1, 1), (None, 1, 1), (None, 2, 2)]
    assert rows(running(df.where("at > 5"), ["k"], ["at"], number="n")) == []


def test_blocks_follow_the_written_size_not_the_estimate(spark, monkeypatch):
    """A plan above a join is estimated at the product of its sides."""
    from repostrata.operators import prefix

    chosen, count = [], prefix._blocks
    monkeypatch.setattr(prefix, "_blocks", lambda df: chosen.append(count(df)) or chosen[-1])
    left = spark.range(20_000).selectExpr("id % 50 as k", "id as at")
    joined = left.join(spark.range(50).selectExpr("id as k", "repeat('x', 200) as name"), "k")
    got = running(joined.groupBy("k", "at").count(), ["k"], ["at"], number="n")
    assert got.agg({"n": "max"}).head()[0] == 400
    assert chosen == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
    monkeypatch.setattr(prefix, "_BLOCK_BYTES", 1000)
    assert count(joined.sparkSession.read.parquet("/root/testdata/sf0.001/events.parquet")) > 4
