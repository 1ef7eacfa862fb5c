import hashlib
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from repostrata.operators import stats

# Weights of eleven men, the worked example of the test's first publication.
WEIGHTS = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]


@pytest.fixture
def frame():
    rng = np.random.default_rng(11)
    n = 600
    x = rng.normal(size=n)
    tied = np.where(rng.random(n) < 0.4, 0.0, np.round(x + rng.normal(size=n), 1))
    data = pd.DataFrame({"x": x, "tied": tied})
    data.loc[::17, "x"] = np.nan
    data.loc[::23, "tied"] = np.nan
    return data


@pytest.fixture
def df(spark, frame):
    return spark.createDataFrame(frame)


def test_describe(df, frame):
    got = {r.column: r for r in stats.describe(df, ["x", "tied"]).collect()}
    for column, want in frame.describe().items():
        row = got[column]
        assert [row["count"], row["mean"], row["std"], row["min"], row.p25, row.p50, row.p75, row["max"]] == pytest.approx(list(want))


def test_approximate_quartiles_are_values_near_the_exact_ones(df, frame):
    for row in stats.describe(df, ["x", "tied"], accuracy=10_000).collect():
        values = frame[row.column].dropna()
        for name, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
            assert (values < row[name]).mean() <= p + 0.01 and (values <= row[name]).mean() >= p - 0.01
        assert row["count"] == len(values)


def test_boxplot(df, frame):
    for row in stats.boxplot(df, ["x", "tied"]).collect():
        values = frame[row.column].dropna()
        q1, q2, q3 = values.quantile([0.25, 0.5, 0.75])
        inside = values[(values >= q1 - 1.5 * (q3 - q1)) & (values <= q3 + 1.5 * (q3 - q1))]
        assert [row.q1, row.median, row.q3, row.whisker_low, row.whisker_high] == pytest.approx([q1, q2, q3, inside.min(), inside.max()])
        assert row.outliers == len(values) - len(inside)


def test_average_rank(df, frame):
    ranks = frame.tied.rank()
    want = dict(zip(frame.tied, ranks))
    got = {r.value: r["rank"] for r in stats.average_rank(df, "tied").collect()}
    assert got == {v: r for v, r in want.items() if v == v}


def test_coefficients(df, frame):
    both = frame.dropna()
    pearson = stats.pearson(df, "x", "tied").first()
    assert pearson.n == len(both) and pearson.coefficient == pytest.approx(both.x.corr(both.tied))
    spearman = stats.spearman(df, "x", "tied").first()
    want = both.x.rank().corr(both.tied.rank())
    assert spearman.n == len(both) and spearman.coefficient == pytest.approx(want, abs=1e-12)
    assert 0 <= spearman.p_value < 1e-6


def test_p_value_by_permutation(spark):
    rng = random.Random(2)
    x, y = [rng.random() for _ in range(12)], [rng.random() for _ in range(12)]
    row = stats.pearson(spark.createDataFrame(list(zip(x, y)), "x double, y double"), "x", "y").first()
    extreme, trials = 0, 20_000
    for _ in range(trials):
        rng.shuffle(y)
        extreme += abs(statistics.correlation(x, y)) >= abs(row.coefficient)
    assert row.p_value == pytest.approx(extreme / trials, abs=0.02)


def test_constant_metric_has_no_coefficient(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "x double, y double")
    row = stats.spearman(df, "x", "y").first()
    assert row.n == 3 and row.coefficient is None and row.p_value is None
    assert stats.shapiro(df, ["x"]).first().statistic is None


def test_shapiro_golden(spark):
    row = stats.shapiro(spark.createDataFrame([(w,) for w in WEIGHTS], "w long"), ["w"]).first()
    assert (row.n, round(row.statistic, 5), round(row.p_value, 5)) == (11, 0.78881, 0.0067)


def test_shapiro_with_large_ties_in_chunks(spark, monkeypatch):
    """A tie that spans many chunks gives the same statistic as one that fits in one."""
    df = spark.range(3000).select(F.when(F.col("id") < 1800, 0.0).otherwise(F.sqrt("id")).alias("v"))
    whole = stats.shapiro(df, ["v"]).first()
    monkeypatch.setattr(stats, "_CHUNK", 64)
    chunked = stats.shapiro(df, ["v"]).first()
    assert chunked.statistic == pytest.approx(whole.statistic, abs=1e-12)
    scores = [statistics.NormalDist().inv_cdf((i - 0.375) / 3000.25) for i in range(1, 3001)]
    values = [0.0] * 1800 + [i**0.5 for i in range(1800, 3000)]
    near = statistics.correlation(scores, values) ** 2
    assert whole.statistic == pytest.approx(near, abs=2e-3)


def test_normal_and_skewed_samples(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"bell": rng.normal(size=300), "skew": rng.exponential(size=300)})
    got = {r.column: r.p_value for r in stats.shapiro(spark.createDataFrame(frame), ["bell", "skew"]).collect()}
    assert got["bell"] > 0.05 > got["skew"]


@pytest.mark.parametrize(
    "value,want", [(0.7, "moderate"), (0.71, "strong"), (0.3, "weak"), (-0.31, "moderate"), (0.1, "no"), (0.0, "no")]
)
def test_strength(spark, value, want):
    df = spark.createDataFrame([(value,)], "r double").select(stats.strength(F.col("r")).alias("s"))
    assert df.first().s == want


def test_correlate_chooses_the_method(spark):
    rng = np.random.default_rng(8)
    bell = rng.normal(size=200)
    frame = pd.DataFrame({"x": bell, "y": bell + rng.normal(size=200) / 10, "skew": np.exp(-3 * bell)})
    df = spark.createDataFrame(frame)
    normal = stats.correlate(df, "x", "y").first()
    assert (normal.method, normal.strength, normal.direction, normal.significant) == ("Pearson", "strong", "positive", True)
    ranked = stats.correlate(df, "x", "skew").first()
    assert (ranked.method, ranked.coefficient, ranked.direction) == ("Spearman", pytest.approx(-1.0), "negative")


def test_summaries_of_batches_add_up(spark):
    rng = np.random.default_rng(3)
    data = pd.DataFrame({"batch": rng.integers(0, 5, 20_000), "x": rng.normal(5, 2, 20_000), "y": rng.integers(0, 9, 20_000).astype(float)})
    df = spark.createDataFrame(data)
    parts = stats.summaries(df, ["x", "y"], ["batch"])
    assert parts.count() == 10
    got = {r.column: r for r in stats.merged(parts).collect()}
    error = 0.005  # of the ranks; the sketches promise 0.0028 with a probability of 0.99
    for name in ("x", "y"):
        values = data[name]
        row = got[name]
        assert row["count"] == 20_000 and row.mean == pytest.approx(values.mean()) and row.std == pytest.approx(values.std())
        assert (row.min, row.max) == (values.min(), values.max())
        for q, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
            assert values.quantile(p - error) <= row[q] <= values.quantile(p + error)
    one = stats.merged(stats.summaries(df.where("x > 100").unionByName(df.limit(1)), ["x"])).head()
    assert one["count"] == 1 and one.std is None and one.p50 == one.min == one.max
    assert stats.merged(stats.summaries(df.limit(0), ["x"])).count() == 0


def test_a_sample_by_hash_does_not_depend_on_the_order(spark, rows):
    df = spark.range(3000).selectExpr("id", "cast(id % 77 as double) as x", "if(id % 3 = 0, null, cast(id as double)) as y")
    got = rows(stats.smallest(df, ["x", "y"], ["id"], 100))
    assert got == rows(stats.smallest(df.repartition(7).orderBy(F.rand(1)), ["x", "y"], ["id"], 100))
    hashes = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i in range(3000))
    want = [("x", float(i % 77)) for _, i in hashes[:100]] + [("y", float(i)) for _, i in [h for h in hashes if h[1] % 3][:100]]
    assert got == sorted(want, key=repr)
    small = df.where("id < 50")
    assert rows(stats.shapiro(small, ["x"], ["id"])) == rows(stats.shapiro(small, ["x"]))
    assert {r.column: r.n for r in stats.shapiro(df, ["x", "y"], ["id"], 200).collect()} == {"x": 200, "y": 200}
