import statistics

import pytest
from pyspark.sql import functions as F

from repostrata.functions import documents, filters, keys
from repostrata.functions.distributions import correlation_p, incomplete_beta, normal_score, shapiro_p
from repostrata.functions.statements import count_statements

SAMPLE = '''
import unittest
import os
from pytest import mark
class T(unittest.TestCase):
    def test_a(self):
        x = f(1)
        self.assertTrue(x)
    def helper(self):
        pass
def prod():
    y = 1
    return g(y)
async def test_b():
    z = 1
'''


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "value", ["https://git.example/ada/engine.git", "https://git.example/ada/engine/",
              "https://git.example/ada/engine", "D:\\src\\engine", "/srv/src/engine/"]
)
def test_repo_name(spark, value):
    assert one(spark, value, keys.repo_name) == "engine"


def test_repo_name_keeps_git_inside_unless_legacy(spark):
    url = "https://github.com/foo/foo.github.io"
    assert one(spark, url, keys.repo_name) == "foo.github.io"
    assert one(spark, url, lambda c: keys.repo_name(c, legacy=True)) == "foohub.io"


def test_owner_paths_and_clean_url(spark):
    assert one(spark, "https://git.example/ada/engine", keys.repo_owner) == "ada"
    assert one(spark, "repo", keys.repo_owner) is None
    assert one(spark, "/srv/engine/core/mill.py", lambda c: keys.relative_path(c, "/srv/engine")) == "core/mill.py"
    assert one(spark, "https://git.example/u/engine", lambda c: keys.repo_path(c, "/srv")) == "/srv/engine"
    assert one(spark, "https://h/u/r.git/", keys.clean_url) == "https://h/u/r.git"
    assert one(spark, "\n  https://h/u/r \n", keys.clean_url) == "https://h/u/r"


@pytest.mark.parametrize(
    "kb,text", [(512, "512 KB"), (2048, "2.00 MB"), (3 * 1024 * 1024, "3.00 GB"), (1024 + 128, "1.12 MB")]
)
def test_size_text(spark, kb, text):
    df = spark.createDataFrame([(kb,)], "kb bigint").select(keys.size_text(F.col("kb")).alias("r"))
    assert df.first().r == text


def test_path_filter(spark, rows):
    paths = ["VENV/b.py", "src/venv/e.py", "src/.hid/c.py", "lib2/d.py", "a.txt", "b.py", "Docs/x.py", "src/_x.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = [p for (p,) in rows(filters.python_sources(df))]
    assert kept == ["b.py", "lib2/d.py", "src/_x.py", "src/venv/e.py"]
    anywhere = [p for (p,) in rows(filters.python_sources(df, depth="any"))]
    assert anywhere == ["b.py", "lib2/d.py", "src/_x.py"]
    ignored = [p for (p,) in rows(df.where(filters.lint_ignored(F.col("path"))))]
    assert ignored == ["src/.hid/c.py"]


def test_statement_rules():
    parsed, imports, classes, functions, production, test = count_statements(SAMPLE)
    assert parsed and (test, production) == (7, 5)
    assert (imports, classes, functions) == (["unittest"], ["T"], ["test_a"])
    _, imports, _, functions, production, test = count_statements(SAMPLE, strict=False)
    # The import from pytest, the async test and its assignment count as test code.
    assert (test, production, functions) == (10, 4, ["test_a", "test_b"])


@pytest.mark.parametrize("source", ["def broken(:", "a\0b", "(" * 5000, "x = " + "-" * 100_000 + "1"])
def test_unreadable_sources_are_flagged(source):
    assert count_statements(source) == (False, [], [], [], 0, 0)


def test_deep_nesting_is_counted():
    chain = "x = " + "+".join(["f()"] * 500)
    assert count_statements(chain)[4] == 501


def test_flatten_document(spark, rows):
    text = '{"a":1,"b":{"c":null,"d":[1,2],"x":{"y":2}},"e":{}}'
    df = spark.createDataFrame([("r", text)], "repo string, doc string").withColumn("doc", F.parse_json("doc"))
    flat = documents.flatten_document(df).select("key", F.to_json("value"))
    assert rows(flat) == [("a", "1"), ("b.c", "null"), ("b.d", "[1,2]"), ("b.x.y", "2")]


def test_flatten_deep_document(spark, rows):
    deep = "1"
    for i in range(12):
        deep = f'{{"k{i}":{deep},"odd <{i}>":[{{"x":1}}]}}'
    df = spark.createDataFrame([("r", deep), ("s", "{}"), ("t", None)], "repo string, doc string")
    flat = documents.flatten_document(df.withColumn("doc", F.parse_json("doc")))
    found = {r.key: r.v for r in flat.select("key", F.to_json("value").alias("v")).collect()}
    assert found[".".join(f"k{i}" for i in range(11, -1, -1))] == "1"
    assert found["k11.k10.odd <9>"] == '[{"x":1}]' and len([k for k in found if k]) == 13


def test_flatten_columns_and_column_order(spark):
    df = spark.sql("select named_struct('b', 1, 'a', named_struct('z', 2)) as s, 3 as r, array(1) as l")
    flat = documents.flatten_columns(df)
    assert flat.columns == ["s.b", "s.a.z", "r", "l"]
    assert documents.ordered(flat, ["r"]).columns == ["r", "l", "s.a.z", "s.b"]
    with pytest.raises(ValueError):
        documents.ordered(flat, ["repo"])


def test_empty_text_and_bad_dates_become_null(spark, rows):
    df = spark.createDataFrame([("", "bad"), ("x", "2020-01-01T00:00:00Z")], "a string, b string")
    typed = documents.empty_to_null(df).select("a", documents.utc_timestamp(F.col("b")).cast("string"))
    assert rows(typed) == [("x", "2020-01-01 00:00:00"), (None, None)]


def test_distributions():
    assert normal_score(1, 11) == statistics.NormalDist().inv_cdf(0.625 / 11.25)
    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)
    # Closed form for four degrees of freedom: t = 2 has a two-sided p of 0.1161165.
    r = (4 / (4 + 4)) ** 0.5
    assert correlation_p(r, 6) == pytest.approx(0.11611652351681559)
    assert correlation_p(0.001, 10**9) == pytest.approx(0.0, abs=1e-12)
    assert correlation_p(1.0, 10) == 0.0 and correlation_p(0.5, 2) is None
    assert shapiro_p(0.788814694835387, 11) == pytest.approx(0.006703814, abs=1e-8)
