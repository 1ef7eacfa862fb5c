import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from repostrata.operators import lint, metadata, stars, testcode
from repostrata.plans import tables
from repostrata.plans.api import analyze

MESSAGES = "repo string, commit_hash string, committer_date timestamp, module string, category string, msg_id string, symbol string, msg string, confidence string, path string"


@pytest.fixture
def messages(spark):
    def row(module, category, msg_id, symbol, msg):
        return ("r", "c", None, module, category, msg_id, symbol, msg, "HIGH", f"{module}.py")

    data = [
        row("m", "refactor", "R1260", "too-complex", "f is too complex. The McCabe rating is 12"),
        row("m", "refactor", "R1260", "too-complex", "g is too complex. The McCabe rating is 8"),
        row("m", "convention", "C0114", "missing-module-docstring", "Missing module docstring"),
        row("n", "convention", "C0114", "missing-module-docstring", "Missing module docstring"),
    ]
    return spark.createDataFrame(data, MESSAGES)


def test_message_counts(messages, rows):
    got = rows(lint.message_counts(messages), "level", "module", "category", "msg_id", "messages")
    assert got == [
        (0, "m", "convention", "C0114", 1), (0, "m", "refactor", "R1260", 2), (0, "n", "convention", "C0114", 1),
        (1, "m", "convention", None, 1), (1, "m", "refactor", None, 2), (1, "n", "convention", None, 1),
        (3, "m", None, None, 3), (3, "n", None, None, 1), (7, None, None, None, 4),
    ]


def test_mccabe(messages, rows):
    assert rows(lint.mccabe(messages)) == [("r", "c", 10.0)]
    assert rows(lint.mccabe(messages.where("symbol <> 'too-complex'"))) == [("r", "c", 0.0)]


@pytest.mark.parametrize("text,want", [("rating is 12", 12), ("12", 12), ("x12 y", None), ("1.5 then 7 or 8", 7), ("", None)])
def test_complexity_in(spark, text, want):
    df = spark.createDataFrame([(text,)], "m string").select(lint.complexity_in(F.col("m")).alias("r"))
    assert df.first().r == want


@pytest.fixture
def stats(spark):
    values = {
        "stats.by_msg.too-complex": 2.0, "stats.by_msg.lost": 1.0, "stats.by_module.m.total": 3.0,
        "stats.dependencies.util": 1.0, "stats.duplicated_lines.x": 1.0, "stats.refactor": 2.0,
        "stats.node_count.klass": 4.0, "stats.bad_names.klass": 0.0, "stats.statement": 9.0,
    }
    data = [("r", "c", None, k, v) for k, v in values.items()]
    return spark.createDataFrame(data, "repo string, commit_hash string, committer_date timestamp, key string, value double")


def test_lint_table(spark, messages, stats, rows):
    ids = spark.createDataFrame([("too-complex", "R1260")], "symbol string, msg_id string")
    assert rows(lint.unknown_symbols(stats, ids)) == [("lost",)]
    found = tables.lint_rows(stats, messages, ids)
    keys = {r.key for r in found.collect()}
    table = tables.lint_table(stats, messages, ids, keys - {"avg_mccabe_complexity"})
    assert table.columns == [*lint.FIXED_COLUMNS, "bad_names.klass", "node_count.klass", "R1260.too-complex"]
    row = table.first()
    assert (row["refactor"], row["statement"], row["avg_mccabe_complexity"]) == (2.0, 9.0, 10.0)
    assert (row["R1260.too-complex"], row["bad_names.klass"], row["fatal"]) == (2.0, 0.0, None)


SOURCES = "repo string, commit_hash string, committer_date string, path string, content string"


@pytest.fixture
def sources(spark):
    test = "import unittest\nclass T(unittest.TestCase):\n    def test_a(self):\n        x = f(1)\n"
    data = [
        ("r", "c1", "2020-01-01", "t.py", test), ("r", "c1", "2020-01-01", "p.py", "import os\n"),
        ("r", "c2", "2020-01-02", "t.py", test), ("r", "c2", "2020-01-02", "bad.py", "def broken(:"),
        ("r", "c3", "2020-01-03", "bad.py", "def broken(:"), ("r", "c4", "2020-01-04", "readme.txt", "x"),
        ("r", "c5", "2020-01-05", "empty.py", None), ("r", "c5", "2020-01-05", "pt.py", "import pytest, nose2\n"),
    ]
    return spark.createDataFrame(data, SOURCES).withColumn("committer_date", F.to_timestamp("committer_date"))


def test_test_table(sources, rows):
    got = rows(tables.test_table(sources).drop("date"))
    assert got == [
        ("r", "c1", 1, ["unittest"], 1, 5 / 6), ("r", "c2", 1, ["unittest"], 1, 1.0),
        ("r", "c3", 0, [], 0, 0.0), ("r", "c5", 0, ["nose2", "pytest"], 0, 1.0),
    ]  # "empty.py" has no text: it is not parsed and counts nothing
    found = testcode.classify(sources)
    assert rows(testcode.unparsable(found), "commit_hash", "path") == [("c2", "bad.py"), ("c3", "bad.py"), ("c5", "empty.py")]


EVENTS = "repo string, starred_at string, user_login string"


@pytest.fixture
def events(spark):
    data = [
        ("r1", "2020-01-01 10:00:00", "a"), ("r1", "2020-01-01 10:00:00", "b"), ("r1", "2020-01-03 00:00:00", "c"),
        ("r2", "2020-01-02 05:00:00", "a"), ("r2", None, "z"), ("r2", "2020-01-02 05:00:00", None),
    ]
    return spark.createDataFrame(data, EVENTS).withColumn("starred_at", F.to_timestamp("starred_at"))


def test_star_growth(events, rows):
    day = F.dayofmonth("date").alias("d")
    assert rows(stars.growth_long(events), "repo", day, "stargazers_count") == [("r1", 1, 2), ("r1", 3, 3), ("r2", 2, 1)]
    wide = stars.growth_wide(events, ["r2", "r1"])
    assert wide.columns == ["date", "r1", "r2"]
    assert rows(wide, day, "r1", "r2") == [(1, 2, 0), (2, 2, 1), (3, 3, 1)]
    grid = rows(stars.growth_grid(events, ["r1", "r2"]), "repo", day, "stargazers_count")
    assert grid == [("r1", 1, 2), ("r1", 2, 2), ("r1", 3, 3), ("r2", 1, 0), ("r2", 2, 1), ("r2", 3, 1)]
    assert [n for (n,) in rows(stars.star_numbers(events).where("repo = 'r1'"), "star_number")] == [1, 2, 3]


def test_wide_growth_matches_the_frame_version(spark, rows):
    """Running count per repository, pivoted on the date and filled forward."""
    frame = pd.DataFrame({"i": range(500)})
    frame["repo"] = "r" + (frame.i * 7 % 4).astype(str)
    frame["date"] = pd.Timestamp("2020-01-01") + pd.to_timedelta(frame.i * 37 % 211, unit="h")
    frame = frame.sort_values("date", kind="stable")
    frame["n"] = frame.groupby("repo").cumcount() + 1
    want = frame.pivot_table(index="date", columns="repo", values="n", aggfunc="last").ffill().fillna(0).astype(int)
    events = spark.createDataFrame(frame[["repo", "date", "i"]]).toDF("repo", "starred_at", "user_login")
    got = stars.growth_wide(events, ["r0", "r1", "r2", "r3"]).toPandas().set_index("date").sort_index()
    assert (got.to_numpy() == want.to_numpy()).all() and (got.index == want.index).all()
    long = stars.growth_long(events).toPandas()
    assert all(want.loc[row.date, row.repo] == row.stargazers_count for row in long.itertuples())
    assert long.groupby("repo").stargazers_count.max().sum() == 500


def document(**fields):
    base = {
        "createdAt": "2020-01-01T00:00:00Z", "archivedAt": None, "description": "", "diskUsage": 2048,
        "licenseInfo": None, "resourcePath": "/o/repo.git", "owner": {"login": "o"},
        "languages": {"totalSize": 3, "edges": [{"size": 1, "node": {"name": "C"}}, {"size": 2, "node": {"name": "Py"}}]},
    }
    return json.dumps(base | fields)


def test_metadata_table(spark):
    data = [("x", document()), ("y", document(resourcePath=None, createdAt="bad", languages={"totalSize": 0, "edges": []}))]
    docs = spark.createDataFrame(data, "repo string, doc string")
    first, second = metadata.metadata_table(docs).orderBy("repo").collect()
    assert (first.repo, first.diskUsage, first.description, first["owner.login"], first["licenseInfo.name"]) == ("repo", 2.0, None, "o", None)
    assert [tuple(p) for p in first.languages] == [("C", 33.3), ("Py", 66.7)]
    assert (second.repo, second.createdAt, second.languages) == ("y", None, [])
    columns = metadata.metadata_table(docs).columns
    assert columns[0] == "repo" and columns[1:] == sorted(columns[1:]) and len(columns) == 34
    variant = metadata.metadata_table(docs.withColumn("doc", F.parse_json("doc")))
    assert variant.orderBy("repo").collect() == [first, second]


def test_language_shares(spark, rows):
    data = [("r", f"L{i:02}", 5) for i in range(12)] + [("z", "none", 0)]
    got = rows(metadata.language_shares(spark.createDataFrame(data, "repo string, language string, size long")))
    assert len(got) == 10 and got[0] == ("r", 1, "L00", 5, 8.3) and got[-1][1:3] == (9, "L08")


def test_analyze(spark, sources, events, rows):
    found = analyze({"source_files": sources, "star_events": events}, ["test", "stars"], star_repos=["r1"])
    assert sorted(found) == ["star_growth", "stargazers", "test"]
    assert found["test"].count() == 4
    for wrong in ([], ["clone"]):
        with pytest.raises(ValueError):
            analyze({}, wrong)
