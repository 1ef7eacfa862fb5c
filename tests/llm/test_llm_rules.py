import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from repostrata.llm import rules

DOCS = "doc_id long, text string, lang string, stratum string, n int"


def brute_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    return len({i + o for i, w in enumerate(windows) if counts[w] > 1 for o in range(3)})


def test_statistics_by_brute_force(spark):
    rng = random.Random(8)
    rows = [(None, None), (1, ""), (2, "a"), (3, "a\n\n \na\na b"), (4, "x y z x y z x"), (5, "é # $%\x1f w"), (6, "w x y " * 20_000)]
    rows += [(10 + i, "".join(rng.choice("ab ") + rng.choice(["", "", "\n", "#"]) for _ in range(rng.randint(0, 120)))) for i in range(60)]
    docs = spark.createDataFrame([(*r, None, "x", 1) for r in rows], DOCS)
    got = sorted(map(tuple, rules.base_statistics(docs).drop("lang").collect()), key=str)
    want = []
    for doc, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
        symbols = sum(c in "#*$%&|<>" for c in text)
        want.append((doc, len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), brute_repeats(words)))
    assert got == sorted(want, key=str)


def test_binomial_tail_is_exact(spark):
    cases = [(k, n, p) for n in (1, 5, 40, 300) for k in (0, 1, 2, 7, 14) for p in (0.01, 0.05, 0.3) if k <= n]
    for p in (0.01, 0.05, 0.3):
        own = [(k, n) for k, n, q in cases if q == p]
        frame = spark.createDataFrame(own, "k long, n long")
        for r in frame.withColumn("tail", rules.binomial_tail(F.col("k"), F.col("n"), p)).collect():
            exact = sum(math.comb(r.n, j) * p**j * (1 - p) ** (r.n - j) for j in range(r.k + 1))
            assert r.tail == pytest.approx(exact, rel=1e-9) or (r.tail == 1.0 and r.k >= r.n * p)


def test_false_rejections_stay_limited(spark):
    """Cutoffs chosen on one half reject few good documents of the other, in every stratum."""
    rng = random.Random(3)
    rows = []
    for i in range(12000):
        good = rng.random() < 0.8
        words = [rng.choice("alpha beta gamma delta words".split()) + str(rng.randint(0, 999)) for _ in range(60)]
        noise = rng.random() < (0.001 if good else 0.9)
        rows.append((i, " ".join(w + " ##" if noise else w for w in words), "en" if i % 2 else None, "x", int(good)))
    docs = spark.createDataFrame(rows, DOCS)
    labels = docs.where("doc_id % 3 > 0").select("doc_id", F.col("n").alias("quality"))
    got = rules.judge(docs, labels).join(docs.select("doc_id", "lang", "n"), "doc_id").where("doc_id % 3 = 0")
    rates = {(r.lang, r.n): r.kept for r in got.groupBy("lang", "n").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rates["en", 1] >= 0.95 and rates[None, 1] >= 0.95
    assert rates["en", 0] < 0.3 and rates[None, 0] < 0.3


def test_without_labels_only_base_rules_reject(spark):
    docs = spark.createDataFrame([(1, "# " * 60, "en", "x", 1), (1, " ".join(f"w{i} ##" for i in range(60)), "en", "x", 1), (None, None, None, "x", 1)], DOCS)
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    got = rules.judge(docs, none).collect()
    assert sorted((r.base_failed, r.kept) for r in got) == [(False, True), (True, False), (True, False)]
    assert rules.judge(docs.limit(0), none).collect() == []


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for frame in (rules.base_statistics(docs), rules.judge(docs, labels)):
        assert not any(w in frame._jdf.queryExecution().toString() for w in ("Python", "Pandas", "ArrowEval"))


def test_repeated_rows_are_one_trial(spark):
    """A document on many rows weighs in the thresholds as much as on one."""
    rows = [(i, " ".join(f"word{i}x{k}" for k in range(60 + i % 7)) + "\n" + "same line\n" * (i % 3), "en") for i in range(300)]
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string")
    once = {tuple(r) for r in rules.judge(make(rows), labels).collect()}
    often = rules.judge(make(rows + rows[:5] * 200), labels).collect()
    assert len(often) == 1300 and {tuple(r) for r in often} == once
