import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from repostrata.llm import ngram_quality as nq


def slow_model(texts, order):
    """Interpolated modified Kneser-Ney over bytes, from dictionaries."""
    edge = b"\n" * (order - 1)
    counts = Counter((edge + t)[i : i + order] for t in texts for i in range(len(t)))
    tables = []
    for length in range(order, 0, -1):
        seen = Counter(counts.values())
        n1, n2, n3, n4 = (seen[k] for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        raw = [k - (k + 1) * y * b / a if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        d = [min(max(v, 0.05 * k), 0.95 * k) for k, v in zip((1, 2, 3), raw)]
        total, given = defaultdict(int), defaultdict(float)
        for g, n in counts.items():
            total[g[:-1]] += n
            given[g[:-1]] += d[min(n, 3) - 1]
        tables.append((counts, d, total, given))
        below = Counter()
        for g in counts:
            below[g[1:]] += 1
        counts = below

    def chance(gram, level=0):
        if level == order:
            return 1 / 256
        counts, d, total, given = tables[level]
        lower = chance(gram[1:], level + 1)
        if gram[:-1] not in total:
            return lower
        n = counts.get(gram, 0)
        own = (n - d[min(n, 3) - 1]) / total[gram[:-1]] if n else 0.0
        return own + given[gram[:-1]] / total[gram[:-1]] * lower

    return chance


@pytest.mark.parametrize("order, block", [(2, 1024), (3, 1024), (5, 1024), (5, 1)])
def test_perplexities_equal_brute_force(spark, monkeypatch, order, block):
    monkeypatch.setattr(nq, "BLOCK", block)
    rng = random.Random(order)
    trusted = [bytes(rng.choice(b"abcde f") for _ in range(rng.randint(0, 80))) for _ in range(40)]
    asked = trusted[:5] + [b"zebra \xc3\xa9", b"a", b"ab\nab"]
    chance = slow_model(trusted, order)
    context = b"ab"[-(order - 1) :].rjust(order - 1, b"\n")
    assert sum(chance(context + bytes([b])) for b in range(256)) == pytest.approx(1)
    docs = spark.createDataFrame([(i, t.decode(), None) for i, t in enumerate(asked)], "doc_id long, text string, lang string")
    good = spark.createDataFrame([(t.decode(),) for t in trusted] + [(None,)], "text string")
    edge = b"\n" * (order - 1)
    for row in nq.perplexities(docs.repartition(3), good, order, frame=64).collect():
        text = asked[row.doc_id]
        logs = [math.log(chance((edge + text)[i : i + order])) for i in range(len(text))]
        assert row.n_tokens == len(text)
        if text:
            assert row.perplexity == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-9)


def test_judge_edge_cases(spark):
    rows = [(i, "plain words in a row " * 5, "en") for i in range(30)]
    rows += [(30, None, "en"), (31, "", "en"), (32, "#$%^ &*() {}|:" * 9, "en"), (33, "plain words", None), (33, "plain words", None), (None, "plain words", "xx")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, perplexity string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(0, 1), (None, 1), (5, None)], "doc_id long, quality int")
    got = nq.judge(docs, labels).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert len(got) == len(rows)
    assert not kept[30] and not kept[31] and not kept[32] and kept[3] and kept[25]
    assert all(r.threshold is not None for r in got)
    none = nq.judge(docs, labels.limit(0)).collect()
    assert {r.doc_id: r.kept for r in none}[32] and not {r.doc_id: r.kept for r in none}[30]
    assert nq.judge(docs.limit(0), labels).collect() == []


def test_trusted_text_is_exact(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    labels = spark.range(0, 500, 7).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert {r.text for r in nq.trusted_text(docs, labels).collect()} == {str(i) for i in range(0, 500, 7)}


def test_good_documents_are_told_from_bad(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where("doc_id % 4 <> 1")
    got = nq.judge(docs, seen).join(labels.where("doc_id % 4 = 1"), "doc_id")
    rates = {r.quality: r.rate for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("rate")).collect()}
    assert rates[1] > 0.95 and rates[0] < 0.2


def test_lists_are_packed_without_loss():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 5000):
        values = np.sort(rng.choice(1 << 40, n, replace=False).astype(np.int64))
        assert (nq.unpack_sorted(nq.pack_sorted(values), n) == values).all()


def test_a_small_language_is_drawn_towards_the_common_threshold(spark):
    """No switch: the threshold moves with every trusted document of a language."""
    rng = random.Random(3)
    text = lambda letters: "".join(rng.choice(letters) for _ in range(200))
    rows = [(i, text("abcd e"), "aa") for i in range(400)] + [(1000 + i, text("tuvwxyz q"), "tt") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    limits = []
    for known in (0, 20, 60):
        labels = spark.createDataFrame([(i, 1) for i in range(400)] + [(1000 + i, 1) for i in range(known)], "doc_id long, quality int")
        found = nq.judge(docs, labels).select("lang", "threshold").distinct().collect()
        limits.append({r.lang: r.threshold for r in found})
    assert limits[0]["tt"] == pytest.approx(limits[0]["aa"])
    assert limits[0]["tt"] < limits[1]["tt"] != limits[2]["tt"]
    assert all(found["aa"] < found["tt"] for found in limits[1:])
