import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from repostrata.llm import lexical_search

DOCS = "doc_id long, text string, score string, rank int"
ITEMS = "item_id long, text string, doc_id string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {upper: upper + 32 for upper in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, best=10):
    """All scores, one document after the other."""
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    counted = [c for c in counted if c[2]]
    n_docs, length = len(counted), sum(c[2] for c in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = set()
    for item, wanted in asked.items():
        scored = []
        for i, c, n in counted:
            m = 10 + (90 * n * n_docs) // length
            w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in wanted if c[t]}
            scored.append((-sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in w), i is None, i or 0, i))
        ranked = [s for s in sorted(scored, key=lambda s: s[:3]) if s[0] < 0][:best]
        out |= {(item, place, i, -score) for place, (score, _, _, i) in enumerate(ranked, 1)}
    return out


def fixture(n=200, seed=3):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(4000)] + ["Über", "日本", "a1"]
    text = lambda k: rng.choice(["", " ", "-"]).join([" ".join(rng.choices(words, k=k)), "x_y", rng.choice("?!")])
    docs = [(i, text(rng.randrange(1, 120))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "?!"), (None, docs[0][1]), (3, docs[3][1]), (n + 3, docs[4][1]), (n + 4, "w1 " * 60_000)]
    items = [(i, text(rng.randrange(1, 40))) for i in range(12)] + [(20, None), (21, "unknownterm"), (None, "w1 w2"), (22, "w1 " * 30), (22, "w3")]
    return docs, items


@pytest.mark.parametrize("piece, part", [(lexical_search.PIECE, lexical_search.PART), (500, 40), (1, 1)])
def test_equals_brute_force(spark, monkeypatch, piece, part):
    """In one piece and many, with all queries at once and in parts."""
    monkeypatch.setattr(lexical_search, "PIECE", piece)
    docs, items = fixture(60 if piece == 1 else 200)
    items = items[:4] + items[-4:] if piece == 1 else items
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(*i, "y") for i in items], ITEMS)
    got = lexical_search.rank(frame, asked, part=part).collect()
    assert len(got) == len({(r.item_id, r["rank"]) for r in got})
    assert {(r.item_id, r["rank"], r.doc_id, r.score) for r in got} == brute(docs, items)


def test_empty_tables(spark):
    docs, items = fixture(5)
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS)
    asked = spark.createDataFrame([(*i, "y") for i in items], ITEMS)
    for d, i in ((frame.limit(0), asked), (frame, asked.limit(0)), (frame.where("text = '?!'"), asked)):
        found = lexical_search.rank(d, i)
        assert found.collect() == [] and found.columns == ["item_id", "rank", "doc_id", "score"]
    assert dict(found.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_ties_at_the_last_place_go_to_the_smaller_id(spark):
    docs = [(i, "same words here") for i in range(40, 0, -1)] + [(100, "other")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS).repartition(7)
    got = lexical_search.rank(frame, spark.createDataFrame([(1, "Same HERE", "y")], ITEMS)).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 11))


def test_common_lists_open_no_accumulators():
    """The commonest list is only looked up, and the result is that of adding all up."""
    rng = np.random.default_rng(5)
    n_docs, sizes = 5000, [8, 12, 20, 300, 4500, 5000]
    docs = [np.sort(rng.choice(n_docs, s, replace=False)) for s in sizes]
    impact = [rng.integers(1, 900_000, s) for s in sizes]
    lists = lexical_search.Postings(np.repeat(np.arange(6), sizes), np.concatenate(docs), np.concatenate(impact), 6, n_docs)
    weights = np.array([9000, 8000, 7000, 1500, 20, 5])
    found, scores, opened = lexical_search.search(lists, np.arange(6), weights, 10)
    assert opened <= 4
    full = np.zeros(n_docs, np.int64)
    for d, i, w in zip(docs, impact, weights):
        full[d] += w * i
    want = np.lexsort((np.arange(n_docs), -full))[:10]
    order = np.lexsort((found, -scores))[:10]
    assert (found[order] == want).all() and (scores[order] == full[want]).all()
