import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from repostrata.llm import mixing

DOCS = "doc_id long, text string, source string, size string, number int"


@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_targets(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    found = mixing.targets(sizes, weights, sum(sizes))
    assert sum(found) == pytest.approx(sum(sizes))
    assert all(t <= 3 * s + 1e-6 for t, s in zip(found, sizes))
    free = [(t / w) for t, w, s in zip(found, weights, sizes) if t < 3 * s - 1e-6]
    assert not free or max(free) == pytest.approx(min(free))
    for t, w, s in zip(found, weights, sizes):  # a capped source would get more by weight
        if free and s and t >= 3 * s - 1e-6:
            assert w * free[0] >= 3 * s - 1e-6


def test_draws_meet_the_totals():
    draws = mixing.shard_draws([100, 0, 7, 1000], 9)
    assert draws.sum(axis=0).tolist() == [100, 0, 7, 1000] and (draws >= 0).all()
    assert np.ptp(draws.sum(axis=1)) <= 1 and len({tuple(d) for d in draws.tolist()}) > 1


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(size):
    image = mixing.permuted(np.arange(size), size, 5)
    assert sorted(image.tolist()) == list(range(size))
    assert size < 64 or (image != mixing.permuted(np.arange(size), size, 6)).any()


def fixture(spark):
    rows = [(i, " ".join(f"{s}{i}_{k}" for k in range(i % 40)), s) for s, n in (("a", 90), ("b", 40), ("c", 10), ("é", 30)) for i in range(n)]
    rows += [(5, None, "a"), (6, "", None), (7, "one two", None), (None, "x y z", "b"), (8, "same words here", "c"), (8, "same words here", "c")]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)


def test_report_and_mix_agree(spark):
    docs = fixture(spark)
    report = mixing.report(docs, block=16, shards=5).collect()
    assert len(report) == docs.count() and all(0 <= r.taken <= 3 * r.size for r in report)
    mixed = mixing.mixed(docs, block=16, shards=5).collect()
    slots = {}
    for r in mixed:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.n_words == len(r.text.split()) <= 16
    assert len(slots) == 5 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(r.n_words for r in mixed) == sum(r.taken for r in report)
    words = [w for r in mixed for w in r.text.split()]
    for row in report:  # words of the first source name their document
        if row.doc_id is not None and row.size == row.doc_id % 40 > 2 and row.doc_id >= 40:
            assert row.taken == sum(w.startswith((f"a{row.doc_id}_",)) for w in words)
    per_source = {}
    for r in report:
        key = r.source_size
        taken, target = per_source.get(key, (0, r.target))
        per_source[key] = (taken + r.taken, target)
    assert all(abs(taken - target) <= 24 for taken, target in per_source.values())


def test_reruns_agree_whatever_the_partitions(spark):
    docs = fixture(spark)
    first = sorted(map(tuple, mixing.report(docs, block=16).collect()), key=str)
    assert first == sorted(map(tuple, mixing.report(docs.repartition(7, "text"), block=16).collect()), key=str)


def test_empty_tables(spark):
    docs = fixture(spark).limit(0)
    assert mixing.report(docs).collect() == [] and mixing.mixed(docs).collect() == []
    blank = spark.createDataFrame([(1, None, None, "x", 1)], DOCS)
    assert tuple(mixing.report(blank).head()) == (1, 0, 0, 0.0, 0) and mixing.mixed(blank).collect() == []


def test_shards_grow_with_the_slots(spark, monkeypatch):
    sources = spark.createDataFrame([(0, 900, 300), (1, 400, 200)], "number int, n_slots long, n_blocks long")
    count = lambda: mixing.slots(sources, 4).select("shard").distinct().count()
    assert count() == 4
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 100)
    found = mixing.slots(sources, 4)
    assert count() == 13 and found.count() == 1300
    assert found.select("shard", "slot").distinct().count() == 1300
