import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from repostrata.llm import hadamard_codes as codes

ROWS = "vec_id long, embedding array<double>, label string, code string, part int"


def floored(x):
    return max(-codes.CLIP, min(codes.CLIP, math.floor(x * 256)))


def brute(rows, parts=16, entries=64, rounds=2):
    """``{position in rows: (code, error)}`` and the entries, in Python's integers, one distance after the other."""
    kept = [(k, i, v) for k, (i, v, _) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(-(-max(len(v) for _, _, v in kept) // parts), 1)
    cut = {}
    for k, _, v in kept:
        whole = [floored(x) for x in v] + [0] * (parts * width - len(v))
        cut[k] = [tuple(whole[p * width : (p + 1) * width]) for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[1] is None, r[1] or 0, r[2]))[:entries]
    books = [[cut[k][p] for k, _, _ in first] for p in range(parts)]

    def assign(k, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut[k][p], e)), n) for n, e in enumerate(books[p]))

    for _ in range(rounds):
        after = []
        for p in range(parts):
            held = defaultdict(list)
            for k in cut:
                held[assign(k, p)[1]].append(cut[k][p])
            after.append([tuple(sum(c) // len(held[n]) for c in zip(*held[n])) if n in held else e for n, e in enumerate(books[p])])
        books = after
    found = {k: [assign(k, p) for p in range(parts)] for k in cut}
    return {k: ("".join(f"{n:02x}" for _, n in f), sum(d for d, _ in f)) for k, f in found.items()}, books


def compare(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS).repartition(3)
    got = codes.report(df).collect()
    want, books = brute(rows)
    labels = defaultdict(int)
    for k, (_, error) in want.items():
        labels[rows[k][2]] += error
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    long = lambda n: n if n < 1 << 63 else None
    expected = sorted(((rows[k][0], code, long(error), long(labels[rows[k][2]]), digest) for k, (code, error) in want.items()), key=repr)
    assert sorted(map(tuple, got), key=repr) == expected


def random_rows(n, width, seed, scale=0.3):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=width) * scale).tolist(), rng.choice(["a", "b", None])) for i in range(n)]


@pytest.mark.parametrize("n, width", [(150, 64), (90, 48), (40, 16), (70, 80)])
def test_equals_brute_force(spark, n, width):
    compare(spark, random_rows(n, width, n))


def test_edge_cases(spark):
    """Nulls, NaN, infinities, short and empty vectors, ties, repeated rows and ids, few rows, null ids."""
    rows = random_rows(20, 32, 1)
    rows += [(100, None, "a"), (101, [1.0, None], "a"), (102, [math.nan] * 32, "b"), (103, [math.inf] + [0.0] * 31, None)]
    rows += [(104, [], "a"), (105, [0.5] * 5, "c"), rows[3], rows[3], (3, [0.0] * 32, "a"), (None, [0.25] * 32, None), (None, [0.1] * 32, "a")]
    compare(spark, rows)
    compare(spark, [(i % 3, [0.5] * 16, None) for i in range(200)])
    compare(spark, [(i, [float(i % 2)] * 16, "a") for i in range(100)])
    df = spark.createDataFrame([(1, None, None, "x", 1)], ROWS)
    assert codes.report(df).collect() == [] and codes.report(df).columns[-1] == "codebooks_sha256"
    assert codes.report(df.limit(0)).collect() == []


def test_large_components_stay_exact(spark):
    """Beyond 64 bits Python's integers take over, and an error that has no room is null."""
    rows = [(i, [(-1) ** i * 10.0**k + i for k in range(16)], "a") for i in range(30)]
    compare(spark, rows)
    compare(spark, [(i, [1e300 * (-1) ** i, 3e9 + i] * 16, None) for i in range(70)])


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 9), st.integers(0, 10**6), st.integers(1, 40))
def test_the_transform_keeps_distances(width, seed, n):
    """Nearest entries, ties included, are those of plain distances."""
    rng = np.random.default_rng(seed)
    vectors, entries = (rng.integers(-3, 4, (k, width)) for k in (n, 7))
    which, error = codes.nearest(codes.transform(vectors), codes.transform(entries))
    plain = ((vectors[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (which == plain.argmin(axis=1)).all() and (error == plain.min(axis=1)).all()


def test_sequency_order():
    for size in (1, 2, 4, 8, 16, 32):
        signs = codes._butterflies(np.eye(size, dtype=np.int64))[:, codes.sequency(size)]
        assert [(np.diff(row) != 0).sum() for row in signs.T] == list(range(size))


def test_a_hot_label(spark):
    rows = random_rows(60, 16, 9)
    rows = [(i, v, "hot" if i < 50 else None) for i, v, _ in rows]
    compare(spark, rows)
