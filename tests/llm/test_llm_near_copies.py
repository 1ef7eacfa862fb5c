import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from repostrata import session
from repostrata.llm import near_copies, simhash
from repostrata.llm.common import table
from repostrata.llm.components import components


def slow_shingles(text):
    words = (text or "").translate({u: u + 32 for u in range(65, 91)}).split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def slow_similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_planted_edited_copies_are_removed(spark):
    rng = random.Random(2)
    rows = []
    for base in range(60):
        words = [f"w{rng.randrange(4000)}" for _ in range(300)]
        rows.append((3 * base, " ".join(words)))
        for copy, edits in ((1, 5), (2, 40)):  # similarity about 0.85, and far below 0.8
            own = list(words)
            for at in rng.sample(range(2, 298), edits):
                own[at] = f"new{rng.randrange(10**6)}"
            rows.append((3 * base + copy, " ".join(own)))
    sets = {i: slow_shingles(t) for i, t in rows}
    edited = [i for i in sets if i % 3 == 1]
    assert all(slow_similar(sets[i], sets[i - 1]) for i in edited)
    assert not any(slow_similar(sets[i], sets[i - 2]) for i in sets if i % 3 == 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.deduplicate(docs).collect()} == set(sets) - set(edited)


def test_groups_equal_brute_force_on_the_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    sets = {r.doc_id: slow_shingles(r.text) for r in docs.collect()}
    group = {i: i for i in sets}
    by_shingle = {}
    for i in sorted(sets):
        for s in sets[i]:
            by_shingle.setdefault(s, []).append(i)
    links = {p for ids in by_shingle.values() if len(ids) < 60 for p in ((a, b) for a in ids for b in ids if a < b)}
    links = [(a, b) for a, b in links if slow_similar(sets[a], sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(group[a], group[b])
            changed = changed or group[a] != low or group[b] != low
            group[a] = group[b] = low
    got = {r.doc_id: r.component_id for r in near_copies.groups(docs).collect()}
    wrong = {i for i in got if got[i] != group[i] and len(sets[i]) > 1}
    assert len(links) > 12 and not wrong


def test_an_id_on_different_texts_loses_none(spark):
    rows = [(1, "one text"), (1, "another text"), (1, "Another  text"), (2, "one text"), (None, "third"), (None, "third"), (3, "fourth")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text.lower().split()[0]) for r in simhash.deduplicate(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, "one"), (1, "another"), (None, "third"), (3, "fourth")], key=str)


def brute(sets):
    """Smallest id reachable over pairs of similar sets."""
    group = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and slow_similar(sets[a], sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(group[a], group[b])
            changed = changed or group[a] != low or group[b] != low
            group[a] = group[b] = low
    return group


@pytest.mark.parametrize("block, hashes", [(near_copies.BLOCK, near_copies._HASHES), (7, 2000)])
def test_texts_of_one_template_in_blocks(spark, monkeypatch, block, hashes):
    """Texts around the limit, most of them unlinked, compared in whole keys and in small blocks."""
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "_HASHES", hashes)
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(90):
        words = list(base)
        for at in rng.sample(range(200), rng.choice([1, 3, 6, 9, 14])):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in near_copies.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute({i: slow_shingles(t) for i, t in rows})
    assert 10 < len(set(want.values())) < 80
    assert got == want


def test_a_template_costs_no_list_of_pairs(spark, monkeypatch):
    """300 texts at a similarity of about 0.7: every pair is a candidate, none is written."""
    written = []
    pin = near_copies.pinned
    monkeypatch.setattr(near_copies, "pinned", lambda df: written.append(pin(df)) or written[-1])
    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(300), 10):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = near_copies.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.select("component_id").distinct().count() == 300
    pairs = [df.count() for df in written if df.columns == ["a", "b"]]
    assert max(pairs, default=0) < 40 * 300


def test_fingerprints_propose_pairs_that_are_verified(spark, monkeypatch):
    """With no MinHash keys in common, texts of linked fingerprints still meet and are compared exactly."""
    words = [f"w{i}" for i in range(400)]
    edited = [*words[:399], "other"]
    texts = [" ".join(words), " ".join(edited), " ".join(f"v{i}" for i in range(400))]
    prints = [simhash.fingerprint(t.encode(), near_copies.WORDS) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 2 < (prints[0] ^ prints[2]).bit_count()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = {r.node: r.key for r in simhash.candidates(docs).collect()}
    assert len(keys) == 3 and len(set(keys.values())) == 2

    real = near_copies._signed

    def unkeyed(*args):
        found = real(*args)
        return found.withColumn("keys", F.array(F.col("node")))  # a key that no other text has

    monkeypatch.setattr(near_copies, "_signed", unkeyed)
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == [0, 2]


def batches_of(keys, nodes, size):
    columns = [keys, nodes, nodes, *([0] * len(nodes) for _ in near_copies._SKETCH)]
    whole = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "node", "root", *near_copies._SKETCH])
    return [whole.slice(at, size) for at in range(0, len(nodes), size)]


@pytest.mark.parametrize("size", [7, 1000, 10**6])
def test_first_links_of_a_key_are_a_tree_of_few_levels(size):
    """A chain of neighbours would be 3,000 links deep, and components take rounds by that."""
    rng = random.Random(3)
    groups = [sorted(rng.randrange(-(2**63), 2**63) for _ in range(n)) for n in (3000, 1, 2, 500)]
    keys = [k for k, nodes in enumerate(groups) for _ in nodes]
    out = list(near_copies._tree(iter(batches_of(keys, [n for g in groups for n in g], size))))
    up = {b: a for t in out for a, b in zip(t["a"].to_pylist(), t["b"].to_pylist())}
    assert sum(t.num_rows for t in out) == len(up) == 2999 + 0 + 1 + 499

    def depth(node):
        return 1 + depth(up[node]) if node in up else 0

    assert all(n in up or n == g[0] for g in groups for n in g)
    assert max(depth(n) for g in groups for n in g) <= 5


def test_texts_far_from_the_text_above_are_linked_to_their_neighbour():
    nodes = [32, 33, 35, 37]  # 32 is above the others
    (batch,) = batches_of([1] * 4, nodes, 4)
    far = [pa.array([-1, 0, 0, 0], pa.int64())] * len(near_copies._SKETCH)
    batch = pa.RecordBatch.from_arrays([*batch.columns[:3], *far], batch.schema.names)
    (out,) = near_copies._tree(iter([batch]))
    assert out.to_pydict() == {"a": [33, 35], "b": [35, 37]}


def test_components_keep_their_last_round_only(spark):
    base = session._base(spark)
    files, place = session.file_system(spark, base)
    count = lambda: len(files.listStatus(place)) if files.exists(place) else 0
    chain = spark.range(200).selectExpr("id as a", "id + 1 as b")
    before = count()
    got = {r.node: r.root for r in components(chain).collect()}
    assert got == {n: 0 for n in range(201)}
    assert count() == before + 1


def test_links_that_are_stars_take_no_round(spark, monkeypatch):
    from repostrata.llm import components as module

    monkeypatch.setattr(module, "_large_star", lambda edges: pytest.fail("a round"))
    stars = spark.range(1, 100).selectExpr("id as a", "if(id > 50, 50, 0) as b")
    stars = stars.where("a <> 50")
    got = {r.node: r.root for r in components(stars).collect()}
    assert got == {n: 50 if n >= 50 else 0 for n in range(100)}


def test_sketches_and_texts_are_not_left_in_the_shared_folder(spark):
    base = session._base(spark)
    files, place = session.file_system(spark, base)
    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(i, " ".join([*words, f"x{i}"])) for i in range(40)], "doc_id long, text string")
    old = {s.getPath().getName() for s in files.listStatus(place)} if files.exists(place) else set()
    assert near_copies.groups(docs).select("component_id").distinct().count() == 1
    new = [s.getPath().toString() for s in files.listStatus(place) if s.getPath().getName() not in old]
    columns = [spark.read.parquet(p).columns for p in new]
    assert ["node", "hashes"] not in columns and ["key", "node", *near_copies._SKETCH] not in columns
