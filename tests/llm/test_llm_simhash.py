import random
import re
import xxhash
from pyspark.sql import functions as F

from repostrata.llm import simhash
from repostrata.llm.components import components

DOCS = "doc_id long, text string, fp string, row_key int"


def slow_fingerprint(text):
    lowered = (text or "").translate({u: u + 32 for u in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint_matches_its_definition():
    rng = random.Random(3)
    texts = ["", "one", "one TWO", "É é x y", "a\x1fb c\td\n e", *(
        " ".join(rng.choice("alpha Beta gamma δ ε".split()) for _ in range(rng.randint(3, 60))) for _ in range(50)
    )]
    for text in texts:
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_links_equal_brute_force_at_every_level(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = set(base)
    for b in base:
        for _ in range(60):
            prints.add(b ^ sum(1 << p for p in rng.sample(range(64), rng.randint(1, 3))))
    for low in range(64):  # a dense group within six bits
        prints.add(base[0] ^ low)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = {
        (min(a, b), max(a, b))
        for a in signed
        for b in signed
        if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    }
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    for crowd in (256, 8, 2):
        rows = [(min(r.a, r.b), max(r.a, r.b)) for r in simhash.near_links(frame, crowd).collect()]
        assert len(rows) == len(set(rows))
        assert set(rows) == want


def test_components_equal_union_find(spark):
    rng = random.Random(11)
    links = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(50)]
    links += [(rng.randint(1000, 1300), rng.randint(1000, 1300)) for _ in range(150)]
    want = roots({n for e in links for n in e}, links)
    got = components(spark.createDataFrame(links + [(7, None)], "a long, b long"))
    looped = {a for a, b in links if a == b}
    rows = {r.node: r.root for r in got.collect()}
    assert all(rows.get(n, n) == r for n, r in want.items()) and set(rows) | looped >= set(want)


def test_groups_handle_nulls_empty_repeated_and_long(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(5, "a b c d"), (3, "A b  c\nd"), (3, "A b  c\nd"), (9, None), (8, ""), (None, "x y z"), (7, long)]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], DOCS)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.groups(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (9, 8), (8, 8), (None, None), (7, 7)], key=str)
    assert simhash.groups(docs.limit(0)).collect() == []


def test_deduplicate_keeps_one_row_of_each_group(spark):
    rows = [(5, "a b c d"), (3, "A b  c\nd"), (3, "A b  c\nd"), (None, None), (None, ""), (None, "x y z"), (2, "q r s t"), (None, "q r s t")]
    docs = spark.createDataFrame([(*r, "kept", i) for i, r in enumerate(rows)], DOCS)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    found = kept.collect()
    assert sorted(r.doc_id for r in found if r.doc_id is not None) == [2, 3]
    assert len([r for r in found if r.doc_id is None]) == 2  # the wordless group and "x y z"
    assert {r.fp for r in found} == {"kept"}


def test_whole_table_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r.doc_id: r for r in simhash.groups(docs).withColumn("fp", F.col("fp")).collect()}
    prints = {r.doc_id: slow_fingerprint(r.text) for r in docs.collect()}
    ids = sorted(prints)
    links = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    want = roots(ids, links)
    assert {i: found[i].fp & (1 << 64) - 1 for i in ids} == prints
    assert {i: found[i].component_id for i in ids} == want


def test_digest_of_many_links_does_not_overflow(spark):
    from repostrata.llm.components import _digest

    edges = spark.range(1_000_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert _digest(edges)[0] == 1_000_000
    assert _digest(edges.where("a > 0"))[1:] != _digest(edges)[1:]
