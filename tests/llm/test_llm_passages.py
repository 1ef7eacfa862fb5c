import random
import re

import pytest

from repostrata.llm import passages

DOCS = "doc_id long, text string, digest string, copies int"


def words_of(text):
    return text.lower().split()


def brute(rows, min_words=passages.MIN_WORDS):
    """Kept text per row: every stretch of units that stands earlier is taken out."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, out = set(), {}
    for i in order:
        text = rows[i][1] or ""
        own = passages.units(text)
        edges = [start for start, _ in own] + [len(text)]
        gone = set()
        for first in range(len(own)):
            for end in range(first + 1, len(own) + 1):
                held = words_of(text[edges[first] : edges[end]])
                if len(held) >= min_words:
                    if tuple(held) in seen:
                        gone.update(range(first, end))
                    seen.add(tuple(held))
                    break
        out[i] = "".join(text[edges[k] : edges[k + 1]] for k in range(len(own)) if k not in gone) if own else text
    return out


def sentence(rng, n, tag=""):
    return " ".join(f"w{rng.randrange(10**6)}{tag}" for _ in range(n)).capitalize() + rng.choice(".!?")


def planted():
    """Clean texts, and texts with one of ten passages of 55 to 80 words in the middle of lines."""
    rng = random.Random(4)
    shared = [" ".join(sentence(rng, rng.randint(5, 12)) for _ in range(8)) for _ in range(10)]
    stock = [sentence(rng, n) for n in (8, 14, 20)]
    rows, holders = [], {}
    for i in range(150):
        parts = [sentence(rng, rng.randint(3, 15)) for _ in range(10)]
        parts.insert(rng.randint(0, 9), rng.choice(stock))
        if i % 3 == 0:
            which = rng.randrange(10)
            text = shared[which].upper() if rng.random() < 0.3 else rng.choice([shared[which], shared[which].replace(" ", "  "), re.sub("([.!?]) ", "\\1\n", shared[which])])
            parts.insert(rng.randint(0, 10), text)
            holders.setdefault(which, []).append(i)
        rows.append((i, "".join(p + rng.choice([" ", "\n", "\n\n"]) for p in parts)))
    return rows, holders


def test_planted_passages_go_and_clean_texts_stay(spark):
    rows, holders = planted()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).repartition(5)
    got = {r.doc_id: r for r in passages.deduplicate(docs).collect()}
    later = {i for ids in holders.values() for i in ids[1:]}
    assert {i for i in got if got[i].n_removed} == later
    for i in later:
        assert got[i].chars_removed > 200
    for i, text in rows:  # the spans rebuild the text from the original
        assert "".join(text[s.start : s.end] for s in got[i].spans) == got[i].text
        assert len(text) - len(got[i].text) == got[i].chars_removed


def test_equals_brute_force(spark):
    rows, _ = planted()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).repartition(5)
    want = brute(rows)
    got = {r.doc_id: r.text for r in passages.deduplicate(docs).collect()}
    assert got == {rows[i][0]: t for i, t in want.items()}


def test_units_cover_the_text():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice(["ab", "cd.", "e!", " ", "  ", "\n", "\n\n", " ", "日本。", '"x."']) for _ in range(rng.randrange(200)))
        own = passages.units(text)
        starts = [s for s, _ in own]
        if not text.split():
            assert own == []
            continue
        assert starts[0] == 0 and starts == sorted(set(starts))
        assert [w for _, ws in own for w in ws] == words_of(text)
        for (start, ws), end in zip(own, [*starts[1:], len(text)]):
            assert words_of(text[start:end]) == ws and len(ws) <= passages.LONGEST


def test_text_without_sentence_ends_is_cut_alike(spark):
    rng = random.Random(8)
    run = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = run(400)
    rows = [(1, f"{run(50)} {passage} {run(60)}"), (2, f"{run(91)} {passage} {run(33)}"), (3, run(500)), (4, "the " * 300), (5, "of " * 5 + "the " * 400)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    got = {r.doc_id: r for r in passages.deduplicate(docs).collect()}
    assert got[1].n_removed == got[3].n_removed == 0
    left = len(words_of(got[2].text))
    assert 124 <= left < 124 + 2 * passages.LONGEST
    assert got[5].n_removed > 0


def test_edge_cases(spark):
    long = " ".join(f"word{k}" for k in range(passages.MIN_WORDS)) + "."
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, long), (4, "\n\n"), (5, f"x.\n{long}\n"), (6, "a " * 200_000), (7, "short line\n" * 3)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    got = passages.deduplicate(docs).collect()
    texts = sorted(((r.doc_id, r.text) for r in got if r.doc_id != 6), key=str)
    want = [(1, None), (2, ""), (3, long), (3, ""), (None, ""), (4, "\n\n"), (5, "x.\n"), (7, "short line\n" * 3)]
    assert texts == sorted(want, key=str)
    assert passages.deduplicate(docs.limit(0)).collect() == []
    plain = [(i, f"text number {i}") for i in range(5)]
    assert passages.deduplicate(spark.createDataFrame([(*r, "x", 1) for r in plain], DOCS)).where("n_removed > 0").isEmpty()


@pytest.mark.parametrize("folder", ["sf0.001"])
def test_whole_table_by_brute_force(spark, folder):
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    got = {r.doc_id: r.text for r in passages.deduplicate(docs).collect()}
    assert got == {rows[i][0]: t for i, t in want.items()}


def test_shares_on_the_table(spark):
    """Of documents with a run of 51 words of an earlier one, and of those that share none."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    first, later, holders = {}, set(), set()
    rows = sorted((r.doc_id, words_of(r.text or "")) for r in docs.collect())
    for i, words in rows:
        for k in range(len(words) - 50):
            at = first.setdefault(tuple(words[k : k + 51]), i)
            if at != i:
                later.add(i)
                holders |= {i, at}
    got = {r.doc_id: r.n_removed for r in passages.deduplicate(docs).collect()}
    caught = sum(got[i] > 0 for i in later) / len(later)
    alone = [got[i] == 0 for i, words in rows if i not in holders]
    assert len(later) > 80 and caught >= 0.95 and sum(alone) / len(alone) >= 0.92
