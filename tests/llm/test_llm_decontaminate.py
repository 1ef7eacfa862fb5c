import random
import re

from repostrata.llm import decontaminate

DOCS = "doc_id long, text string, n_hit string, ranges int"
ITEMS = "item_id long, text string, n_words int"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({u: u + 32 for u in range(65, 91)}))


def brute(text, items):
    words, hit, found = words_of(text), set(), set()
    for item, own in items:
        own = words_of(own)
        size = min(13, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add(item)
    return len(words), len(hit), len(found)


def fixture():
    rng = random.Random(7)
    vocabulary = "an be ca do en fo gé hü 12 i-j k".split()
    items = [(i, " ".join(rng.choice(vocabulary[:6]) for _ in range(rng.choice([1, 5, 13, 14, 30, 60])))) for i in range(12)]
    items += [(3, "Other, text of item three goes here."), (77, None), (78, "?! --")]
    docs = []
    for i in range(60):
        parts = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        own = (rng.choice(items)[1] or "").split()
        start = rng.randint(0, len(own))
        docs.append((i, ", ".join([*parts[:9], *own[start : start + rng.randint(1, 40)], *parts[9:]]).upper()))
    return docs + [(60, None), (61, ""), (61, ""), (None, items[3][1])], items


def test_matches_equal_brute_force_in_one_part_or_many(spark):
    rows, items = fixture()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    bench = spark.createDataFrame([(*i, 0) for i in items], ITEMS)
    want = sorted(((d, *brute(t, items)) for d, t in rows), key=str)
    for limit in (decontaminate.MAX_BYTES, 200):
        report = decontaminate.report(docs, bench, limit).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in report), key=str) == want
        kept = decontaminate.clean(docs, bench, limit)
        assert kept.columns == docs.columns
        keep = [d for d, n, h, _ in want if not (h > 0 and 20 * h >= n)]
        assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(keep, key=str)


def test_spans_point_into_the_original(spark):
    docs = spark.createDataFrame([(1, "Éa!  Bé\nCÉ -- d;", "x", 1)], DOCS)
    bench = spark.createDataFrame([(5, "bé cÉ", 0)], ITEMS)
    row = decontaminate.spans(docs, bench).head()
    assert (row.start, row.end, row.passage) == (5, 10, "Bé\nCÉ")


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 1)], DOCS)
    none = spark.createDataFrame([], ITEMS)
    assert decontaminate.report(docs, none).head().n_items == 0
    assert decontaminate.report(docs.limit(0), none).collect() == []
    assert decontaminate.clean(docs, none).count() == 1
