import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from repostrata.llm import deobfuscation as channel, toxicity
from repostrata.llm.common import in_bucket

FOLDER = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, score string, predicted int"


@pytest.fixture(scope="module")
def model():
    text = "you idiot are the one of a kind loser and moron is stupid worthless clown pathetic " * 50
    ids, counts = np.unique(channel.trigrams(text), return_counts=True)
    return channel.CharModel(channel.CharModel.fit(ids, counts))


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.fit(docs, labels, ~in_bucket("doc_id", 4, 2))


@pytest.mark.parametrize(
    "written, meant",
    [
        ("1d10t", "idiot"), ("m0r0n", "moron"), ("i d i o t", "idiot"), ("l.o.s.e.r", "loser"), ("LOOOOSER", "loser"),
        ("st*pid", "stupid"), ("cl0wn!", "clown"), ("$tup1d", "stupid"), ("p@thetic", "pathetic"), ("m-o-r-o-n", "moron"),
    ],
)
def test_disguises_are_undone(model, written, meant):
    assert channel.deobfuscate(f"you {written} there", model, {}) == f"you {meant} there"


def test_plain_text_is_left_alone(model):
    text = "A plain line, nothing odd. 12:30 and 555-1234; it is a movie…\nÉté"
    assert channel.deobfuscate(text, model, {}) == text.lower()
    assert channel.deobfuscate("", model, {}) == ""


def test_viterbi_equals_all_paths(model):
    rng = random.Random(1)
    for _ in range(60):
        stretch = "".join(rng.choice("mo01ri$tsp.*e") for _ in range(rng.randint(2, 6)))
        best = []
        for path in itertools.product(*channel._readings(stretch)):
            cost, x, y, text = 0.0, 0, 0, ""
            for letters, price in path:
                cost += price
                for char in letters:
                    z = channel.symbol(char)
                    if z or y:
                        cost += model.cost(x, y, z)
                    x, y = (0, 0) if not z else (y, z)
                text += letters
            best.append((cost + (model.cost(x, y, 0) if y else 0.0), text))
        found = channel.restore(stretch, model)
        lowest = min(best)[0]
        assert any(t == found and c == pytest.approx(lowest) for c, t in best)


def test_word_keys():
    keys, words = toxicity.word_keys("abc, abcdefghij é")
    assert words.tolist().count(0) == 2 and words.tolist().count(1) == 6
    assert int(keys[0]) == int.from_bytes(b"abc", "little")


def test_character_counts_cover_everything(spark):
    docs = spark.createDataFrame([(i, "ab ba", "x", 1) for i in range(50)] + [(9, None, "x", 1)], DOCS).repartition(4)
    logs = toxicity.char_model(docs)
    ids, counts = np.unique(channel.trigrams("ab ba"), return_counts=True)
    assert np.allclose(logs, channel.CharModel.fit(ids, counts * 50))


def test_held_out_documents(spark, learned):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.scores(docs.where(in_bucket("doc_id", 4, 2)), learned).join(labels, "doc_id")
    right, n = got.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")), F.count("*")).head()
    assert n > 50 and right > 0.93


def test_edge_cases(spark, learned):
    rows = [(1, None), (2, ""), (3, "you 1d10t and m0r0n, what a l o s e r, idi0t"), (None, "fine"), (4, "fine " * 100_000), (4, "?!")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    got = {r.doc_id: r for r in toxicity.scores(docs, learned).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert got[3].predicted == 1 and got[1].predicted == got[2].predicted == got[4].predicted == 0
    kept = toxicity.reject(docs, learned)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 4, 4]
    assert toxicity.scores(docs.limit(0), learned).collect() == []
    blank = toxicity.fit(docs, spark.createDataFrame([(1, None)], "doc_id long, toxic int"), F.lit(True))
    assert toxicity.scores(docs, blank).agg(F.max("score")).head()[0] == 0.0


def test_hint_covers_every_disguised_stretch():
    import random

    from repostrata.llm.deobfuscation import _STRETCH, _hinted

    rng = random.Random(4)
    lines = ["i·d·i·o·t", "b§tch", "id¡ot", "i - d - i - o - t", "i’d’i", "£ove", "1-2-3", "@i d i", "é é é", "a\U0001d41ac"]
    assert all(_STRETCH.search(line) for line in lines[:6])
    lines += ["".join(rng.choices("aaбß 1@§€·’-_.~ \U0001f600²\t", k=rng.randint(1, 9))) for _ in range(40_000)]
    for line in lines:
        assert not _STRETCH.search(line) or _hinted(line).tolist() == [0], line


def test_a_line_of_a_million_signs_is_read_in_seconds():
    rng = random.Random(2)
    model = channel.CharModel(channel.CharModel.fit(np.arange(10), np.ones(10)))
    for text in ("ab" * 500_000, "$" * 1_000_000, "aaa" + "$" * 300_000, "a." * 10 + "." * 500_000, "a$ " + "1" * 900_000, "a.b.c@" * 20_000):
        start = time.process_time()
        list(channel.stretches(text))
        assert time.process_time() - start < 5
    start = time.process_time()
    assert len(channel.deobfuscate("ab" * 500_000 + "\n" + "1d10t " * 2_000, model, {})) > 1_000_000
    assert time.process_time() - start < 5


def test_a_long_stretch_is_one_lattice():
    """A long stretch reads as its beginning and its end do by themselves, over any inner border."""
    rng = np.random.default_rng(4)
    model = channel.CharModel(channel.CharModel.fit(np.arange(128**3), rng.integers(1, 9, 128**3)))
    stretch = "".join(rng.choice(list("abe1$"), 6_000)) + "e"
    whole = channel.restore(stretch, model)
    for border in range(150, 1_000, 50):
        assert whole.startswith(channel.restore(stretch[:border], model)[: border // 2])
        assert whole.endswith(channel.restore(stretch[-border:], model)[-border // 2 :])
