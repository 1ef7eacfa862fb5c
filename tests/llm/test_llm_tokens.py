import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from repostrata.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, n_tokens string, n_bytes int"


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in own.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def rules():
    return token_counts.Vocabulary(PATH)


def counted(rules, texts):
    return token_counts.counter(rules)([t.encode() for t in texts])


def test_every_code_point_is_split_as_the_library_does(rules, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for around in ("a{0}b 1{0}2", " {0} x\n{0}", "'{0}!{0}{0} {0}s"):
        for at in range(0, len(points), 50_000):
            texts = [around.format(c) for c in points[at : at + 50_000]]
            assert counted(rules, texts) == library(texts)


def test_random_texts(rules, library):
    rng = random.Random(1)
    alphabets = ["ab", "abcdefghij ", "aA1 '\n\t.!sdt", "éü日本語 ab", "a", " \n", "\r\n   x", "'ll've're", "🙂👍🏽 z"]
    texts = ["".join(rng.choice(a) for _ in range(rng.randrange(700))) for a in alphabets * 60]
    texts += ["", " ", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext|> " * 9, "<|endoftext", "x<|ENDOFTEXT|>"]
    assert counted(rules, texts) == library(texts)


def test_long_sequences(rules, library):
    """Without a place to cut: merged rank by rank, in the time of their length."""
    rng = random.Random(2)
    texts = ["x" * 50_000, "ab" * 30_000, "".join(rng.choice("etaoinshr") for _ in range(60_000)), " " * 40_000, "é" * 9_999, "=" * 777]
    assert counted(rules, texts) == library(texts)
    pieces = ["".join(rng.choice("etaoin") for _ in range(n)).encode() for n in (1, 2, 200, 256, 257, 400)]
    one_way, other = token_counts.symbols_left(pieces, rules), []
    for piece in pieces:
        other += token_counts.symbols_left([piece], rules).tolist()
    assert one_way.tolist() == other


def test_pieces_do_not_change_the_count(rules, library, monkeypatch):
    monkeypatch.setattr(token_counts, "STRETCH", 50)
    monkeypatch.setattr(token_counts, "_CACHED", 20)
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab c\n  d'll 12") for _ in range(rng.randrange(900))) for _ in range(60)]
    assert counted(rules, texts) == library(texts)


def test_the_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in token_counts.counts(docs, PATH).collect()}
    rows = docs.select("doc_id", "text").collect()
    for row, n in zip(rows, library([r.text or "" for r in rows])):
        assert (got[row.doc_id].n_tokens, got[row.doc_id].n_bytes) == (n, len((row.text or "").encode()))
        assert got[row.doc_id].over_limit == (n > 512)


def test_edge_cases(spark, library):
    texts = [None, "", "a", "a", "word " * 200_000, "no blanks" * 3_000, " \n"]
    rows = [(i if i != 3 else 2, t) for i, t in enumerate(texts)] + [(None, "null id")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    got = token_counts.counts(docs, PATH).collect()
    want = [(i, len((t or "").encode()), n, n > 512) for (i, t), n in zip(rows, library([t or "" for _, t in rows]))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_counts.counts(docs.limit(0), PATH).collect() == []
    binary = spark.sql("select 1L as doc_id, cast(x'61ff62' as string) as text")
    row = token_counts.counts(binary, PATH).head()
    assert (row.n_bytes, row.n_tokens) == (3, library(["a�b"])[0])


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError):
        token_counts.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    with open(PATH, encoding="utf-8") as file:
        content = json.load(file)
    content["model"]["merges"].reverse()
    (tmp_path / "wrong.json").write_text(json.dumps(content))
    with pytest.raises(ValueError):
        token_counts.Vocabulary(str(tmp_path / "wrong.json"))
