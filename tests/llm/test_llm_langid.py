import numpy as np
import pytest
from pyspark.sql import functions as F

from repostrata.llm import langid
from repostrata.llm.common import in_bucket

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def net(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return langid.fit(docs, ~in_bucket("doc_id", 5, 0), per_lang=200)


def test_held_out_accuracy(spark, net):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held = docs.where(in_bucket("doc_id", 5, 0))
    pred = langid.predict(held, net).join(held.select("doc_id", "lang"), "doc_id")
    right, total = pred.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).head()
    assert total > 100 and right >= 0.97


def test_tables_equal_the_convolution(net):
    rng = np.random.default_rng(1)
    grid = rng.integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    want = []
    for width, kernel, bias in zip(langid.WIDTHS, net.filters, net.biases):
        embedded = net.embedding[grid]
        span = grid.shape[1] - width + 1
        response = sum(embedded[:, j : j + span] @ kernel[j] for j in range(width)) + bias
        want.append(np.maximum(response.max(axis=1), 0))
    assert np.allclose(langid.Tables(net).pooled(grid), np.concatenate(want, axis=1), atol=1e-4)


def test_gradients_by_differences():
    rng = np.random.default_rng(2)
    weights = [rng.normal(0, 0.5, (256, 3))]
    weights += [rng.normal(0, 0.5, (w, 3, 2)) for w in langid.WIDTHS]
    weights += [rng.normal(0, 0.1, 2) for _ in langid.WIDTHS]
    weights += [rng.normal(0, 0.5, (6, 3)), np.zeros(3)]
    grid, labels = rng.integers(97, 103, (4, 12)).astype(np.uint8), np.array([0, 1, 2, 1])

    def loss(ws):
        pooled = []
        for i, width in enumerate(langid.WIDTHS):
            e, span = ws[0][grid], 12 - width + 1
            r = sum(e[:, j : j + span] @ ws[1 + i][j] for j in range(width)) + ws[4 + i]
            pooled.append(np.maximum(r.max(axis=1), 0))
        logits = np.concatenate(pooled, axis=1) @ ws[-2] + ws[-1]
        chance = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
        return -np.log(chance[np.arange(4), labels]).mean() + 0.5e-4 * (ws[-2] ** 2).sum()

    grads = langid._gradients(weights, grid, labels)
    for which, spot in ((0, (98, 1)), (1, (0, 1, 1)), (2, (2, 0, 0)), (3, (3, 2, 1)), (5, (1,)), (7, (2, 2)), (8, (0,))):
        up, down = [w.copy() for w in weights], [w.copy() for w in weights]
        up[which][spot] += 1e-5
        down[which][spot] -= 1e-5
        assert grads[which][spot] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-5)


def test_edge_cases(spark, net):
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 + 34!", "x"), (4, "The and of " * 30_000, "x"), (None, "der die und", "x"), (4, "é", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = langid.predict(docs, net).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert [r.lang_pred for r in got if r.doc_id in (1, 2, 3)] == ["und"] * 3
    assert [r.lang_pred for r in got if r.doc_id == 4][0] == "en"
    assert langid.predict(docs.limit(0), net).collect() == []


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    net = langid.fit(docs, F.lit(True))
    assert langid.predict(docs, net).head().lang_pred == "und"
