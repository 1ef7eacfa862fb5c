"""Language identification by a small byte convolutional network.

Byte embeddings feed filters of widths 2, 3 and 4, whose largest response per window goes
through a softmax layer. The network is trained in numpy on the driver, on a bounded
sample of labelled windows, and applied to every window of every text. For prediction the
filters are folded into tables of responses to byte pairs, so that a filter is one or two
look-ups per byte. The model has a fixed size (about 6 MB), so it is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from repostrata.llm.common import as_bytes, sampled, settle

WINDOW = 256
WIDTHS = (2, 3, 4)
UNKNOWN = "und"


@dataclass
class Network:
    langs: list[str]
    embedding: np.ndarray  # (256, dim)
    filters: list[np.ndarray]  # per width: (width, dim, count)
    biases: list[np.ndarray]
    out: np.ndarray  # (3 * count, langs)
    out_bias: np.ndarray


def sample_windows(docs: DataFrame, allowed: Column, per_lang: int = 1500, window: int = WINDOW) -> list[tuple]:
    """At most ``per_lang`` labelled ``(lang, text piece)`` rows per language.

    Which documents, and where in the text the piece begins, follow from a hash of the id,
    so reruns agree. A piece has at most ``window`` characters, which bounds the sample.
    """
    spread = F.greatest(F.length("text") - window, F.lit(0)) + 1
    start = (F.pmod(F.xxhash64("doc_id", F.lit("start")), spread) + 1).cast("int")
    piece = F.col("text").substr(start, F.lit(window)).alias("piece")
    labelled = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", piece)
    rows = sampled(labelled, "lang", per_lang).where(F.col("piece").rlike(r"\p{L}"))
    return sorted((r.lang, r.doc_id, r.piece) for r in rows.collect())


def _windows(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zero-padded ``(windows, width)`` bytes, the text of each window and its length."""
    counts = [max(1, -(-len(t) // width)) for t in texts]
    grid = np.frombuffer(b"".join(t.ljust(n * width, b"\0") for t, n in zip(texts, counts)), np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    lengths = np.array([len(t) for t in texts])
    order = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return grid.reshape(-1, width), owner, np.clip(lengths[owner] - order * width, 0, width)


def train(sample: list[tuple], dim: int = 8, count: int = 16, steps: int = 700, seed: int = 7) -> Network:
    """Fit the network by Adam on random cuts of the sampled windows."""
    langs = sorted({lang for lang, _, _ in sample})
    rng = np.random.default_rng(seed)
    texts = [piece.encode()[:WINDOW] for _, _, piece in sample]
    labels = np.array([langs.index(lang) for lang, _, _ in sample])
    weights = [rng.normal(0, 0.5, (256, dim))]
    weights += [rng.normal(0, 1 / np.sqrt(w * dim), (w, dim, count)) for w in WIDTHS]
    weights += [np.zeros(count) for _ in WIDTHS]
    weights += [rng.normal(0, 0.3, (len(WIDTHS) * count, len(langs))), np.zeros(len(langs))]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    groups = [np.flatnonzero(labels == k) for k in range(len(langs))]
    batch = 16 * max(4, len(langs))
    for step in range(1, steps + 1):
        picked = np.concatenate([rng.choice(g, batch // len(langs)) for g in groups])
        cuts = [texts[i][: int(rng.integers(12, WINDOW + 1))] if rng.random() < 0.5 else texts[i] for i in picked]
        grid = _windows([c[:WINDOW] for c in cuts], WINDOW)[0]
        grads = _gradients(weights, grid, labels[picked])
        rate = 0.01 * min(1.0, 2 * (1 - step / (steps + 1)))
        for i, grad in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad**2
            unbiased = np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8
            weights[i] -= rate * first[i] / (1 - 0.9**step) / unbiased
    k = len(WIDTHS)
    return Network(langs, weights[0], weights[1 : 1 + k], weights[1 + k : 1 + 2 * k], weights[-2], weights[-1])


def _gradients(weights: list[np.ndarray], grid: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    k, n = len(WIDTHS), len(grid)
    embedding, filters, biases = weights[0], weights[1 : 1 + k], weights[1 + k : 1 + 2 * k]
    out, out_bias = weights[-2], weights[-1]
    embedded, pooled, places = embedding[grid], [], []
    for width, kernel, bias in zip(WIDTHS, filters, biases):
        span = grid.shape[1] - width + 1
        response = sum(embedded[:, j : j + span] @ kernel[j] for j in range(width)) + bias
        places.append(response.argmax(axis=1))
        pooled.append(np.maximum(response.max(axis=1), 0))
    hidden = np.concatenate(pooled, axis=1)
    logits = hidden @ out + out_bias
    chance = np.exp(logits - logits.max(axis=1, keepdims=True))
    chance /= chance.sum(axis=1, keepdims=True)
    chance[np.arange(n), labels] -= 1
    chance /= n
    grads = [np.zeros_like(w) for w in weights]
    grads[-2], grads[-1] = hidden.T @ chance + 1e-4 * out, chance.sum(axis=0)
    back = (chance @ out.T) * (hidden > 0)
    count = filters[0].shape[2]
    for i, (width, kernel) in enumerate(zip(WIDTHS, filters)):
        part = back[:, i * count : (i + 1) * count]
        grads[1 + k + i] = part.sum(axis=0)
        rows = np.arange(n)[:, None]
        for j in range(width):
            seen = embedded[rows, places[i] + j]  # (n, count, dim)
            grads[1 + i][j] = np.einsum("ncd,nc->dc", seen, part)
            np.add.at(grads[0], grid[rows, places[i] + j], part[:, :, None] * kernel[j].T[None])
    return grads


class Tables:
    """The filters as responses to byte pairs, one row of 65,536 numbers per filter."""

    def __init__(self, net: Network):
        self.net = net
        single = [np.einsum("bd,wdc->wcb", net.embedding, f).astype(np.float32) for f in net.filters]
        pair = lambda t, j: (t[j][:, :, None] + t[j + 1][:, None, :]).reshape(len(t[j]), -1)
        two, three, four = single
        self.two = pair(two, 0)
        self.three, self.last = pair(three, 0), three[2]
        self.four, self.rest = pair(four, 0), pair(four, 2)

    def pooled(self, grid: np.ndarray) -> np.ndarray:
        wide = grid.astype(np.int32)
        pairs = (wide[:, :-1] << 8) | wide[:, 1:]
        count = len(self.two)
        out = np.empty((len(grid), 3 * count), np.float32)
        tail, front, back = wide[:, 2:], pairs[:, :-2], pairs[:, 2:]
        for c in range(count):
            out[:, c] = self.two[c][pairs].max(axis=1)
            out[:, count + c] = (self.three[c][pairs[:, :-1]] + self.last[c][tail]).max(axis=1)
            out[:, 2 * count + c] = (self.four[c][front] + self.rest[c][back]).max(axis=1)
        return np.maximum(out + np.concatenate(self.net.biases), 0)

    def chances(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities per text: those of its windows, weighted by their bytes."""
        total = np.zeros((len(texts), len(self.net.langs)))
        grid, owner, sizes = _windows(texts, WINDOW)
        for at in range(0, len(grid), 256):
            logits = self.pooled(grid[at : at + 256]) @ self.net.out + self.net.out_bias
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            np.add.at(total, owner[at : at + 256], chance * np.maximum(sizes[at : at + 256], 1)[:, None])
        return total / total.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """``(doc_id, lang_pred, score)`` per row, in one pass without a shuffle.

    A text that is null or has no letter, or a network without languages, gives ``und``
    and score 0. Whole texts are read; repeated rows get the same result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(**shared.value)
        tables = Tables(net) if net.langs else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            known = [i for i, t in enumerate(texts) if tables and t and any(map(str.isalpha, t))]
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            raw = as_bytes(batch.column(1))
            for at in range(0, len(known), 64):
                some = known[at : at + 64]
                chance = tables.chances([raw[i] for i in some])
                for i, k, p in zip(some, chance.argmax(axis=1), chance.max(axis=1)):
                    langs[i], scores[i] = net.langs[k], min(1.0, float(p))
            columns = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    settle(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def fit(docs: DataFrame, allowed: Column, per_lang: int = 1500) -> Network:
    """Sample labelled windows of the ``allowed`` rows and train; no rows give no languages."""
    sample = sample_windows(docs, allowed, per_lang)
    if not sample:
        return Network([], np.empty((256, 0)), [], [], np.empty((0, 0)), np.empty(0))
    return train(sample)
