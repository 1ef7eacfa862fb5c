"""Toxicity scores of texts restored from disguise by a noisy channel.

Three models are learned. A character trigram model counts all documents; it restores
disguised words (see ``deobfuscation``). A lexicon of word beginnings of three to eight bytes,
and of whole short words, keeps those that occur in toxic documents significantly more
often; it is learned on one half of a bounded labelled sample. A logistic model over how
many words the lexicon finds is fitted on the other half. All three are of bounded size and
are broadcast; scoring reads every text once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from repostrata.llm.common import keep_rows, sampled, settle
from repostrata.llm.deobfuscation import CLASSES, CharModel, deobfuscate, trigrams
from repostrata.session import pinned

SAMPLE = {0: 6000, 1: 4000}  # labelled documents per class, at most
LEXICON = 20_000  # word beginnings kept, at most: those of greatest weight
THRESHOLD = 0.3
MIN_EVIDENCE, MIN_WEIGHT = 14.0, 2.0
_LETTERS = np.zeros(256, bool)
_LETTERS[97:123] = _LETTERS[128:] = True


def char_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of the trigram model counted over every text of ``docs``.

    Counts are added up within a task and then by trigram, of which there are 2**21 at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    ids = trigrams(text)
                    if len(ids) < 100_000:
                        np.add.at(total, ids, 1)
                    else:
                        total += np.bincount(ids, minlength=len(total))
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    counted = docs.select("text").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = counted.toArrow()
    ids, counts = found.column("id").to_numpy(), found.column("n").to_numpy()
    return CharModel.fit(ids.astype(np.int64), counts)


def labelled_sample(docs: DataFrame, labels: DataFrame, allowed: Column) -> DataFrame:
    """``(text, toxic, half)`` of at most ``SAMPLE`` documents per class, chosen by a hash of the id.

    A document labelled more than once is toxic if any label says so; null labels and ids
    are left out.
    """
    known = labels.where(allowed & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = sampled(known, "toxic", SAMPLE)
    texts = docs.select("doc_id", "text").join(F.broadcast(pinned(chosen)), "doc_id")
    return texts.select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).alias("half"))


def word_keys(text: str) -> tuple[np.ndarray, np.ndarray]:
    """``(keys, word)``: beginnings of each word, and a whole short word with a mark, as numbers."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    letter = _LETTERS[raw]
    edges = np.diff(np.r_[False, letter, False].astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    lengths = ends - starts
    grid = np.r_[raw, np.zeros(8, np.uint8)][starts[:, None] + np.arange(8)]
    grid[np.arange(8) >= lengths[:, None]] = 0
    packed = np.ascontiguousarray(grid).view("<u8").ravel()
    numbers = np.arange(len(starts))
    keys, words = [], []
    for n in range(3, 9):
        long = numbers[lengths >= n]
        keys.append(packed[long] & np.uint64((1 << 8 * n) - 1))
        words.append(long)
    short = numbers[lengths < 8]
    keys.append(packed[short] | (np.uint64(32) << (8 * lengths[short]).astype(np.uint64)))
    words.append(short)
    return np.concatenate(keys), np.concatenate(words)


class Lexicon:
    """Weights by key; a table of 2**16 marks rejects most keys before the search."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], weights[order]
        self.marks = np.zeros(1 << 16, bool)
        self.marks[self._slot(self.keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)

    def features(self, text: str) -> list[float]:
        """Logarithmic count of words found, their greatest and total weight, and their share."""
        keys, words = word_keys(text)
        if not len(keys) or not len(self.keys):
            return [0.0, 0.0, 0.0, 0.0]
        maybe = np.flatnonzero(self.marks[self._slot(keys)])
        at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == keys[maybe]
        words, weights = words[maybe[hit]], self.weights[at[hit]]
        if not len(words):
            return [0.0, 0.0, 0.0, 0.0]
        order = np.lexsort((-weights, words))
        first = np.r_[True, np.diff(words[order]) != 0]
        best = weights[order][first]
        return [float(np.log1p(len(best))), float(best.max()) / 5, float(np.log1p(best.sum())), 10 * len(best) / (words.max() + 10)]


def learn_lexicon(restored: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and weights from ``(text, toxic)`` rows, by the number of documents of each class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.array(batch.column(1).to_pylist(), np.int64)
            keys = [np.unique(word_keys(t or "")[0]) for t in batch.column(0).to_pylist()]
            sides = np.repeat(toxic, [len(k) for k in keys])
            values, inverse = np.unique(np.concatenate([*keys, np.empty(0, np.uint64)]), return_inverse=True)
            counts = [np.bincount(inverse[sides == side], minlength=len(values)) for side in (1, 0)]
            columns = [pa.array(values.view(np.int64)), *(pa.array(c.astype(np.int64)) for c in counts)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "toxic", "other"])

    sizes = {r.toxic: r["count"] for r in restored.groupBy("toxic").count().collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_other:
        return np.empty(0, np.uint64), np.empty(0)
    share = n_toxic / (n_toxic + n_other)
    counted = restored.select("text", "toxic").mapInArrow(count, "key long, toxic long, other long")
    summed = counted.groupBy("key").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"))
    both = F.col("t") + F.col("o")
    weight = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("o") + 0.5) / (n_other + 1))
    # Twice nothing is nothing: a class without documents adds no evidence.
    evidence = F.col("t") * F.log(F.col("t") / (both * share)) + F.when(F.col("o") == 0, 0.0).otherwise(
        F.col("o") * F.log(F.col("o") / (both * (1 - share)))
    )
    kept = summed.where((F.col("t") > 0) & (weight >= MIN_WEIGHT) & (evidence >= MIN_EVIDENCE))
    rows = kept.select("key", weight.alias("w")).orderBy(F.desc("w"), "key").limit(LEXICON).collect()
    return np.array([r.key for r in rows], np.int64).view(np.uint64), np.array([r.w for r in rows], float)


def fit_logistic(rows: np.ndarray, toxic: np.ndarray, totals: dict[int, int]) -> np.ndarray:
    """Weights and bias by Newton steps with a small ridge; classes weighed by their true sizes."""
    x = np.c_[rows, np.ones(len(rows))]
    weight = np.where(toxic == 1, totals[1] / max(1, (toxic == 1).sum()), totals[0] / max(1, (toxic == 0).sum()))
    weight = weight / weight.mean()
    beta = np.zeros(x.shape[1])
    ridge = np.diag([0.01] * rows.shape[1] + [1e-3])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (toxic - p)) - ridge @ beta
        beta = beta + np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, slope)
    return beta


def fit(docs: DataFrame, labels: DataFrame, allowed: Column) -> dict:
    """All models as plain arrays. Without both classes in the sample, every score is the base rate."""
    settle(docs.sparkSession)
    logs = char_model(docs)
    shared = docs.sparkSession.sparkContext.broadcast(logs)

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = CharModel(shared.value), {}
        for batch in batches:
            texts = [deobfuscate(t or "", model, cache) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[1:]], batch.schema.names)

    sample = labelled_sample(docs, labels, allowed)
    restored = pinned(sample.mapInArrow(restore, sample.schema))
    known = labels.where(allowed & F.col("toxic").isNotNull()).groupBy("toxic").count().collect()
    totals = {side: sum(r["count"] for r in known if int(r.toxic == 1) == side) for side in (0, 1)}
    base = totals[1] / max(1, sum(totals.values()))
    keys, weights = learn_lexicon(restored)
    model = {"keys": keys, "weights": weights, "beta": None, "base": base, "logs": logs}
    lexicon = learn_lexicon(restored.where("half = 0"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*lexicon)
        for batch in batches:
            rows = np.array([own.features(t or "") for t in batch.column(0).to_pylist()]).reshape(-1, 4)
            columns = [*(pa.array(rows[:, k]) for k in range(4)), batch.column(1).cast(pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "c", "d", "toxic"])

    schema = "a double, b double, c double, d double, toxic int"
    seen = restored.where("half = 1").select("text", "toxic").mapInArrow(measure, schema).toPandas()
    toxic = (seen["toxic"].to_numpy() == 1).astype(float)
    if 0 < toxic.sum() < len(toxic):
        model["beta"] = fit_logistic(seen[["a", "b", "c", "d"]].to_numpy(), toxic, totals)
    return model


def scorer(docs: DataFrame, model: dict) -> Callable[[list[str | None]], list[float]]:
    """A function for the executors: toxicity between 0 and 1 of each text, whole."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    def score(texts: list[str | None]) -> list[float]:
        own = shared.value
        if own["beta"] is None:
            return [own["base"]] * len(texts)
        if not state:
            state["parts"] = CharModel(own["logs"]), Lexicon(own["keys"], own["weights"]), {}
        chars, lexicon, cache = state["parts"]
        rows = [lexicon.features(deobfuscate(t or "", chars, cache)) for t in texts]
        x = np.c_[np.array(rows).reshape(-1, 4), np.ones(len(texts))] @ own["beta"]
        return (1 / (1 + np.exp(-np.clip(x, -30, 30)))).tolist()

    return score


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """``(doc_id, score, predicted)`` per row; null and empty texts are scored as having no words."""
    score = scorer(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score(batch.column(1).to_pylist())
            verdict = [int(s >= THRESHOLD) for s in found]
            columns = [batch.column(0), pa.array(found, pa.float64()), pa.array(verdict, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted"])

    settle(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def reject(docs: DataFrame, model: dict) -> DataFrame:
    """The rows scored below the threshold, all columns as they were."""
    settle(docs.sparkSession)
    score, place = scorer(docs, model), docs.columns.index("text")
    return keep_rows(docs, lambda batch: [s < THRESHOLD for s in score(batch.column(place).to_pylist())])
