"""Ranked lexical search: accumulator-limited term-at-a-time over pieces of the collection.

Documents are read once. What is written of each is its length and the terms that the queries
may hold, told by a filter of fixed size; collection counts and weights come from that. A
second pass takes the documents piece by piece. In a piece each query goes through its terms
from the rarest to the commonest and adds their contributions to accumulators, one per
document met. Contributions are never negative, so the ``k``-th best partial score is a bound
for the ``k``-th best score: once all remaining terms together cannot reach it, no further
accumulator is opened, and the survivors alone are updated, by look-ups in the remaining lists.
Ties reach the bound and stay, so the result is exact. What each piece finds is ranked globally.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from repostrata.llm.common import as_bytes, settle
from repostrata.session import pinned

BEST = 10
PART = 200_000  # terms of the queries that are searched at a time; more take further passes
PIECE = 2_000_000  # postings that are held at a time
_FILTER_WORDS = 1 << 16  # 64-bit words of the filter
_MEMO = 300_000
# Digits, ASCII letters in lower case and all bytes beyond ASCII; the rest separates.
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms(text: bytes) -> list[bytes]:
    """Terms of UTF-8 text in order."""
    return text.translate(_PLAIN).split()


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item, term)``, each once; rows with one id are one query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms(t))) for t in as_bytes(batch.column(1))]
            at = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
            flat = pa.array([t for f in found for t in f], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), flat], ["item", "term"])

    kind = items.schema[id_col].dataType.simpleString()
    return items.select(id_col, text_col).mapInArrow(run, f"item {kind}, term binary").distinct()


def _filter(asked: DataFrame) -> np.ndarray:
    """A set of hashes of the terms, 512 KB whatever their number; it may hold others as well."""
    bits = _FILTER_WORDS * 64
    slot = F.pmod(F.xxhash64("term"), F.lit(bits))
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(term), {bits}) % 64 as int))")
    words = np.zeros(_FILTER_WORDS, np.int64)
    for row in asked.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).collect():
        words[row.word] = row.bits
    return words


def _profiles(docs: DataFrame, wanted: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, n, terms, tfs)`` of every row: all its terms counted, those that may be asked listed."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, memo, digest = shared.value, {}, xxhash.xxh64_intdigest

        def asked(term: bytes) -> bool:
            hit = memo.get(term)
            if hit is None:
                slot = digest(term, 42) & (_FILTER_WORDS * 64 - 1)
                hit = bool(int(words[slot >> 6]) >> (slot & 63) & 1)
                if len(memo) > _MEMO:
                    memo.clear()
                memo[term] = hit
            return hit

        for batch in batches:
            sizes, lists, counts = [], [], []
            for text in as_bytes(batch.column(1)):
                every = terms(text)
                own = {t: c for t, c in Counter(every).items() if asked(t)}
                sizes.append(len(every))
                lists.append(list(own))
                counts.append(list(own.values()))
            columns = [pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n", "terms", "tfs"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n long, terms array<binary>, tfs array<long>")


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def damping(n: int, documents: int, length: int) -> int:
    """``m`` of a document with ``n`` terms, in a collection of so many documents and terms."""
    return 10 + (90 * n * documents) // max(length, 1)


class Postings:
    """Lists of one piece: for each term the documents in ascending order and their impacts."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int):
        order = np.argsort(term, kind="stable")
        self.doc, self.impact = doc[order], impact[order]
        self.ends = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.peak = np.zeros(n_terms, np.int64)
        used = np.flatnonzero(np.diff(self.ends))
        if len(used):
            self.peak[used] = np.maximum.reduceat(self.impact, self.ends[used])
        self.n_docs = n_docs


def search(lists: Postings, query: np.ndarray, weights: np.ndarray, best: int, reached: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents of a piece that may be among the ``best``, their scores, and opened lists.

    ``query`` has term numbers from the rarest on; scores below ``reached`` do not count.
    """
    bounds = weights * lists.peak[query]
    left = np.r_[np.cumsum(bounds[::-1])[::-1], 0]
    scores = np.zeros(lists.n_docs, np.int64)
    opened, highest = 0, 0
    for term, w in zip(query.tolist(), weights.tolist()):
        if left[opened] < reached:
            break
        here = slice(lists.ends[term], lists.ends[term + 1])
        docs = lists.doc[here]
        scores[docs] += w * lists.impact[here]
        opened += 1
        if len(docs):
            highest = max(highest, int(scores[docs].max()))
        if left[opened] < highest:
            seen = scores[scores > 0]
            if len(seen) >= best:
                reached = max(reached, int(np.partition(seen, len(seen) - best)[len(seen) - best]))
    alive = np.flatnonzero(scores)
    for i in range(opened, len(query)):
        alive = alive[scores[alive] + left[i] >= reached]
        here = slice(lists.ends[query[i]], lists.ends[query[i] + 1])
        docs = lists.doc[here]
        if not len(alive) or not len(docs):
            continue
        at = np.minimum(np.searchsorted(docs, alive), len(docs) - 1)
        met = docs[at] == alive
        scores[alive[met]] += weights[i] * lists.impact[here][at[met]]
        if len(alive) > best:
            own = scores[alive]
            reached = max(reached, int(np.partition(own, len(own) - best)[len(own) - best]))
    alive = alive[scores[alive] >= reached]
    return alive, scores[alive], opened


def _first(docs: np.ndarray, scores: np.ndarray, place: np.ndarray, best: int) -> np.ndarray:
    """Positions of the ``best`` by score and then by place of the id."""
    return np.lexsort((place[docs], -scores))[:best]


def _searched(profiles: DataFrame, part: pa.Table, documents: int, length: int, best: int, schema: str) -> DataFrame:
    """``(item, doc_id, score)``: what each piece finds for the queries of ``part(item, term, df)``."""
    items = pc.unique(part.column("item").combine_chunks())
    owner = pc.index_in(part.column("item").combine_chunks(), value_set=items).to_numpy(zero_copy_only=False)
    vocabulary: dict[bytes, int] = {}
    number = np.array([vocabulary.setdefault(t, len(vocabulary)) for t in part.column("term").to_pylist()], np.int64)
    dfs = part.column("df").to_numpy()
    known = {df: weight(documents, df) for df in set(dfs.tolist())}
    weights = np.array([known[df] for df in dfs.tolist()], np.int64)
    order = np.lexsort((number, dfs, owner))
    cuts = np.flatnonzero(np.diff(owner[order])) + 1
    queries = [(int(owner[q[0]]), number[q], weights[q]) for q in np.split(order, cuts)]
    shared = profiles.sparkSession.sparkContext.broadcast((items, vocabulary, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, vocabulary, queries = shared.value
        reached = [1] * len(queries)

        def give(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids, lists = rows.column("doc_id").combine_chunks(), rows.column("terms").combine_chunks()
            term = np.array([vocabulary.get(t, -1) for t in lists.flatten().to_pylist()], np.int64)
            doc = np.repeat(np.arange(len(ids)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            tf = rows.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            m = np.array([damping(n, documents, length) for n in rows.column("n").to_pylist()], np.int64)
            asked = term >= 0
            term, doc, tf = term[asked], doc[asked], tf[asked]
            lists = Postings(term, doc, 1_000_000_000 * tf // (1000 * tf + 8 * m[doc]), len(vocabulary), len(ids))
            place = np.empty(len(ids), np.int64)
            place[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
            out: list[list[np.ndarray]] = [[], [], []]
            for i, (item, query, weights) in enumerate(queries):
                docs, scores, _ = search(lists, query, weights, best, reached[i])
                chosen = _first(docs, scores, place, best)
                if len(chosen) == best:
                    reached[i] = max(reached[i], int(scores[chosen[-1]]))
                for column, values in zip(out, (np.full(len(chosen), item), docs[chosen], scores[chosen])):
                    column.append(values)
            item, doc, score = (pa.array(np.concatenate(c), pa.int64()) for c in out)
            return pa.RecordBatch.from_arrays([items.take(item), ids.take(doc), score], ["item", "doc_id", "score"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column(2).flatten())
            if size >= PIECE:
                yield give(held)
                held, size = [], 0
        if held:
            yield give(held)

    return profiles.mapInArrow(run, schema)


def rank(
    docs: DataFrame, items: DataFrame, best: int = BEST, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", part: int = PART,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``best`` documents of each query with a score above 0.

    Equal scores rank by ascending id, null ids last. Null and empty texts have no terms and
    are not counted as documents; repeated rows are documents of their own. Queries without a
    term that occurs have no rows; those with one id, or all with a null id, are one query. Empty
    tables give no rows. Other columns are not read. The queries are broadcast in parts of
    about ``part`` terms, one pass over the listed terms each.
    """
    spark = settle(docs.sparkSession)
    asked = pinned(query_terms(items, item_col, item_text))
    profiles = pinned(_profiles(docs, _filter(asked), id_col, text_col))
    total = profiles.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length")).head()
    found = profiles.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = pinned(asked.join(found, "term").select("item", "term", "df"))
    parts = max(1, -(-weighted.count() // part))
    number = F.pmod(F.xxhash64("item"), F.lit(parts))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((asked, "item"), (profiles, "doc_id"))]
    schema = f"item {kinds[0]}, doc_id {kinds[1]}, score long"
    hits = spark.createDataFrame([], schema)
    for p in range(parts):
        own = weighted.where(number == p).toArrow()
        if own.num_rows:
            hits = hits.unionByName(_searched(profiles, own, total.documents, total.length, best, schema))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select(F.col("item").alias("item_id"), "rank", "doc_id", "score")
