"""Mix sources to target weights in fixed-length blocks of words.

The words of each source, document after document in a pseudorandom order, are cut into
blocks of ``BLOCK`` words. Every output shard draws how many of its slots each source fills,
multinomially over what the sources still owe, so that the totals meet the targets. The
slots of a source are numbered over all shards and mapped to blocks through a pseudorandom
permutation per source and epoch: a block is used once before any is used twice, and never
more often than ``MAX_REPEAT`` times. Blocks and documents are then joined by block index.

Nothing depends on where rows lie, so reruns agree. The driver sees one number per source
and per (shard, source); a source is a named part of a corpus, so these are few.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from repostrata.llm.common import WORD, as_bytes, settle
from repostrata.session import pinned

BLOCK = 64
SHARDS = 64  # at least
SHARD_SLOTS = 1 << 18
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = 20240229
_GROUP = 5000  # documents per window of the running word counts, on average


def targets(sizes: list[int], weights: list[float], total: float, limit: float = MAX_REPEAT) -> list[float]:
    """Words to take from each source: shares by weight, none above ``limit`` times its size.

    The excess of capped sources goes to the others by weight until none is above.
    """
    wanted, open_ = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s > 0 and weights[i] > 0}
    left = float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        above = {i for i in open_ if weights[i] * unit > limit * sizes[i]}
        for i in above or open_:
            wanted[i] = float(limit * sizes[i]) if above else weights[i] * unit
        left -= sum(wanted[i] for i in above)
        open_ = open_ - above if above else set()
    return wanted


def shard_draws(slots: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """``(shards, sources)`` slot counts, each row one multinomial draw over what is left.

    Rows have equal sums up to one, columns sum to ``slots``. What a draw would take beyond
    a source's rest is drawn again among the others.
    """
    rng, rest = np.random.default_rng(seed), np.array(slots, np.int64)
    out = np.zeros((shards, len(slots)), np.int64)
    for shard in range(shards):
        need = -(-int(rest.sum()) // (shards - shard))
        while need:
            draw = np.minimum(rng.multinomial(need, rest / rest.sum()), rest)
            out[shard] += draw
            rest -= draw
            need -= int(draw.sum())
    return out


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Images of ``index`` under a keyed permutation of ``range(size)``.

    A four-round Feistel network over the next even power of two, walked until the value
    falls into the range.
    """
    half = max(1, math.ceil(max(1, (size - 1).bit_length()) / 2))
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(1, 1 << 63, 4, dtype=np.uint64) | np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * k
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, digest)``; the size is the number of words, 0 for null."""
    count = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", count.alias("size"), F.xxhash64("text").alias("digest"))


def plan(sizes: DataFrame, block: int, weights: tuple, limit: int) -> DataFrame:
    """``(source, source_size, target, n_blocks, n_slots, number)``: one row per source.

    Sources are in order of code points with null last; weights repeat along that order.
    """
    spark = sizes.sparkSession
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    lengths = [r["size"] for r in rows]
    wanted = targets(lengths, [weights[i % len(weights)] for i in range(len(rows))], sum(lengths), limit)
    made = []
    for i, (row, length, target) in enumerate(zip(rows, lengths, wanted)):
        blocks = -(-length // block)
        slots = min(limit * blocks, round(target * blocks / length)) if length else 0
        made.append((row.source, length, target, blocks, slots, i))
    schema = "source string, source_size long, target double, n_blocks long, n_slots long, number int"
    return spark.createDataFrame(made, schema)


def placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """``sized`` rows with the columns of their source and ``first``, the place of their first word.

    Documents are ordered by a hash of the id. Equal rows are counted before the shuffle
    (``n``) and laid side by side afterwards, so repeated ids do not gather in a task.
    """
    keys = ["source", "doc_id", "size", "digest"]
    same = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    same = pinned(same.withColumn("h", F.xxhash64("doc_id", "digest", F.lit(SEED))))
    groups = max(1, math.ceil(same.count() / _GROUP))
    same = same.withColumn("part", F.pmod("h", F.lit(groups)))
    words = F.col("size") * F.col("n")
    parts = same.groupBy("source", "part").agg(F.sum(words).alias("words"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("source", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "part").orderBy("h", "doc_id", "size", "digest")
    gone = F.coalesce(F.sum(words).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.withColumnsRenamed({"source": "source_", "part": "part_"})
    local = same.withColumn("gone", gone)
    at = local.join(starts, local.source.eqNullSafe(starts.source_) & (local.part == starts.part_))
    copies = at.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    first = F.col("base") + F.col("gone") + F.col("copy") * F.col("size")
    copies = copies.select(*keys, "n", first.alias("first"))
    named = sources.withColumnRenamed("source", "source_")
    return copies.join(named, copies.source.eqNullSafe(named.source_)).drop("source_")


def slots(sources: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """``(shard, slot, number, block)``: which block of which source fills each output slot.

    There are ``shards`` output shards, or as many as keep each within ``SHARD_SLOTS``.
    """
    known = sorted(sources.select("number", "n_slots", "n_blocks").collect())
    wanted = [r.n_slots for r in known]
    shards = max(1, min(max(shards, -(-sum(wanted) // SHARD_SLOTS)), sum(wanted)))
    draws = shard_draws(wanted, shards, seed)
    starts = np.cumsum(draws, axis=0) - draws
    places = np.cumsum(draws, axis=1) - draws
    rows = [
        (s, r.number, r.n_blocks, int(starts[s, i]), int(places[s, i]), int(draws[s, i]))
        for s in range(shards)
        for i, r in enumerate(known)
        if draws[s, i]
    ]
    schema = "shard int, number int, n_blocks long, start long, place long, n long"
    drawn = sources.sparkSession.createDataFrame(rows, schema).repartition("shard", "number")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                for at in range(0, r.n, 1 << 20):
                    along = np.arange(at, min(r.n, at + (1 << 20)))
                    index, block = r.start + along, np.empty(len(along), np.int64)
                    for epoch in np.unique(index // r.n_blocks):
                        here = index // r.n_blocks == epoch
                        key = (seed * 1_000_003 + r.number) * 1_009 + int(epoch)
                        block[here] = permuted(index[here] % r.n_blocks, r.n_blocks, key)
                    yield pd.DataFrame({"shard": r.shard, "slot": r.place + along, "number": r.number, "block": block})

    # Written, so that the planner knows how many rows grew out of the few drawn ones.
    return pinned(drawn.mapInPandas(fill, "shard int, slot long, number int, block long"))


def pieces(at: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document and block it reaches: ``(…, block, skip, words)``.

    ``skip`` is the number of the document's words before the piece.
    """
    end = F.col("first") + F.col("size")
    numbers = F.sequence(F.expr(f"first div {block}"), F.expr(f"(first + size - 1) div {block}"))
    cut = at.where("size > 0").withColumn("block", F.explode(numbers))
    start = F.greatest("first", F.col("block") * block)
    return cut.withColumns({"skip": start - F.col("first"), "words": F.least(end, (F.col("block") + 1) * block) - start})


def report(
    docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, weights: tuple = WEIGHTS, limit: int = MAX_REPEAT
) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``: one row per row of ``docs``.

    Null and empty texts have size 0 and give nothing; a null source is the last source. An
    empty table gives no rows. Repeated rows are separate documents. Extra columns are not
    read.
    """
    sizes = pinned(sized(docs))
    sources = plan(sizes, block, weights, limit)
    at = pinned(placed(sizes, sources))
    times = slots(sources, shards).groupBy("number", "block").agg(F.count(F.lit(1)).alias("times"))
    used = pieces(at, block).join(times, ["number", "block"])
    taken = used.groupBy("number", "first").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    columns = ["doc_id", "size", "source_size", "target"]
    filled = at.where("size > 0").join(taken, ["number", "first"], "left")
    empty = at.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"))
    return filled.select(*columns, F.coalesce("taken", F.lit(0)).alias("taken")).unionByName(empty)


def mixed(
    docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, weights: tuple = WEIGHTS, limit: int = MAX_REPEAT
) -> DataFrame:
    """The mix itself: ``(shard, slot, source, block, doc_ids, n_words, text)``, one row per slot.

    ``text`` is the words of the block joined by spaces, ``doc_ids`` the documents they come
    from, in order. Documents without words are in no block. Nulls, repeated rows and extra
    columns are handled as in ``report``; null ids are left out of ``doc_ids``.
    """
    sizes = pinned(sized(docs))
    sources = plan(sizes, block, weights, limit)
    at = pinned(placed(sizes, sources).where("size > 0"))
    keys = ["doc_id", "source", "digest"]
    texts = docs.select("doc_id", "source", F.xxhash64("text").alias("digest"), "text")
    both = at.select(*[F.col(k).alias(f"{k}_") for k in keys], "size", "n", "first", "number")

    def same(frame: DataFrame, other: DataFrame):
        return [frame[k].eqNullSafe(other[f"{k}_"]) for k in keys]

    # Places of equal rows share one copy of their text.
    once, several = both.where("n = 1"), both.where("n > 1")
    held = texts.join(several, same(texts, several), "left_semi").dropDuplicates(keys)
    columns = ["doc_id", "number", "first", "size", "text"]
    ready = texts.join(once, same(texts, once)).select(*columns)
    ready = ready.unionByName(held.join(several, same(held, several)).select(*columns))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            number, first = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, raw in enumerate(as_bytes(batch.column(4))):
                words, at = raw.split(), 0
                while at < len(words):
                    stop = min(len(words), ((first[i] + at) // block + 1) * block - first[i])
                    piece = b" ".join(words[at:stop]).decode("utf-8", "replace")
                    values = (i, number[i], (first[i] + at) // block, first[i] + at, piece)
                    for column, value in zip(rows, values):
                        column.append(value)
                    at = stop
            ids = batch.column(0).take(pa.array(rows[0], pa.int64()))
            rest = [pa.array(r, k) for r, k in zip(rows[1:], (pa.int32(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([ids, *rest], ["doc_id", "number", "block", "at", "piece"])

    settle(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    cuts = ready.mapInArrow(cut, f"doc_id {kind}, number int, block long, at long, piece string")
    blocks = cuts.groupBy("number", "block").agg(F.array_sort(F.collect_list(F.struct("at", "doc_id", "piece"))).alias("p"))
    text = F.array_join(F.col("p.piece"), " ")
    whole = blocks.select(
        "number",
        "block",
        F.array_distinct(F.filter("p.doc_id", lambda d: d.isNotNull())).alias("doc_ids"),
        text.alias("text"),
    )
    named = sources.select("number", "source")
    filled = slots(sources, shards).join(whole, ["number", "block"]).join(named, "number")
    size = F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words")
    return filled.select("shard", "slot", "source", "block", "doc_ids", size, "text")
