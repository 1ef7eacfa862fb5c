"""Repeated passages: stretches of sentences hashed over all documents, of which the earliest stays.

A text is cut into units at line and sentence ends; where none comes for ``CUT`` words, after
a word chosen by its own hash, so equal text is cut alike. Each unit starts a passage: it and
the units after it until there are ``MIN_WORDS`` words. Passages are normalised (lower case,
white space made single) and hashed to 128 bits, and the digests are grouped globally. The
occurrence with the smallest (id, text digest, unit) stays; the units of all others are removed.
A shorter repeat, such as a stock sentence, says little by itself and is left alone.
What is kept carries its offsets into the original text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from repostrata.llm.common import bit_filter, filter_words, in_filter, settle
from repostrata.session import pinned

MIN_WORDS = 30
CUT, CHANCE, LONGEST = 24, 8, 96
_KEYS = ["doc_id", "digest"]
# Signs that end a sentence, with quotes and brackets that close after them.
_END = re.compile(r"""[.!?…。！？]["'”’)\]]*(?=\s|$)|\n""")
_WORD = re.compile(r"\S+")


def units(text: str) -> list[tuple[int, list[str]]]:
    """``(start, words)`` of each unit; it ends where the next one starts, and has a word at least.

    The first starts at 0, and white space belongs to the unit before it.
    """
    out: list[tuple[int, list[str]]] = []
    ends = [m.end() for m in _END.finditer(text)]
    at = 0
    for end in [*ends, len(text)]:
        words = text[at:end].lower().split()
        if len(words) > CUT:
            out += _cut(text, at, end)
        elif words:
            out.append((at, words))
        elif out or at == end:
            at = end
            continue
        else:
            continue  # leading white space goes to the first unit
        at = end
    if out:
        out[0] = (0, out[0][1])
    return out


def _cut(text: str, start: int, end: int) -> Iterator[tuple[int, list[str]]]:
    held: list[str] = []
    for match in _WORD.finditer(text, start, end):
        if not held:
            first = start
        held.append(match[0].lower())
        cut = len(held) >= CUT and zlib.crc32(held[-1].encode("utf-8", "replace")) % CHANCE == 0
        if cut or len(held) >= LONGEST:
            yield first, held
            start, held = match.end(), []
    if held:
        yield first, held


def passages(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """``(first unit, unit after the last, 16-byte digest)`` of every passage."""
    own = units(text)
    texts = [" ".join(words) for _, words in own]
    sizes = [len(words) for _, words in own]
    end = total = 0
    for first in range(len(own)):
        while end < len(own) and total < min_words:
            total += sizes[end]
            end += 1
        if total < min_words:
            return
        joined = " ".join(texts[first:end])
        yield first, end, hashlib.blake2b(joined.encode("utf-8", "replace"), digest_size=16).digest()
        total -= sizes[first]


def without(text: str, gone: set[int]) -> tuple[str, list[tuple[int, int]], int]:
    """Text without the numbered units, the spans of the original that stay, and characters removed."""
    if not gone:
        return text, [(0, len(text))] if text else [], 0
    starts = [start for start, _ in units(text)]
    spans: list[tuple[int, int]] = []
    for number, (start, end) in enumerate(zip(starts, [*starts[1:], len(text)])):
        if number in gone:
            continue
        if spans and spans[-1][1] == start:
            spans[-1] = (spans[-1][0], end)
        else:
            spans.append((start, end))
    kept = "".join(text[a:b] for a, b in spans)
    return kept, spans, len(text) - len(kept)


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left.doc_id.eqNullSafe(right.doc_id) & (left.digest == right.digest)


def _flagged(rows: DataFrame, hashes: DataFrame, column: Column) -> DataFrame:
    """``rows`` with ``near``: whether a filter of ``hashes(h)`` may hold the hash in ``column``.

    The filter takes eight bits a hash, 8 MB at most; beyond that it lets more through, and the
    joins behind it decide as before.
    """
    bits = bit_filter(hashes, "h", filter_words(hashes.count()))
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def near(h: pd.Series) -> pd.Series:
        return pd.Series(in_filter(shared.value, h.to_numpy()))

    return rows.withColumn("near", near(column))


def repeats(keyed: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, digest, ranges)``: ranges of units to remove, per text that has any.

    ``keyed`` has ``doc_id``, ``digest`` of the text, and ``text``. Half of each digest is counted
    first; what stands there once goes no further, and only the rest is grouped and ranked.
    """

    def list_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            firsts: list[int] = []
            ends: list[int] = []
            hashes: list[bytes] = []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for first, end, digest in passages(text or "", min_words):
                    rows.append(i)
                    firsts.append(first)
                    ends.append(end)
                    hashes.append(digest)
            halves = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            own = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:2]]
            columns = [*own, pa.array(firsts, pa.int32()), pa.array(ends, pa.int32()), *(pa.array(np.ascontiguousarray(h)) for h in halves.T)]
            yield pa.RecordBatch.from_arrays(columns, [*_KEYS, "first", "end", "high", "low"])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, digest long, first int, end int, high long, low long"
    found = pinned(keyed.select(*_KEYS, "text").mapInArrow(list_passages, schema))
    several = pinned(found.groupBy(F.col("high").alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    near = _flagged(found, several, F.col("high")).where("near").drop("near")
    near = pinned(near.join(several.withColumnRenamed("h", "high"), "high", "left_semi"))
    rank = F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", "digest", "first")
    groups = near.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("earliest"))
    later = near.join(groups.where("n > 1"), ["high", "low"]).where(rank != F.col("earliest"))
    return later.groupBy(*_KEYS).agg(F.collect_set(F.struct("first", "end")).alias("ranges"))


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, text, n_removed, chars_removed, spans)``: one row per row of ``docs``.

    ``spans`` are the ``[start, end)`` character ranges of the original that ``text`` consists
    of; ``n_removed`` counts units. A null text stays null with nothing removed; null ids rank
    last. Of rows with equal id and text, one counts as the first and the others lose every
    unit that is part of a passage. Extra columns are not read. Texts from which nothing is
    removed are not shuffled, but for those that a filter can't tell.
    """
    settle(docs.sparkSession)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    gone = pinned(repeats(keyed, min_words))
    copies = pinned(keyed.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    own = F.xxhash64(*_KEYS)
    touched = gone.select(own.alias("h")).unionByName(copies.select(own.alias("h")))
    flagged = _flagged(keyed, touched, own)
    plain = flagged.where(~F.col("near")).select("doc_id", "text", F.lit(1).cast("long").alias("copies"))
    held = flagged.where("near").drop("near")
    single = held.join(copies, _same(held, copies), "left_anti").withColumn("copies", F.lit(1).cast("long"))
    if not copies.isEmpty():
        several = held.join(copies, _same(held, copies), "left_semi").dropDuplicates(_KEYS)
        single = single.unionByName(several.join(copies, _same(several, copies)).select(several["*"], "copies"))
    joined = single.join(gone, _same(single, gone), "left").select(single["doc_id"], "text", "copies", "ranges")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            texts, counts, ranges = (batch.column(k).to_pylist() for k in (1, 2, 3))
            for i, text in enumerate(texts):
                for copy in range(counts[i]):
                    if copy:
                        drop = {n for first, end, _ in passages(text or "", min_words) for n in range(first, end)}
                    else:
                        drop = {n for r in ranges[i] or () for n in range(r["first"], r["end"])}
                    new, spans, chars = without(text, drop) if text is not None else (None, [], 0)
                    values = (i, new, len(drop), chars, [{"start": a, "end": b} for a, b in spans])
                    for column, value in zip(out, values):
                        column.append(value)
            ids = batch.column(0).take(pa.array(out[0], pa.int64()))
            kinds = (pa.string(), pa.int64(), pa.int64(), span)
            columns = [pa.array(c, k) for c, k in zip(out[1:], kinds)]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "text", "n_removed", "chars_removed", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text string, n_removed long, chars_removed long, spans array<struct<start:long,end:long>>"
    whole = F.when(F.length("text") > 0, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end"))))
    zero = F.lit(0).cast("long")
    empty = F.array().cast("array<struct<start:long,end:long>>")
    unchanged = plain.select("doc_id", "text", zero.alias("n_removed"), zero.alias("chars_removed"), F.coalesce(whole, empty).alias("spans"))
    return unchanged.unionByName(joined.mapInArrow(rebuild, schema))
