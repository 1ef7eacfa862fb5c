"""Near duplicates by 64-bit SimHash fingerprints and deletion-variant signatures.

Fingerprints that differ in at most two bits agree in one 32-bit half up to one bit. Each
distinct fingerprint is listed under its halves with one bit wildcarded, 64 keys in all;
equal keys meet in a sorted partition and their fingerprints are compared there. A key
with more than ``CROWD`` fingerprints is cut again: its other half is indexed the same
way in 16-bit, then in 8-bit pieces, after which at most 1,024 different fingerprints can
share a key. So no list of pairs grows with the square of a group, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from repostrata.llm import near_copies
from repostrata.llm.common import as_bytes, fresh, settle
from repostrata.llm.components import components
from repostrata.session import pinned

CROWD = 256
_KEYED = "key long, sub long, a long"
_FOUND = "key long, sub long, a long, b long"


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of the shingles of ``width`` words of UTF-8 text, as an unsigned number.

    ASCII letters count as lower case, shingles as often as they occur; fewer words than a
    shingle has form one, and a text without words has fingerprint 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    counts = np.zeros(64, np.int64)
    total = len(words) - width + 1
    for at in range(0, total, 1 << 16):
        stop = min(total, at + (1 << 16))
        spans = zip(starts[at:stop].tolist(), ends[at + width - 1 : stop + width - 1].tolist())
        hashes = np.array([digest(joined[s:e], 42) for s, e in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << bit for bit in np.flatnonzero(2 * counts > total).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, width) for t in as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    settle(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, fp long")


def _wildcards(df: DataFrame, value: str, width: int) -> DataFrame:
    """Both ``width``-bit halves of ``value`` with each bit wildcarded: ``__v``."""
    half = f"shiftrightunsigned({value}, if(p < {width}, 0, {width})) & {2**width - 1}L"
    masked = f"({half}) & ~shiftleft(1L, p % {width})"
    rows = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(2 * width - 1))).alias("p"))
    return rows.withColumn("__v", F.expr(f"shiftleft(cast(p as bigint), {width}) | ({masked})"))


def _other(key: str, width: int, value: str) -> str:
    """The half of ``value`` that ``key`` did not index."""
    first = f"shiftrightunsigned({key}, {width}) < {width}"
    return f"shiftrightunsigned({value}, if({first}, {width}, 0)) & {2**width - 1}L"


def _canonical(x: np.ndarray, width: int) -> np.ndarray:
    """The one wildcard position at which a pair with differing bits ``x`` is reported."""
    mask = np.uint64(2**width - 1)
    low, high = x & mask, (x >> np.uint64(width)) & mask
    at = lambda v: np.where(v > 0, np.bitwise_count(v - (v > 0).astype(np.uint64)), 0)
    return np.where(np.bitwise_count(low) <= 1, at(low), width + at(high)).astype(np.int64)


def _reported(x: np.ndarray, key: np.ndarray, sub: np.ndarray, level: int) -> np.ndarray:
    place = _canonical(x, 32)
    good = (np.bitwise_count(x) <= 2) & (place == key >> 32)
    if level >= 2:
        x = np.where(place < 32, x >> np.uint64(32), x & np.uint64(2**32 - 1))
        upper = sub if level == 2 else sub >> 12
        place = _canonical(x, 16)
        good &= place == upper >> 16
    if level == 3:
        x = np.where(place < 16, x >> np.uint64(16), x & np.uint64(2**16 - 1))
        good &= _canonical(x, 8) == (sub & 4095) >> 8
    return good


def _matches(level: int, crowd: int | None):
    """Compare the fingerprints of each key; rows arrive sorted by key, sub and fingerprint.

    Reports links as ``(null, null, a, b)`` and the rows of crowded keys as
    ``(key, sub, a, null)``. At most ``crowd`` rows of a key and one batch are held.
    """

    def table(key, sub, a, b):
        return pa.RecordBatch.from_arrays([key, sub, a, b], ["key", "sub", "a", "b"])

    def links(key, sub, fp):
        bits, ends = fp.view(np.uint64), []
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])])
        sizes = np.diff(np.r_[starts, len(key)])
        group = np.repeat(np.arange(len(starts)), sizes)
        here = np.flatnonzero(np.repeat(sizes > 1, sizes))
        step = 1
        while len(here):
            here = here[here + step < len(key)]
            here = here[group[here] == group[np.minimum(here + step, len(key) - 1)]]
            x = bits[here] ^ bits[here + step]
            good = here[_reported(x, key[here], sub[here], level) & (x > 0)]
            ends.append((fp[good], fp[good + step]))
            step += 1
        a, b = (np.concatenate([e[i] for e in ends] or [np.empty(0, np.int64)]) for i in (0, 1))
        nulls = pa.nulls(len(a), pa.int64())
        return table(nulls, nulls, pa.array(a), pa.array(b))

    def crowded(key, sub, fp):
        return table(pa.array(key), pa.array(sub), pa.array(fp), pa.nulls(len(fp), pa.int64()))

    def settled(key, sub, fp):
        """Results for whole keys, crowded ones left for the next level."""
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])])
        sizes = np.diff(np.r_[starts, len(key)])
        many = np.repeat(sizes > crowd, sizes) if crowd else np.zeros(len(key), bool)
        if many.any():
            yield crowded(key[many], sub[many], fp[many])
        if not many.all():
            yield links(key[~many], sub[~many], fp[~many])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot = [np.empty(0, np.int64)] * 3, None
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            key, sub, fp = (np.concatenate(pair) for pair in zip(held, new))
            if hot:
                rest = np.flatnonzero((key != hot[0]) | (sub != hot[1]))
                cut = rest[0] if len(rest) else len(key)
                if cut:
                    yield crowded(key[:cut], sub[:cut], fp[:cut])
                key, sub, fp = key[cut:], sub[cut:], fp[cut:]
            if not len(key):
                held = [key, sub, fp]
                continue
            hot = None
            before = np.flatnonzero((key != key[-1]) | (sub != sub[-1]))
            cut = before[-1] + 1 if len(before) else 0
            if cut:
                yield from settled(key[:cut], sub[:cut], fp[:cut])
            held = [key[cut:], sub[cut:], fp[cut:]]
            if crowd and len(held[0]) > crowd:
                yield crowded(*held)
                hot, held = (key[-1], sub[-1]), [np.empty(0, np.int64)] * 3
        if len(held[0]):
            yield from settled(*held)

    return run


def near_links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``(a, b)`` for each pair of different fingerprints within two bits.

    ``prints`` has one row per distinct fingerprint in its column ``fp``.
    """
    keyed = _wildcards(prints.select("fp"), "fp", 32).selectExpr("__v as key", "0L as sub", "fp as a")
    found = []
    for level in (1, 2, 3):
        met = keyed.repartition("key", "sub").sortWithinPartitions("key", "sub", "a")
        out = pinned(met.mapInArrow(_matches(level, crowd if level < 3 else None), _FOUND))
        found.append(out.where("key is null").select("a", "b"))
        rows = out.where("key is not null").select("key", "sub", "a")
        if level == 3 or rows.isEmpty():
            break
        if level == 1:
            rows = rows.withColumn("__o", F.expr(_other("key", 32, "a")))
            keyed = _wildcards(rows, "__o", 16).selectExpr("key", "__v as sub", "a")
        else:
            rows = rows.withColumn("__o", F.expr(_other("key", 32, "a")))
            rows = rows.withColumn("__o", F.expr(_other("sub", 16, "__o")))
            keyed = _wildcards(rows, "__o", 8).selectExpr("key", "shiftleft(sub, 12) | __v as sub", "a")
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)``: one row per row of ``docs``.

    ``component_id`` is the smallest id among the documents reachable over fingerprints at
    most two bits apart, itself included. Null texts and texts without words share
    fingerprint 0. Null ids are passed through and never chosen: a group of null ids only
    has a null component. Repeated rows each get a row. An empty table gives no rows.
    """
    marked = pinned(fingerprints(docs, id_col, text_col))
    prints = pinned(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(near_links(prints))
    rooted = prints.join(roots, prints.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(node, key)``: texts whose fingerprints are joined by links of at most two bits share a key.

    Fingerprints of five-word shingles, as ``near_copies`` compares them; ``node`` is its
    digest of the text.
    """
    texts = docs.select(near_copies.digest(F.col(text_col)).alias("doc_id"), F.col(text_col).alias("text"))
    marked = pinned(fingerprints(texts, width=near_copies.WORDS).distinct())
    roots = components(near_links(pinned(marked.select("fp").distinct())))
    root = F.coalesce("root", "fp")
    rooted = marked.join(roots, marked.fp == roots.node, "left")
    return rooted.select(F.col("doc_id").alias("node"), F.xxhash64(F.lit("fingerprint"), root).alias("key"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies (see ``near_copies``), all columns as they were.

    Texts of one group of fingerprints meet and are compared exactly; pairs whose fingerprints
    differ in more bits although their texts are similar enough meet by MinHash keys.

    The row with the smallest id stays; in a group without ids, one row. Rows are told apart
    by id and words, so an id may stand on different texts. Other columns are never read,
    whatever they are called.
    """
    grouped = near_copies.groups(docs, id_col, text_col, candidates(docs, text_col)).where("doc_id <=> component_id")
    counted = grouped.groupBy("root", "doc_id", "node").agg(F.count(F.lit(1)).alias("n"))
    first = counted.groupBy("root", "doc_id").agg(F.min(F.struct("node", "n")).alias("row"))
    keep_id, keep_node, node = (fresh(name, docs) for name in ("keep_id", "keep_node", "own_node"))
    kept = pinned(first.select(F.col("doc_id").alias(keep_id), F.col("row.node").alias(keep_node), F.col("row.n").alias("n")))
    marked = docs.withColumn(node, near_copies.digest(F.col(text_col)))

    def rows(chosen: DataFrame) -> DataFrame:
        match = marked[id_col].eqNullSafe(chosen[keep_id]) & (marked[node] == chosen[keep_node])
        return marked.join(chosen, match, "left_semi")

    out = rows(kept.where("n = 1").drop("n"))
    several = kept.where("n > 1").drop("n")
    if not several.isEmpty():
        out = out.unionByName(rows(several).dropDuplicates([id_col, node]))
    return out.drop(node)
