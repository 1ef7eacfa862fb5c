"""Benchmark decontamination with one Aho-Corasick automaton over the test items.

Questions and answers are normalised to words. A window is ``WINDOW`` consecutive words of
an item, or the whole of a shorter one. Whatever its start, a window covers one of the
item's blocks of ``BLOCK`` words at 0, 7, 14, ..., so those blocks are the patterns: the
automaton has one node per character of the benchmark at most. Each document is normalised
the same way and scanned once; a match is extended to both sides along its item, and counts
when the common run is as long as a window. Matches are counted in words, and mapped back to
character spans of the original text where those are asked for.

The benchmark is the query set: it goes to the executors in parts of at most ``MAX_BYTES``
of text, one automaton each. Usually that is one part; with more, the documents are scanned
once per part and the hits of a row are united.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from repostrata.llm.common import as_bytes, keep_rows, settle
from repostrata.session import pinned

WINDOW = 13
BLOCK = (WINDOW + 1) // 2
MAX_BYTES = 1024 * 1024
MIN_PERCENT = 5
# Bytes that end a word become spaces and A-Z become lower case; all others stay.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normalised(text: bytes) -> list[bytes]:
    """Words of UTF-8 text: runs of digits, letters and non-ASCII characters, A-Z lowered."""
    return text.translate(_FOLD).split()


class Automaton:
    def __init__(self, items: list[tuple], window: int = WINDOW):
        """``items`` are ``(id, text)``; equal ids are one item, null is an id too."""
        self.machine, self.window = ahocorasick.Automaton(), window
        self.items = [(item, normalised((text or "").encode())) for item, text in items]
        block, found = (window + 1) // 2, {}
        for number, (_, words) in enumerate(self.items):
            size = block if len(words) >= window else len(words)
            for at in range(0, len(words) - size + 1, block) if words else ():
                found.setdefault(b" ".join(words[at : at + size]), []).append((number, at, size))
        for text, places in found.items():
            # One character per byte; the spaces around make matches begin and end at words.
            padded = f" {text.decode('latin-1')} "
            self.machine.add_word(padded, (len(padded), places))
        if found:
            self.machine.make_automaton()

    def find(self, text: bytes) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, ``(first, last + 1)`` word ranges of all matches, and their items."""
        words = normalised(text)
        if not words or not len(self.machine):
            return len(words), [], set()
        line = b" " + b" ".join(words) + b" "
        matches = [(end - n + 1, places) for end, (n, places) in self.machine.iter(line.decode("latin-1"))]
        if not matches:
            return len(words), [], set()
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        firsts = np.searchsorted(gaps, [start for start, _ in matches]).tolist()
        ranges, items, seen = set(), set(), {}
        for first, (number, at, size) in ((f, place) for f, (_, places) in zip(firsts, matches) for place in places):
            if seen.get((number, first - at), -1) > first:
                continue  # the run that holds this block has been followed
            item, other = self.items[number]
            start, end = first, first + size
            while start > 0 and at - (first - start) > 0 and words[start - 1] == other[at - (first - start) - 1]:
                start -= 1
            while end < len(words) and end - first + at < len(other) and words[end] == other[end - first + at]:
                end += 1
            seen[number, first - at] = end
            if end - start >= min(self.window, len(other)):
                ranges.add((start, end))
                items.add(item)
        return len(words), _united(list(ranges)), items


def _united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def contaminated(n_words: int, n_hit: int, percent: int = MIN_PERCENT) -> bool:
    return n_hit > 0 and 100 * n_hit >= percent * n_words


def char_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text for ranges of words."""
    if not ranges:
        return []
    places = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    return [(places[a][0], places[b - 1][1]) for a, b in ranges]


_LOWER = {upper: upper + 32 for upper in range(65, 91)}


def item_parts(items: DataFrame, max_bytes: int = MAX_BYTES) -> list[list[tuple]]:
    """The items ``(item_id, text)`` in parts of about ``max_bytes`` of text, by hash."""
    total = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    count = -(-total // max_bytes) or 1
    parts = []
    for k in range(count):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        parts.append([(r.item_id, r.text) for r in part.select("item_id", "text").collect()])
    return parts


_HITS = "n_words long, ranges array<struct<first:long,last:long>>, items array<string>"


def _scan(docs: DataFrame, items: list[tuple], keys: list[str]) -> DataFrame:
    """``keys``, number of words, hit word ranges and ids of the items found, per row."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    names = [*keys, "n_words", "ranges", "items"]
    range_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(shared.value)
        for batch in batches:
            found = [automaton.find(t) for t in as_bytes(batch.column(len(keys)))]
            ranges = [[{"first": a, "last": b} for a, b in f[1]] for f in found]
            ids = [sorted("" if i is None else str(i) for i in f[2]) for f in found]
            columns = [pa.array([f[0] for f in found], pa.int64()), pa.array(ranges, range_type)]
            columns.append(pa.array(ids, pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *columns], names)

    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, "text").mapInArrow(run, f"{kinds}, {_HITS}")


def scan(docs: DataFrame, items: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``(doc_id, n_words, ranges, items)`` per row: every occurrence of a benchmark window.

    ``ranges`` are disjoint word ranges, ``items`` the distinct ids as sorted strings; a null
    item id counts as the empty string. Null and empty texts have no words, items without
    words no window. Repeated rows get equal results, and whole texts are read.
    """
    settle(docs.sparkSession)
    blocks = item_parts(items, max_bytes)
    if len(blocks) == 1:
        return _scan(docs, blocks[0], ["doc_id"])
    # Equal rows have equal hits, so the text's digest and the id name a row well enough.
    keyed = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    distinct = pinned(keyed.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies")))
    parts = [pinned(_scan(keyed, block, ["doc_id", "digest"]).distinct()) for block in blocks]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    merged = every.groupBy("doc_id", "digest").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("ranges"))).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    same = merged.doc_id.eqNullSafe(distinct.doc_id) & (merged.digest == distinct.digest)
    rows = merged.join(distinct, same).select(merged.doc_id, "n_words", "ranges", "items", "copies")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("doc_id", "n_words", _disjoint("ranges").alias("ranges"), "items")


def _disjoint(ranges: str):
    """Sorted word ranges united where they overlap or touch."""
    empty = F.slice(F.col(ranges), 1, 0)

    def add(done, r):
        last = F.element_at(done, -1)
        joined = F.struct(last["first"].alias("first"), F.greatest(last["last"], r["last"]).alias("last"))
        touches = (F.size(done) > 0) & (r["first"] <= last["last"])
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(
            F.concat(done, F.array(r))
        )

    return F.when(F.size(ranges) == 0, empty).otherwise(F.aggregate(ranges, empty, add))


def report(docs: DataFrame, items: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per document: words, hit words, items found, their digest and the verdict."""
    lengths = F.transform("ranges", lambda r: r["last"] - r["first"])
    hits = F.aggregate(lengths, F.lit(0).cast("long"), lambda total, n: total + n)
    rows = scan(docs, items, max_bytes).withColumn("n_hit", hits)
    verdict = (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= MIN_PERCENT * F.col("n_words"))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        verdict.alias("contaminated"),
    )


def spans(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, start, end, passage)``: contaminated passages with offsets into the original text.

    One row per disjoint passage, in characters; documents without hits have no row. For a
    benchmark of one block.
    """
    settle(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(item_parts(items, 1 << 62)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(shared.value)
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            texts = batch.column(1).to_pylist()
            for i, raw in enumerate(as_bytes(batch.column(1))):
                for start, end in char_spans(texts[i] or "", automaton.find(raw)[1]):
                    for column, value in zip(rows, (i, start, end, texts[i][start:end])):
                        column.append(value)
            ids = batch.column(0).take(pa.array(rows[0], pa.int64()))
            others = [pa.array(rows[k], kind) for k, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.string()))]
            yield pa.RecordBatch.from_arrays([ids, *others], ["doc_id", "start", "end", "passage"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, end long, passage string")


def clean(docs: DataFrame, items: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they were.

    Rows with null or empty text stay. No column but ``text`` is read.
    """
    settle(docs.sparkSession)
    blocks = item_parts(items, max_bytes)
    shared = [docs.sparkSession.sparkContext.broadcast(b) for b in blocks]
    place = docs.columns.index("text")

    def decide(batch: pa.RecordBatch) -> list[bool]:
        texts = as_bytes(batch.column(place))
        hits: list[list] = [[] for _ in texts]
        counts = [0] * len(texts)
        for block in shared:
            automaton = _cached(block)
            for i, text in enumerate(texts):
                counts[i], ranges, _ = automaton.find(text)
                hits[i] += ranges
        covered = [sum(b - a for a, b in _united(h)) for h in hits]
        return [not contaminated(n, c) for n, c in zip(counts, covered)]

    built: dict[int, Automaton] = {}

    def _cached(block) -> Automaton:
        if id(block) not in built:
            if len(shared) > 1:
                built.clear()
            built[id(block)] = Automaton(block.value)
        return built[id(block)]

    return keep_rows(docs, decide)
