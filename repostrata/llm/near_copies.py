"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from MinHash: ``BANDS`` keys of ``ROWS`` minima each, of which a pair at the
limit shares one with probability 0.9994 and a closer pair with more. A candidate counts
only if the exact similarity of the two texts reaches the limit.

First each text of a key is linked to one other only, which joins nearly all of a group of
copies at a few pairs a member: at first as a tree of few levels, since a chain of neighbours
takes components more rounds the longer it is, then neighbours. What is left are keys that hold texts of different components, such as texts
of one template that resemble each other below the limit. There no list of pairs is made
either: the texts of a key meet in bounded blocks, each with its set of shingles once, and only
links come out. A key with more than a block holds is dealt out by pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from repostrata.llm.common import as_bytes, settle
from repostrata.llm.components import components
from repostrata.session import discard, pinned, stored

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 40, 8
_SKETCH = [f"s{i}" for i in range(BANDS * ROWS // 64)]  # one bit per minimum
APART = 53  # of 320 bits. At the limit 32 differ on average (deviation 5.4), between strangers 160
FIRST = 8  # one of so many keys makes links before all do
_LEVEL = 5  # zero bits at the end of a node for each of its levels in a tree
BLOCK = 8192  # texts of a key that are compared by sketch at a time
_HASHES = 1 << 20  # shingles of a key that are compared exactly at a time
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FACTORS = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PAIR = "a long, b long"


def digest(text: Column) -> Column:
    """A hash of the words of a text; ASCII letters count as lower case, null as no words."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.xxhash64(F.trim(F.regexp_replace(lowered, r"[\x20\x09-\x0D]+", " ")))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of UTF-8 text; a shorter text is one shingle."""
    words = text.lower().split()
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < WORDS:
        return np.array([hashed(joined)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    spans = zip(starts.tolist(), ends[WORDS - 1 :].tolist())
    return np.unique(np.fromiter((hashed(joined[s:e]) for s, e in spans), np.uint64, len(words) - WORDS + 1))


def signature(hashes: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """A sketch of a set of hashes (one bit per minimum) and its keys, as signed numbers."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 256):
        low = np.minimum(low, (hashes[at : at + 256, None] * _FACTORS).min(axis=0))
    bits = np.packbits((low >> np.uint64(5)).astype(np.uint8) & 1).view(np.int64)
    keys = [xxhash.xxh64_intdigest(low[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    return bits, np.array(keys, np.uint64).view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of hashes are similar enough; both are sorted."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILAR * (len(a) + len(b) - both)


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, node, sketch, keys)`` per row; texts of fewer than five words have no keys."""
    none = np.zeros(len(_SKETCH), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches, keys = [], []
            for text in as_bytes(batch.column(2)):
                bits, own = signature(shingles(text)) if len(text.split(None, WORDS - 1)) == WORDS else (none, [])
                sketches.append(bits)
                keys.append(own)
            parts = np.array(sketches, np.int64).reshape(-1, len(_SKETCH))
            columns = [batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(c)) for c in parts.T)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "node", *_SKETCH, "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), digest(F.col(text_col)).alias("node"), F.col(text_col))
    return rows.mapInArrow(run, f"doc_id {kind}, node long, {_longs(_SKETCH)}, keys array<long>")


def _longs(names: list[str]) -> str:
    return ", ".join(f"{n} long" for n in names)


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _table(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _apart(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many bits of two sketches differ, along the last axis."""
    return np.bitwise_count((one ^ other).view(np.uint64)).sum(axis=-1, dtype=np.int64)


def _sorted(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows in order of key and node. Ranges, so that a key of any size is split."""
    return rows.repartitionByRange(tasks, "key", "node").sortWithinPartitions("key", "node")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(key, node, ...)`` of keys that more than one text has; at the ends of a range any."""
    held, names = None, []
    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        columns = _arrays(batch)
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held[:-1], columns)]
            before = held[-1]
        else:
            before = first
        key = columns[0]
        same = key[1:] == key[:-1]
        good = np.r_[before, same] | np.r_[same, False]
        yield _table([c[:-1][good[:-1]] for c in columns], names)
        held = [*(c[-1:] for c in columns), bool(same[-1]) if len(same) else before]
        first = False
    if held is not None:
        yield _table(held[:-1], names)


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each text and one before it in its key, of different components and near by their sketches.

    The other one is the last of a higher level, or else the first of the key; where it is not near, the
    neighbour. Levels follow from the node, so keys that hold the same texts make the same pairs, and the
    links of a group are a tree whose depth grows with the logarithm of its size.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns, old = _arrays(batch), 0
        if held is not None:
            old = len(held[0])
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
        key, node, root = columns[:3]
        sketch = np.stack(columns[3:], axis=-1)
        at = np.arange(len(key))
        first = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], at, 0))
        bits = node.view(np.uint64)
        level = np.bitwise_count((bits & -bits) - np.uint64(1)) // _LEVEL
        up = first.copy()
        last = [at[key == key[-1]][0]]
        for n in np.unique(level).tolist():
            higher = np.maximum.accumulate(np.where(level > n, at, -1))
            up = np.where(level == n, np.maximum(first, higher), up)
            last += np.flatnonzero((level == n) & (key == key[-1]))[-1:].tolist()
        before = np.maximum(at - 1, first)
        up = np.where(_apart(sketch, sketch[up]) <= APART, up, before)
        good = (at >= old) & (root != root[up]) & (_apart(sketch, sketch[up]) <= APART)
        one, other = node[good], node[up[good]]
        yield _table([np.minimum(one, other), np.maximum(one, other)], ["a", "b"])
        held = [c[np.unique(last)] for c in columns]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs next to each other in a key, of different components and near by their sketches."""
    held = None
    for batch in batches:
        columns = _arrays(batch)
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
        key, node, root = columns[:3]
        sketch = np.stack(columns[3:], axis=-1)
        good = (key[1:] == key[:-1]) & (root[1:] != root[:-1]) & (_apart(sketch[1:], sketch[:-1]) <= APART)
        yield _table([node[:-1][good], node[1:][good]], ["a", "b"])
        held = [c[-1:] for c in columns]


def _met(work, names: list[str]):
    """Hand the columns of whole groups to ``work(columns, starts, sizes)``.

    Rows arrive sorted by their first column, the number of the group. A group is at most two
    blocks, so what is held is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def give():
            columns = [np.concatenate(c) for c in zip(*held)]
            starts = np.flatnonzero(np.r_[True, columns[0][1:] != columns[0][:-1]])
            return _table(work(columns, starts, np.diff(np.r_[starts, len(columns[0])])), names)

        for batch in batches:
            new = _arrays(batch)
            if not len(new[0]):
                continue
            cut = int(np.searchsorted(new[0], new[0][-1]))
            if held and new[0][0] != held[-1][0][-1]:
                yield give()
                held.clear()
            if cut:
                held.append([c[:cut] for c in new])
                yield give()
                held.clear()
            held.append([c[cut:] for c in new])
        if held:
            yield give()

    return run


def _blocked(rows: DataFrame, weight: Column, limit: int) -> DataFrame:
    """Rows of keys with more than one component, dealt to groups: ``group, block, ...``.

    A key whose weights add up to at most ``limit`` is a group. A heavier one is cut into
    blocks, and each pair of blocks is a group, as is each block by itself.
    """
    sizes = rows.groupBy("key").agg(F.sum(weight).alias("w"), F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = sizes.where("low <> high").select("key", F.ceil(F.col("w") / limit).alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = rows.join(mixed, "key").withColumn("block", own)
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = F.xxhash64("key", F.least("block", "with"), F.greatest("block", "with"))
    group = F.when(F.col("blocks") == 1, F.col("key")).otherwise(pair)
    rest = [c for c in rows.columns if c != "key"]
    return dealt.select(group.alias("group"), "block", "key", *rest).repartition("group").sortWithinPartitions("group", "node")


def _others(root: np.ndarray, block: np.ndarray, key: np.ndarray):
    """For the texts outside the largest component: a number, and those to compare it with."""
    _, which, counts = np.unique(root, return_inverse=True, return_counts=True)
    main = which == counts.argmax()
    crossing = block.min() != block.max()
    for i in np.flatnonzero(~main).tolist():
        good = (which != which[i]) & (key == key[i])
        good[:i] &= main[:i]
        if crossing:
            good &= block != block[i]
        yield i, good


def _involved(columns, starts, sizes):
    """``(key, node)`` of texts with a text of another component near by their sketches."""
    _, block, key, node, root = columns[:5]
    sketch = np.stack(columns[5:], axis=-1)
    near = np.zeros(len(node), bool)
    for start, size in zip(starts.tolist(), sizes.tolist()):
        here = slice(start, start + size)
        for i, good in _others(root[here], block[here], key[here]):
            good &= _apart(sketch[here], sketch[start + i]) <= APART
            if good.any():
                near[here] |= good
                near[start + i] = True
    return key[near], node[near]


def _links(columns, starts, sizes):
    """Pairs of similar texts of different components in each group, one per component and text."""
    _, block, key, node, root, hashes = columns[:6]
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for start, size in zip(starts.tolist(), sizes.tolist()):
        here = slice(start, start + size)
        sets = [np.frombuffer(h, np.uint64) for h in hashes[here]]
        counts = np.array([len(s) for s in sets])
        words, which = np.unique(np.concatenate(sets), return_inverse=True)
        edges = np.r_[0, np.cumsum(counts)]
        marked = np.zeros(len(words), np.int64)
        for i, good in _others(root[here], block[here], key[here]):
            if not good.any():
                continue
            own = which[edges[i] : edges[i + 1]]
            marked[own] = 1
            both = np.add.reduceat(marked[which], edges[:-1])
            marked[own] = 0
            good &= both >= SIMILAR * (counts + counts[i] - both)
            _, first = np.unique(root[here][good], return_index=True)
            other = node[here][good][first]
            ends.append((np.minimum(other, node[start + i]), np.maximum(other, node[start + i])))
    return [np.concatenate([e[i] for e in ends] or [np.empty(0, np.int64)]) for i in (0, 1)]


def _sets(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(node, hashes)`` of all candidates ``wanted(of, first)``: sorted hashes of their shingles, once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t).tobytes() for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "hashes"])

    rows = docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("node"), F.col(text_col).alias("text"))
    # By id and hash, so that rows with the same text do not meet in one task.
    match = rows["id"].eqNullSafe(wanted["first"]) & (rows.node == wanted.of)
    chosen = rows.join(wanted, match, "left_semi").select("node", "text")
    return chosen.mapInArrow(run, "node long, hashes binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose texts are similar."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(*(batch.column(k).to_pylist() for k in (2, 3)))
            good = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in both]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    one = sets.select(F.col("node").alias("a"), F.col("hashes").alias("one"))
    other = sets.select(F.col("node").alias("b"), F.col("hashes").alias("other"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "one", "other").mapInArrow(judge, _PAIR)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more_keys: DataFrame | None = None) -> DataFrame:
    """``(doc_id, node, root, component_id)``: one row per row of ``docs``.

    Texts meet by their MinHash keys and by ``more_keys(node, key)``, found some other way.

    ``node`` is a hash of the words, ``root`` the smallest one of the group. ``component_id`` is the smallest id among the documents
    reachable over near copies, itself included. Null texts and texts without words are
    copies of each other. Null ids are passed through and never chosen: a group of null ids
    only has a null component. Repeated rows each get a row. An empty table gives no rows.
    """
    spark = settle(docs.sparkSession)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = pinned(_signed(docs, id_col, text_col))
    merged = [F.min("doc_id").alias("first"), *(F.first(c).alias(c) for c in [*_SKETCH, "keys"])]
    prints = pinned(marked.groupBy("node").agg(*merged))
    keyed = prints.select(F.explode("keys").alias("key"), "node")
    if more_keys is not None:
        shingled = prints.where(F.size("keys") > 0).select("node")
        keyed = keyed.unionByName(more_keys.join(shingled, "node").select("key", "node"))
    # Most keys have one text: sketches follow those that are left.
    shared = _sorted(keyed, tasks).mapInArrow(_shared, "key long, node long")
    buckets, buckets_path = stored(shared.join(prints.select("node", *_SKETCH), "node").select("key", "node", *_SKETCH))
    wanted = prints.join(buckets.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("of"), "first")
    sets, sets_path = stored(_sets(wanted, docs, id_col, text_col))
    roots, tried = None, None

    def rooted_rows(share: int = 1) -> DataFrame:
        rows = buckets.where(F.pmod("key", F.lit(share)) == 0)
        if roots is None:
            return rows.select("key", "node", F.col("node").alias("root"), *_SKETCH)
        return rows.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"), *_SKETCH)

    def more(found: DataFrame) -> None:
        nonlocal roots
        if not found.isEmpty():  # what was linked before is as well linked to its roots
            links = found if roots is None else found.unionByName(roots.selectExpr("node as a", "root as b"))
            roots = pinned(components(links))

    for share, linked in ((FIRST, _tree), (1, _neighbours)):
        pairs = _sorted(rooted_rows(share), tasks).mapInArrow(linked, _PAIR).distinct()
        pairs = pinned(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            tried = pairs if tried is None else tried.unionByName(pairs)
            more(pinned(_verified(pairs, sets)))
    rows = _blocked(rooted_rows(), F.lit(1), BLOCK)
    near = pinned(rows.mapInArrow(_met(_involved, ["key", "node"]), "key long, node long").distinct())
    if not near.isEmpty():
        rows = rooted_rows().drop(*_SKETCH).join(near, ["key", "node"]).join(sets, "node").select("key", "node", "root", "hashes")
        met = _blocked(rows, F.octet_length("hashes") / 8, _HASHES)
        more(pinned(met.mapInArrow(_met(_links, ["a", "b"]), _PAIR).distinct()))
    for path in (buckets_path, sets_path):
        discard(spark, path)
    rooted = prints.select("node", "first", F.col("node").alias("root"))
    if roots is not None:
        rooted = prints.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.select("node", "root").join(smallest, "root")
    return marked.join(named, "node").select("doc_id", "node", "root", "component_id")
