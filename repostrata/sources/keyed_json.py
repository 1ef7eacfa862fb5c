"""One JSON object ``{key: document}`` of any size and layout, read in blocks.

Where an object's members begin depends on all that stands before: whether a place is inside
a text and how deep it is nested. Each block is first read on its own, for both cases of what
its first byte is in; sums over the blocks before it then tell which case holds and how deep
it starts. With that each block is cut at its top-level commas, and only what lies across the
ends of blocks is put together. No task holds more than a block, or one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from repostrata.session import pinned

BLOCK = 4 * 1024 * 1024
_QUOTE, _BACKSLASH, _COMMA = b'"\\,'


def blocks_of(spark: SparkSession, uri: str, size: int = BLOCK) -> DataFrame:
    """``(file, block, start, length)`` for a file, or every file in a folder."""
    store, root = fs.FileSystem.from_uri(uri)
    info = store.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root))
    files = [(i.path, i.size) for i in found if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))]
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest("size", F.lit(1)) - 1) / size))).alias("block")
    blocks = spark.createDataFrame(files, "file string, size long").select("file", "size", each)
    start = F.col("block") * size
    dealt = blocks.select("file", "block", start.alias("start"), F.least(F.lit(size), F.col("size") - start).alias("length"))
    return dealt.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file", "block")


def _read(store: fs.FileSystem, path: str, start: int, length: int) -> tuple[bytes, bool]:
    """Bytes of a block, and whether a backslash before it escapes the first one."""
    with store.open_input_file(path) as file:
        file.seek(start)
        raw = file.read(length)
        back = 0
        while back < start:
            step = min(4096, start - back)
            file.seek(start - back - step)
            before = file.read(step)
            run = len(before) - len(before.rstrip(b"\\"))
            back += run
            if run < step:
                break
    return raw, back % 2 == 1


def quotes(raw: np.ndarray, escaped: bool) -> np.ndarray:
    """Which bytes are quotes that open or close a text."""
    at = np.flatnonzero(raw == _QUOTE)
    plain = np.flatnonzero(raw != _BACKSLASH)
    # The last byte before each quote that is no backslash, and so the length of the run between.
    where = np.searchsorted(plain, at) - 1
    last = np.where(where >= 0, plain[np.maximum(where, 0)] if len(plain) else -1, -1)
    run = at - 1 - last + (escaped & (last < 0))
    out = np.zeros(len(raw), bool)
    out[at[run % 2 == 0]] = True
    return out


def _steps(raw: np.ndarray, inside: np.ndarray) -> np.ndarray:
    opens = (raw == ord("{")) | (raw == ord("["))
    closes = (raw == ord("}")) | (raw == ord("]"))
    return np.where(inside, 0, opens.astype(np.int64) - closes)


def summary(raw: bytes, escaped: bool) -> tuple[int, int, int]:
    """Parity of the quotes, and the change in depth if the block starts outside or inside a text."""
    data = np.frombuffer(raw, np.uint8)
    marks = quotes(data, escaped)
    inside = np.cumsum(marks) % 2 == 1
    return int(marks.sum() % 2), int(_steps(data, inside).sum()), int(_steps(data, ~inside).sum())


def cut(raw: bytes, escaped: bool, inside: bool, depth: int) -> list[bytes]:
    """Pieces of a block between top-level commas; the first one goes on from the block before."""
    data = np.frombuffer(raw, np.uint8)
    within = (np.cumsum(quotes(data, escaped)) + inside) % 2 == 1
    steps = _steps(data, within)
    level = depth + np.cumsum(steps)
    ends = ~within & ((data == _COMMA) & (level == 1) | (steps == 1) & (level == 1) | (steps == -1) & (level == 0))
    at = np.flatnonzero(ends)
    return [raw[a:b] for a, b in zip([0, *(at + 1).tolist()], [*at.tolist(), len(raw)])]


def read_members(spark: SparkSession, uri: str, size: int = BLOCK) -> DataFrame:
    """``(key, doc VARIANT)`` for each member of the object in a file, or in every file of a folder.

    The blocks are read twice and written once. ``uri`` is a local path or a store that Arrow
    can read. Text outside the object is ignored; an empty object gives no rows.
    """
    blocks = blocks_of(spark, uri, size)

    def opened(batches: Iterator[pa.RecordBatch]):
        store = fs.FileSystem.from_uri(uri)[0]
        for batch in batches:
            for row in batch.to_pylist():
                yield row, *_read(store, row["file"], row["start"], row["length"])

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, raw, escaped in opened(batches):
            yield pa.RecordBatch.from_pylist([row | dict(zip(("parity", "outside", "within"), summary(raw, escaped)))], _SUMMED)

    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    summed = blocks.mapInArrow(sum_up, "file string, block long, start long, length long, parity long, outside long, within long")
    placed = summed.withColumn("inside", total("parity") % 2 == 1)
    placed = placed.withColumn("change", F.when(F.col("inside"), F.col("within")).otherwise(F.col("outside")))
    placed = placed.withColumn("depth", total("change")).select("file", "block", "start", "length", "inside", "depth")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, raw, escaped in opened(batches):
            pieces = cut(raw, escaped, row["inside"], row["depth"])
            n = len(pieces)
            columns = [[row["file"]] * n, [row["block"]] * n, list(range(n)), [n - 1] * n, pieces]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CUT)], schema=_CUT)

    dealt = placed.repartition("file", "block")
    pieces = pinned(dealt.mapInArrow(cut_up, "file string, block long, piece long, last long, text binary"))
    whole = pieces.where((F.col("piece") > 0) & (F.col("piece") < F.col("last"))).select("text")
    # What a first piece goes on from: the last piece of the nearest block before with a comma.
    ends = pieces.select("file", "block", "last").distinct()
    owner = F.last(F.when(F.col("last") > 0, F.col("block")), ignorenulls=True).over(before)
    owned = ends.select("file", "block", owner.alias("owner"))
    first = pieces.where("piece = 0").join(owned, ["file", "block"]).select("file", "owner", "block", "text")
    last = pieces.where("piece > 0 and piece = last").select("file", F.col("block").alias("owner"), "block", "text")
    parts = first.where("owner is not null").unionByName(last).groupBy("file", "owner")
    joined = parts.agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
    text = F.aggregate("parts", F.lit(b""), lambda all_, part: F.concat(all_, part["text"]))
    members = whole.unionByName(joined.select(text.alias("text"))).select(F.trim(F.col("text").cast("string"), F.lit(" \t\r\n")).alias("text"))
    entries = F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), "map<string, variant>")
    return members.where("text like '\"%'").select(F.explode(entries).alias("key", "doc"))


_SUMMED = pa.schema([("file", pa.string()), *((n, pa.int64()) for n in ("block", "start", "length", "parity", "outside", "within"))])
_CUT = pa.schema([("file", pa.string()), *((n, pa.int64()) for n in ("block", "piece", "last")), ("text", pa.binary())])
