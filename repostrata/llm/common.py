"""Helpers that the corpus operators share."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_BYTES = 16 * 1024 * 1024


def settle(spark: SparkSession, most: int = _BATCH_BYTES) -> SparkSession:
    """Bound Arrow batches by bytes as well as rows, so long texts do not pile up in a worker.

    A smaller bound in bytes that was set before stays.
    """
    now = spark.conf.get(_BATCH)
    if not now.isdecimal() or int(now) > most:
        spark.conf.set(_BATCH, str(most))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return settle(spark).read.parquet(f"{folder}/{name}.parquet")


def fresh(base: str, *frames: DataFrame) -> str:
    """``base``, or a longer name that no column of ``frames`` has, whatever its case."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while base.lower() in taken:
        base += "_"
    return base


def in_bucket(column: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; null ids do not."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus == remainder, F.lit(False))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of each text; null becomes empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def keep_rows(docs: DataFrame, decide: Callable[[pa.RecordBatch], list[bool]]) -> DataFrame:
    """Rows for which ``decide`` says yes, all columns as they were, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(decide(batch), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


_SCALE = 1 << 30


def sampled(rows: DataFrame, by: str, need: dict | int) -> DataFrame:
    """At most ``need`` rows per value of ``by``, those with the smallest hashes of ``doc_id``.

    Values are few: their counts come to the driver. They set a share of the hashes within
    which three times as many rows as needed are expected, so that what is ranked stays small
    however many tasks there are. Equal rows count once.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy(by).count().collect()}
    share, most = F.lit(0), F.lit(0)
    for value, size in sizes.items():
        wanted = need if isinstance(need, int) else need.get(value, 0)
        same = F.col(by) == F.lit(value)
        share = F.when(same, min(_SCALE, math.ceil(3 * wanted * _SCALE / size))).otherwise(share)
        most = F.when(same, wanted).otherwise(most)
    digest = F.xxhash64("doc_id", F.lit("sample"))
    near = rows.where(F.pmod(digest, F.lit(_SCALE)) < share).distinct()
    place, wanted = fresh("place", rows), fresh("most", rows)
    order = Window.partitionBy(by).orderBy(F.pmod(digest, F.lit(_SCALE)), "doc_id")
    ranked = near.withColumn(place, F.row_number().over(order)).withColumn(wanted, most)
    return ranked.where(F.col(place) <= F.col(wanted)).drop(place, wanted)


def bit_filter(hashes: DataFrame, column: str, words: int) -> np.ndarray:
    """A set of 64-bit hashes as ``words`` (a power of two) longs of bits; it may hold others as well.

    Its size is fixed by ``words``, whatever the number of hashes.
    """
    slot = F.pmod(column, F.lit(words * 64))
    bit = F.expr(f"shiftleft(1L, cast(pmod({column}, {words * 64}) % 64 as int))")
    rows = hashes.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(words, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter may hold; all that were put in are among them."""
    slots = hashes & (len(bits) * 64 - 1)
    return (bits[slots >> 6] >> (slots & 63)) & 1 == 1


def filter_words(n: int, most: int = 1 << 20) -> int:
    """Longs for a filter of ``n`` hashes, eight bits each, at most 8 MB in all."""
    return min(most, 1 << max(10, (n // 8).bit_length()))
