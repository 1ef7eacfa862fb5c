"""Keep-last merges of result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from repostrata.operators.buckets import TARGET, BucketTable


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` of each key.

    Spark limits each key to one row before the shuffle, so a key that holds most of the
    rows costs one row per task. ``order`` should be unique per key.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__place", F.row_number().over(newest)).where(F.col("__place") == 1).drop("__place")


def merge(
    existing: DataFrame | None, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """Existing and new rows, the last row of each key kept.

    ``order`` ranks the rows of a key; at equal rank a new row replaces an existing one.
    Columns that only one side has are NULL on the other.
    """
    batch = new.withColumn("__batch", F.lit(1))
    if existing is not None:
        batch = existing.withColumn("__batch", F.lit(0)).unionByName(batch, allowMissingColumns=True)
    return keep_last(batch, keys, [*order, "__batch"]).drop("__batch")


def new_keys(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Keys of ``incoming`` that ``existing`` does not have yet."""
    return incoming.select(key).distinct().join(existing.select(key), key, "left_anti")


def upsert_table(
    new: DataFrame,
    path: str,
    keys: Sequence[str],
    order: Sequence[str] = (),
    bucket_by: Sequence[str] = ("repo",),
    buckets: int = 4,
    target: int = TARGET,
    batch: tuple[str, int] | None = None,
) -> bool:
    """Merge rows into a stored table laid out in hash buckets of ``bucket_by``.

    Only buckets with new rows are read and rewritten; the number of buckets, ``buckets`` at
    first, grows with the table so that they keep about ``target`` bytes. ``bucket_by`` must
    be among ``keys`` and stay the same for the life of the table. A ``batch`` (name of a
    stream and number) that the table has applied before is left out; then the result is False.
    """
    if not set(bucket_by) <= set(keys):
        raise ValueError("bucket_by must be among the keys")
    table = BucketTable(new.sparkSession, path, bucket_by, buckets=buckets, target=target)
    return table.commit(new, lambda old, rows: merge(old, rows, keys, order), batch)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table written by ``upsert_table``; columns added later are NULL in older rows."""
    rows = BucketTable(spark, path).read()
    if rows is None:
        raise ValueError(f"no stored table at {path}")
    return rows
