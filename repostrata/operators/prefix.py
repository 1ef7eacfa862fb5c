"""Running sums, row numbers and last-seen values without a one-task window.

``Window.orderBy`` without a partition, or with one hot partition key, moves the whole
group to a single task. Here the rows are range-partitioned on (keys, order) into
blocks, each block gets its own window, and what earlier blocks hold of the same key is
added as a carry. Blocks follow the sort order, so only the first key of a block can
have a carry: the carry table never has more rows than there are blocks, and is broadcast
while these are few.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from repostrata.session import discard, pinned, scratch_path

_BLOCK_BYTES = 64 * 1024 * 1024  # as written, that is compressed
_BROADCAST_BLOCKS = 10_000
_BLOCK = "__block"
_ROWS = "__rows"


def _blocks(written: DataFrame) -> int:
    """Shuffle partitions of the session, or more where the written rows are larger.

    Only of a plain table: its size is that of its files, not an estimate of a plan.
    """
    size = int(written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    partitions = int(written.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(partitions, -(-size // _BLOCK_BYTES))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, str] | None = None,
    lasts: dict[str, str] | None = None,
    number: str | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """Add cumulative columns per key in ascending ``order``.

    ``sums`` and ``lasts`` map a new column to its input column: the inclusive running
    sum, and the latest non-null value seen before or at the row. ``number`` names a
    1-based row number. ``keys`` may be empty. Rows equal on keys and order share a
    block, so ``order`` should be (close to) unique per key. The rows are written when this is
    called, first as they come: sampling them for the ranges then computes nothing twice, and
    the number of blocks follows from their size.
    """
    sums, lasts, keys, order = sums or {}, lasts or {}, list(keys), list(order)
    spark = df.sparkSession
    path = scratch_path(spark, "rows")
    df.write.parquet(path)
    fixed = spark.read.schema(df.schema).parquet(path)
    blocks = blocks or _blocks(fixed)
    placed = pinned(
        fixed.repartitionByRange(blocks, *keys, *order).withColumn(_BLOCK, F.spark_partition_id())
    )
    discard(spark, path)

    summary = placed.groupBy(*keys, _BLOCK).agg(
        F.count(F.lit(1)).alias(_ROWS),
        *[F.sum(src).alias(f"__sum_{new}") for new, src in sums.items()],
        *[
            F.max_by(src, F.when(F.col(src).isNotNull(), F.struct(*order))).alias(f"__last_{new}")
            for new, src in lasts.items()
        ],
    )
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *[F.col(k).alias(f"__key_{k}") for k in keys],
        F.col(_BLOCK).alias("__carry_block"),
        F.sum(_ROWS).over(before).alias("__carry_rows"),
        *[F.sum(f"__sum_{new}").over(before).alias(f"__carry_{new}") for new in sums],
        *[
            F.last(f"__last_{new}", ignorenulls=True).over(before).alias(f"__carry_{new}")
            for new in lasts
        ],
    ).where(F.col("__carry_rows") > 0)

    inside = (
        Window.partitionBy(_BLOCK, *keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = placed.select(
        *placed.columns,
        *[F.sum(src).over(inside).alias(f"__in_{new}") for new, src in sums.items()],
        *[F.last(src, ignorenulls=True).over(inside).alias(f"__in_{new}") for new, src in lasts.items()],
        *([F.count(F.lit(1)).over(inside).alias("__in_rows")] if number else []),
    )
    same: list[Column] = [local[_BLOCK] == carry["__carry_block"]]
    same += [local[k].eqNullSafe(carry[f"__key_{k}"]) for k in keys]
    # The carry has a row per block, so its size is known.
    near = F.broadcast(carry) if blocks <= _BROADCAST_BLOCKS else carry
    joined = local.join(near, reduce(lambda a, b: a & b, same), "left")

    def total(inner: str, outer: str, name: str) -> Column:
        return F.when(
            F.col(inner).isNotNull() | F.col(outer).isNotNull(),
            F.coalesce(F.col(inner), F.lit(0)) + F.coalesce(F.col(outer), F.lit(0)),
        ).alias(name)

    return joined.select(
        *df.columns,
        *[total(f"__in_{new}", f"__carry_{new}", new) for new in sums],
        *[F.coalesce(f"__in_{new}", f"__carry_{new}").alias(new) for new in lasts],
        *([total("__in_rows", "__carry_rows", number)] if number else []),
    )
