"""Session settings and shared scratch space."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the plans count on; all can be set on a running session.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even where the aggregate above then needs a shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Group rows that are already in order as neighbours, without a table or another sort.
    "spark.sql.execution.replaceHashWithSortAgg": "true",
}


def tune(spark: SparkSession, shuffle_bytes: int | None = None) -> SparkSession:
    """Apply the runtime settings to a session and return it.

    ``shuffle_bytes``, the size of the largest shuffle, raises the partition count to one
    per 128 MB so that each fits in an executor; adaptive execution merges small ones.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if shuffle_bytes is not None:
        wanted = math.ceil(shuffle_bytes / (128 * 1024 * 1024))
        current = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set("spark.sql.shuffle.partitions", str(max(current, wanted)))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder. A cluster session
    without it is refused: a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="repostrata-")
        context.setCheckpointDir(folder)
    return folder


def _base(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/repostrata-{spark.sparkContext.applicationId}"


def file_system(spark: SparkSession, path: str):
    """The file system of a path and the path as an object of it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; those of one application lie together.

    They are deleted when the application ends, or before that by ``release``.
    """
    base = _base(spark)
    files, place = file_system(spark, base)
    files.mkdirs(place)
    files.deleteOnExit(place)
    return f"{base}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete all scratch tables of this application: results built on them must be written by now."""
    files, place = file_system(spark, _base(spark))
    files.delete(place, True)


def discard(spark: SparkSession, path: str) -> None:
    """Delete one scratch table that no later plan reads."""
    files, place = file_system(spark, path)
    files.delete(place, True)


def pinned(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder so that later plans read one fixed result.

    A lost executor then never recomputes it to something else. A parquet table instead
    of an RDD checkpoint: it is computed once, and readers prune its columns.
    """
    return stored(df)[0]


def stored(df: DataFrame, codec: str | None = None) -> tuple[DataFrame, str]:
    """What ``pinned`` returns, and the path to ``discard`` once no later plan reads it."""
    spark = df.sparkSession
    path = scratch_path(spark, "pinned")
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes within drop their shuffle files as they end, not when the driver next collects garbage."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)
