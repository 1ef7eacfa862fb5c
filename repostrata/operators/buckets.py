"""Stored tables in hash buckets that split as they grow.

A table is a folder of generations, one per commit, and a manifest. The manifest says how
many buckets there are, in which generation each one lies, its size, the schema, and which
batches have been applied. A commit writes the buckets it touches into a new generation and
then replaces the manifest, so readers and retries see all of it or nothing, files of other
buckets stay as they are, and what a table holds and what it has applied never disagree.

Buckets are numbered as in linear hashing: with ``n`` buckets a row lies at the low bits of
its hash, one bit fewer where that number does not exist yet. Adding a bucket moves rows out
of exactly one other, so growing rewrites only the buckets that split.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from repostrata.session import discard, file_system, scratch_path

BUCKET = "__bucket"
TARGET = 256 * 1024 * 1024  # bytes a bucket may have on average
LEAST = 8192
_MANIFEST = "_manifest.json"
Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


def bucket_of(columns: Sequence[str], buckets: int) -> Column:
    """Number of the bucket of a row among ``buckets``."""
    top = 1 << max(buckets - 1, 0).bit_length()
    value = F.pmod(F.xxhash64(*columns), F.lit(top))
    return F.when(value < buckets, value).otherwise(F.pmod(value, F.lit(max(top // 2, 1)))).cast("int")


def split_from(bucket: int, existing: int | None = None) -> int:
    """The bucket that gives rows to a new one, of the ``existing`` ones or among all lower ones."""
    source = bucket - (1 << bucket.bit_length() - 1)
    while existing is not None and source >= existing:
        source -= 1 << source.bit_length() - 1
    return source


class BucketTable:
    """A stored table at ``path``; ``kind`` is the file format, parquet or json.

    ``bucket_by``, ``kind`` and ``buckets`` (the number to start with) are fixed by the first
    commit. There must be one writer at a time.
    """

    def __init__(
        self, spark: SparkSession, path: str, bucket_by: Sequence[str] = ("repo",), kind: str = "parquet",
        buckets: int = 4, target: int = TARGET,
    ):
        if target < LEAST:
            raise ValueError(f"a bucket needs a target of {LEAST} bytes or more: files have a size of their own")
        self.spark, self.path, self.target = spark, path.rstrip("/"), target
        start = {"kind": kind, "by": list(bucket_by), "buckets": buckets, "schema": None, "in": {}, "bytes": {}, "applied": {}}
        self.state = self._load() or start

    def _load(self) -> dict | None:
        files, place = file_system(self.spark, f"{self.path}/{_MANIFEST}")
        for name in (place, place.suffix(".new")):  # a writer lost between the last two steps leaves the second
            if files.exists(name):
                stream = files.open(name)
                try:
                    text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
                return json.loads(text)
        return None

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        return BucketTable(spark, path).state["schema"] is not None

    @property
    def schema(self) -> T.StructType | None:
        return T.StructType.fromJson(self.state["schema"]) if self.state["schema"] else None

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """All rows, or those of some buckets; None before the first commit."""
        if self.schema is None:
            return None
        chosen = self.state["in"] if buckets is None else [str(b) for b in buckets if str(b) in self.state["in"]]
        paths = [f"{self.path}/{self.state['in'][b]}/{BUCKET}={b}" for b in chosen]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).format(self.state["kind"]).load(paths)

    def applied(self, stream: str, batch: int) -> bool:
        upto, later = self.state["applied"].get(stream, [-1, []])
        return batch <= upto or batch in later

    def commit(self, new: DataFrame, merge: Merge, batch: tuple[str, int] | None = None) -> bool:
        """Merge rows into their buckets: ``merge(existing, new)`` gives what a bucket then holds.

        A batch ``(stream, number)`` that the manifest lists is left out, and False returned.
        New rows are written to the shared folder first and the merged ones from there, so a
        lost executor or a changing source never leads to two versions of them.
        """
        if batch and self.applied(*batch):
            return False
        fixed = scratch_path(self.spark, "bucket-rows")
        where = bucket_of(self.state["by"], self.state["buckets"])
        new.withColumn(BUCKET, where).write.parquet(fixed)
        rows = self.spark.read.schema(T.StructType([*new.schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(fixed)
        touched = sorted(r[0] for r in rows.select(BUCKET).distinct().collect())
        if touched:
            self._store(merge(self.read(touched), rows.drop(BUCKET)), touched, self.state["buckets"], batch)
        elif batch:
            self._publish(self._noted(batch))
        discard(self.spark, fixed)
        while self._grow():
            pass
        return True

    def _noted(self, batch: tuple[str, int] | None) -> dict:
        state = json.loads(json.dumps(self.state))
        if batch:
            upto, later = state["applied"].get(batch[0], [-1, []])
            later = sorted({*later, batch[1]})
            while later and later[0] == upto + 1:
                upto = later.pop(0)
            state["applied"][batch[0]] = [upto, later]
        return state

    def _store(self, rows: DataFrame, touched: Sequence[int], buckets: int, batch: tuple[str, int] | None = None) -> None:
        """Write the whole new content of the touched buckets as a generation and publish it."""
        state = self._noted(batch)
        generation = f"generation-{uuid.uuid4().hex}"
        placed = rows.withColumn(BUCKET, bucket_of(state["by"], buckets))
        # Rebalancing brings a bucket's rows together and splits one that is too large for a task.
        placed.hint("rebalance", BUCKET).write.partitionBy(BUCKET).format(state["kind"]).save(f"{self.path}/{generation}")
        state["buckets"] = buckets
        state["schema"] = rows.schema.jsonValue()
        files, root = file_system(self.spark, f"{self.path}/{generation}")
        written = {s.getPath().getName(): s.getPath() for s in files.listStatus(root) if s.isDirectory()}
        old = {state["in"][str(b)] for b in touched if str(b) in state["in"]}
        for b in touched:
            state["in"].pop(str(b), None)
            state["bytes"].pop(str(b), None)
            if f"{BUCKET}={b}" in written:
                state["in"][str(b)] = generation
                state["bytes"][str(b)] = files.getContentSummary(written[f"{BUCKET}={b}"]).getLength()
        gone = [(b, g) for b, g in self.state["in"].items() if state["in"].get(b) != g]
        self._publish(state)
        used = set(state["in"].values())
        for b, g in gone:
            if g in used:
                files.delete(file_system(self.spark, f"{self.path}/{g}/{BUCKET}={b}")[1], True)
        for g in old - used:
            files.delete(file_system(self.spark, f"{self.path}/{g}")[1], True)

    def _publish(self, state: dict) -> None:
        files, place = file_system(self.spark, f"{self.path}/{_MANIFEST}")
        fresh = place.suffix(".new")
        stream = files.create(fresh, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        files.delete(place, False)
        files.rename(fresh, place)
        self.state = state

    def _grow(self) -> bool:
        """Add buckets until they have the target size on average, all that are wanted in one rewriting."""
        now = self.state["buckets"]
        wanted = -(-sum(self.state["bytes"].values()) // self.target)
        if wanted <= now:
            return False
        fresh = range(now, wanted)
        sources = sorted({split_from(b, now) for b in fresh})
        self._store(self.read(sources), sorted({*sources, *fresh}), wanted)
        return True
