"""Incremental refresh of a result table from files that keep arriving."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from repostrata.operators.stars import valid_events
from repostrata.operators.upsert import upsert_table


def upsert_stream(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    order: Sequence[str],
    bucket_by: Sequence[str] = ("repo",),
    buckets: int = 4,
) -> StreamingQuery:
    """Upsert every micro-batch of a streaming DataFrame into the table at ``path``.

    ``order`` decides which row of a key is last, at equal rank the later batch. The table
    lists the batches of this stream, named by its checkpoint, that it holds: one that is
    replayed, even after a later one, leaves it as it is. The query stops once all available
    files are read.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        upsert_table(batch, path, keys, order, bucket_by, buckets, batch=(checkpoint, batch_id))

    return (
        rows.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class Growth(StatefulProcessor):
    """The star count of a repository and its stars per date, carried from batch to batch.

    Stars after the last date seen go on from the count. An earlier date changes the count at
    itself and at every later date, and those come out again.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getMapState("days", "date timestamp", "n bigint")
        self.last = handle.getValueState("last", "date timestamp, total bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        added: dict = {}
        for part in rows:
            for date, n in zip(part["date"], part["n"]):
                added[date] = added.get(date, 0) + int(n)
        if not added:
            return
        seen = self.last.get() if self.last.exists() else None
        counts = dict(sorted(added.items()))
        last, total = (pd.Timestamp(seen[0]), int(seen[1])) if seen else (None, 0)
        if last is not None and min(counts) <= last:
            known = {pd.Timestamp(date[0]): int(n[0]) for date, n in self.days.iterator()}
            first = min(counts)
            total = sum(n for date, n in known.items() if date < first)
            later = {date: n for date, n in known.items() if date >= first}
            counts = dict(sorted({d: later.get(d, 0) + counts.get(d, 0) for d in {*later, *counts}}.items()))
        out = []
        for date, n in counts.items():
            total += n
            out.append((key[0], date, total))
            if date in added:
                self.days.updateValue((date.to_pydatetime(),), (n,))
        self.last.update((max(counts).to_pydatetime(), total))
        yield pd.DataFrame(out, columns=["repo", "date", "stargazers_count"])

    def close(self) -> None:
        pass


def _per_date(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stars per repository and date within a task, so few rows of a hot repository are sent."""
    for part in parts:
        if len(part):
            counted = part.groupby(["repo", "starred_at"]).size().reset_index()
            counted.columns = ["repo", "date", "n"]
            yield counted


def growth_stream(events: DataFrame, path: str, checkpoint: str, buckets: int = 4) -> StreamingQuery:
    """Keep the star growth ``(repo, date, stargazers_count)`` at ``path`` up to date.

    ``events`` is a stream of star events in any order of time. After every micro-batch the
    table equals ``growth_long`` of all events so far; only dates whose count changed are
    written. State is kept per repository in the checkpoint, in a store on disk, and holds one
    number per date. The query stops once all available files are read.
    """
    spark = events.sparkSession
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    counted = valid_events(events).select("repo", "starred_at").mapInPandas(_per_date, "repo string, date timestamp, n bigint")
    changed = counted.groupBy("repo").transformWithStateInPandas(
        statefulProcessor=Growth(), outputStructType="repo string, date timestamp, stargazers_count bigint",
        outputMode="Update", timeMode="None",
    )

    def apply(batch: DataFrame, batch_id: int) -> None:
        upsert_table(batch, path, ["repo", "date"], buckets=buckets, batch=(checkpoint, batch_id))

    return (
        changed.writeStream.foreachBatch(apply)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# Functions travel to the executors by value: they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
