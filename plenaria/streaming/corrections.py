"""Counts by day and topic under corrections: a stateful stream that takes back what a newer version of a speech replaces.

Each row is a version of a speech: sitting_id, speech_order, day, topic, changed_at and
version (which decides between versions of one time). State by sitting holds each speech's newest
version. A newer one gives -1 for the old day and topic and +1 for the new ones; an older
one, however late it comes, gives nothing; a null topic takes a speech away. So the sum of all
that came out equals a count over the newest versions, in whatever order they came.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from plenaria.sources import sinks

VERSIONS = "sitting_id string, speech_order long, day string, topic string, changed_at timestamp, version long"
DELTAS = "day string, topic string, n long"
SPEECHES = "speech_order array<long>, day array<string>, topic array<string>, at array<long>, version array<long>"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Newest(StatefulProcessor):
    """The newest version of each speech of a sitting. With `keep_ms`, a timer forgets a sitting so long after its last change in event time."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        # One value a sitting: each call to the state is a message to the JVM, so a sitting is read and written in one each.
        self.speeches = handle.getValueState("sitting", SPEECHES)
        self.until = handle.getValueState("until", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest: dict[int, tuple] = {}
        for frame in rows:
            at = frame["changed_at"].astype("datetime64[us]").astype("int64")
            for order, day, topic, when, version in zip(frame["speech_order"], frame["day"], frame["topic"], at, frame["version"]):
                mine = (int(when), int(version))
                if int(order) not in newest or mine > newest[int(order)][:2]:
                    newest[int(order)] = (*mine, day, topic)
        out: list[tuple] = []
        held = self.speeches.get() if newest else None
        known = {} if held is None else {row[0]: row for row in zip(*held)}
        changed = False
        for order, (when, version, day, topic) in newest.items():
            old = known.get(order)
            if old is not None and (old[3], old[4]) >= (when, version):
                continue
            known[order], changed = (order, day, topic, when, version), True
            if old is not None and old[2] is not None:
                out.append((old[1], old[2], -1))
            if topic is not None:
                out.append((day, topic, 1))
        if changed:
            self.speeches.update(tuple(list(c) for c in zip(*known.values())))
        if self.keep_ms is not None and newest:
            until = max(v[0] for v in newest.values()) // 1000 + self.keep_ms
            before = self.until.get()[0] if self.until.exists() else None
            if before is None or until > before:
                if before is not None:
                    self.handle.deleteTimer(before)
                self.handle.registerTimer(until)
                self.until.update((until,))
        summed: dict[tuple, int] = {}
        for day, topic, n in out:
            summed[day, topic] = summed.get((day, topic), 0) + n
        kept = [(*k, n) for k, n in summed.items() if n]
        if kept:
            yield pd.DataFrame(kept, columns=["day", "topic", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.speeches.clear()
        self.until.clear()
        yield from ()

    def close(self) -> None:
        pass


def deltas(stream: DataFrame, keep: str | None = None) -> DataFrame:
    """(day, topic, n) to add for each batch of versions.

    `keep` (as "400 days") bounds the state: sittings unchanged for so long in event time are
    forgotten, and versions that come later than that are left out; None keeps all.
    """
    if keep is None:
        return stream.groupBy("sitting_id").transformWithStateInPandas(Newest(None), DELTAS, "Update", "None")
    ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    timed = stream.withWatermark("changed_at", keep)
    return timed.groupBy("sitting_id").transformWithStateInPandas(Newest(ms), DELTAS, "Update", "EventTime")


def run_corrections(spark: SparkSession, stream: DataFrame, path: str, keep: str | None = None) -> DataFrame:
    """Take what a stream has now into the table `path`/deltas, each batch once, and give the counts."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        put = lambda batch, number: sinks.append(batch.groupBy("day", "topic").agg(F.sum("n").alias("n")), f"{path}/deltas", once=("corrections", number))
        deltas(stream, keep).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return counts(spark, path)


def counts(spark: SparkSession, path: str) -> DataFrame:
    """(day, topic, n) of all corrections so far."""
    if not sinks.exists(spark, f"{path}/deltas"):
        return spark.createDataFrame([], DELTAS)
    return sinks.read(spark, f"{path}/deltas").groupBy("day", "topic").agg(F.sum("n").alias("n")).where("n <> 0")
