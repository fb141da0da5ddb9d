"""Incremental scans with keyed state: the store holds what is known of each path, and a batch reads its own keys alone.

A row is a sight of a document: source_path, checksum, modified. The newest sight by ``modified`` counts, in whatever
order they come; a late one that is older than what is known says nothing. The processor gives a row for each change:
``added`` at the first sight, ``changed`` where the text is another one, ``removed`` where a path was not seen for
``retire_after`` of the stream's event time (a timer for each key; without it nothing is removed). A path that comes
again after its removal is added again.

The state needs the RocksDB provider (:data:`PROVIDER`): it lies on disk and its changes go to the checkpoint, so it may be
larger than memory, and a lost executor loses nothing.

Defined results: rows without a path or a time are left out; a null checksum is a text of its own; of equal times the
greater checksum counts; repeated rows change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
CHANGE = "source_path string, checksum string, modified timestamp, change string"


class Known(StatefulProcessor):
    def __init__(self, retire_ms: int | None):
        self.retire_ms = retire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "checksum string, modified long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = now = self.known.get()  # None at the first sight
        for at, checksum in sorted((row["at"], row["checksum"]) for row in rows):
            if now is not None and (at, checksum) <= (now[1], now[0]):
                continue
            if now is None or checksum != now[0]:
                yield _row(key[0], checksum, at, "added" if now is None else "changed")
            now = (checksum, at)
        if now is not None and now is not before:
            self.known.update(now)
        if now is not None and self.retire_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now[1] // 1000 + self.retire_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.known.get()
        if known is not None:
            self.known.clear()
            yield _row(key[0], known[0], known[1], "removed")

    def close(self) -> None:
        pass


def _row(path: str, checksum: str, at: int, change: str) -> Row:
    return Row(source_path=path, checksum=checksum, at=at, change=change)


def changes_stream(sights: DataFrame, retire_after: timedelta | None = None, late: str = "1 hour") -> DataFrame:
    """The changes (:data:`CHANGE`) of a stream of sights (source_path, checksum, modified); set :data:`PROVIDER` before."""
    rows = sights.where("source_path is not null and modified is not null").withColumn("checksum", F.coalesce("checksum", F.lit("")))
    rows = rows.withWatermark("modified", late).select("source_path", "checksum", "modified", F.unix_micros("modified").alias("at"))
    retire_ms = None if retire_after is None else int(retire_after.total_seconds() * 1000)
    found = rows.groupBy("source_path").transformWithState(Known(retire_ms), "source_path string, checksum string, at long, change string", outputMode="Append", timeMode="EventTime" if retire_after else "None")
    return found.select("source_path", "checksum", F.timestamp_micros("at").alias("modified"), "change")


def once(sights: DataFrame, late: str = "1 hour") -> DataFrame:
    """The sights of a stream without those that came before within ``late``: path, checksum and time are the same."""
    return sights.withWatermark("modified", late).dropDuplicatesWithinWatermark(["source_path", "checksum", "modified"])


def current(changes: DataFrame) -> DataFrame:
    """What is known after all changes of a table of them: source_path, checksum, modified."""
    last = changes.groupBy("source_path").agg(F.max(F.struct("modified", F.when(F.col("change") == "removed", 1).otherwise(0).alias("gone"), "checksum")).alias("l"))
    return last.where("l.gone = 0").select("source_path", F.col("l.checksum").alias("checksum"), F.col("l.modified").alias("modified"))
