"""Incremental scans as a stream of files: each micro-batch looks up the state and keeps what is new or changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


MARKS = "source_path string, checksum string, batch long"


class ScanState:
    """source_path, checksum by micro-batch: a folder for each batch id, so a batch that is run again replaces itself.

    Every ``compact_every`` batches the state is written as one snapshot; reading takes the newest snapshot and the
    batches after it, so the cost of a batch does not grow with how many there were.
    """

    def __init__(self, spark: SparkSession, path: str, compact_every: int = 20):
        self.spark, self.path, self.compact_every = spark, path.rstrip("/"), compact_every
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _done(self, kind: str) -> list[int]:
        """The ids of the batches or snapshots that were written to their end."""
        if not self._files.exists(self._path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(self.path))]
        return sorted(int(n[len(kind) + 1 :]) for n in names if n.startswith(f"{kind}-") and self._files.exists(self._path(f"{self.path}/{n}/_SUCCESS")))

    def before(self, batch_id: int) -> DataFrame:
        snapshot = max((i for i in self._done("snapshot") if i < batch_id), default=None)
        parts = [f"{self.path}/batch-{i:010d}" for i in self._done("batch") if i < batch_id and (snapshot is None or i > snapshot)]
        if snapshot is not None:
            parts.append(f"{self.path}/snapshot-{snapshot:010d}")
        if not parts:
            return self.spark.createDataFrame([], MARKS)
        rows = self.spark.read.schema(MARKS).parquet(*parts)
        return rows.groupBy("source_path").agg(F.max_by("checksum", "batch").alias("checksum"), F.max("batch").alias("batch"))

    def add(self, batch: DataFrame, batch_id: int) -> None:
        old = self.before(batch_id).select("source_path", "checksum")
        latest = batch.groupBy("source_path").agg(F.max("checksum").alias("checksum"))
        fresh = latest.join(old, ["source_path", "checksum"], "left_anti")
        fresh.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.path}/batch-{batch_id:010d}")
        if batch_id % self.compact_every == self.compact_every - 1:
            self.before(batch_id + 1).write.mode("overwrite").parquet(f"{self.path}/snapshot-{batch_id:010d}")

    def current(self) -> DataFrame:
        return self.before(1 << 62)


def scan_stream(spark: SparkSession, path: str, schema: StructType, state: ScanState, checkpoint: str, source_path, text_col: str = "text", files_per_batch: int = 4) -> StreamingQuery:
    """Read the Parquet files under ``path`` as they come, ``files_per_batch`` at a time, and end when all are read.

    ``source_path`` is the column that names a document.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    marks = rows.select(source_path.alias("source_path"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("checksum"))
    return marks.writeStream.foreachBatch(lambda df, i: state.add(df, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums of events by window and type; works on a table and on a stream alike."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "n_values")
