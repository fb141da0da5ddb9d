"""What the operators of this subpackage share: shared tables, shipping of Arrow kernels, spans by regex."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import settings, shared_dir, shared_table

__all__ = ["settings", "shared_dir", "shared_table"]

#: White space as the operators read it: space, and tab to carriage return.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD_BY_SPACE = r"[^\x20\x09-\x0D]+"
#: What separates the words of letters, digits and non-ASCII characters, in lower-case text.
NOT_WORD_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ship_by_value(module_name: str) -> None:
    """Let a module's functions travel inside the task, so that executors need no installed copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


#: Bits of the Bloom filter over ids: 8 MB, whatever the input; with very many ids it passes more rows, never fewer.
BLOOM_BITS, BLOOM_HASHES = 1 << 26, 2


def bloom_buckets(id_col: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(id_col, F.lit(i)), F.lit(BLOOM_BITS)).alias(f"bucket{i}") for i in range(BLOOM_HASHES)]


def bloom_filter(ids: DataFrame) -> np.ndarray:
    """The filter of a table of ids, as 64-bit words; the driver gets at most all of its words."""
    buckets = ids.select(F.explode(F.array(*bloom_buckets(F.col(ids.columns[0])))).alias("b"))
    words = buckets.select(F.shiftright("b", 6).alias("w"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(BLOOM_BITS // 64, np.int64)
    out[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def bloom_passes(bits: np.ndarray, batch: pa.RecordBatch, at: int) -> pa.Array:
    """Which rows pass; their buckets are the columns from ``at`` on."""
    keep = np.ones(batch.num_rows, bool)
    for i in range(BLOOM_HASHES):
        b = batch.column(at + i).to_numpy(zero_copy_only=False).astype(np.uint64)
        keep &= ((bits[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1)).astype(bool)
    return pa.array(keep)


def integer_id(docs: DataFrame, id_col: str) -> None:
    """An id column of another type than whole numbers is an error at once, not in a task."""
    if not isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ValueError(f"{id_col} must hold whole numbers")


EMPTY_SPANS = "cast(array() as array<struct<start:int,end:int,piece:string>>)"


def regex_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start,end,piece>>, in code points, end exclusive.

    ``split`` yields the gaps between the same matches that ``regexp_extract_all`` yields, so offsets are
    running sums of both lengths. ``pattern`` must not match the empty string. An array that grows by one is a copy
    of it, so the sums run over blocks of about the square root of the number of matches, each from its own start: a
    million matches cost a thousand times a thousand short copies.
    """
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"), m.alias("piece")))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.struct(begin.alias("start"), (begin + x["len"]).alias("end"), x["piece"].alias("piece"))
        moved = F.struct((begin + x["len"]).alias("at"), F.array_append(acc["spans"], span).alias("spans"))
        return F.when(x["len"].isNull(), acc).otherwise(moved)

    def in_blocks(p: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(p))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(p), size), lambda i: F.slice(p, i, size))

    def from_starts(blocks: Column) -> Column:
        whole = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + F.coalesce(x["len"], F.lit(0))))
        starts = F.aggregate(whole, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
        begin = lambda at: F.struct(at.alias("at"), F.expr(EMPTY_SPANS).alias("spans"))
        return F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), lambda b, at: F.aggregate(b, begin(at), step, lambda acc: acc["spans"])))

    once = lambda value, build: F.element_at(F.transform(F.array(value), build), 1)  # noqa: E731  a value that is used more than once
    spans = once(once(parts, in_blocks), from_starts)
    return F.when(text.rlike(pattern), spans).otherwise(F.expr(EMPTY_SPANS))


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows in the jobs that run inside: rows that carry whole texts are large."""
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)}):
        yield


def fresh_name(columns: list[str], wish: str) -> str:
    """A column name that clashes with none of ``columns`` (compared as Spark does, without case)."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


class BatchStore:
    """Batches of rows in a folder that driver and executors share; one writer at a time.

    A batch counts once the writer's success marker is there. A batch that is committed already is left alone, so it may
    be sent any number of times, also after a failure halfway.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def committed(self, batch: str) -> bool:
        if not batch or "/" in batch or batch[0] in "._":
            raise ValueError(f"no batch id: {batch!r}")
        return self._files.exists(self._path(f"{self.path}/{batch}/_SUCCESS"))

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Write a batch; False if it was committed before."""
        if self.committed(batch):
            return False
        rows.write.mode("overwrite").parquet(f"{self.path}/{batch}")
        return True

    def batches(self) -> list[str]:
        if not self._files.exists(self._path(self.path)):
            return []
        names = sorted(s.getPath().getName() for s in self._files.listStatus(self._path(self.path)))
        return [b for b in names if b[0] not in "._" and self.committed(b)]

    def drop(self, batch: str) -> None:
        self._files.delete(self._path(f"{self.path}/{batch}"), True)

    def rows(self, batches: list[str] | None = None) -> DataFrame:
        """The rows of these batches, by default of all committed ones."""
        done = self.batches() if batches is None else batches
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{b}" for b in done]) if done else self.spark.createDataFrame([], self.schema)


ship_by_value(__name__)
