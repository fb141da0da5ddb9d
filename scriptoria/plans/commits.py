"""Tables of versions: a log of commits, each put only if its number is still free.

A commit is a small file, ``_log/<number>.json``, that names the folders of Parquet files which together are the table. A
writer first writes its rows to a folder of its own and then puts the next number; if another writer was quicker, it
builds its rows again on what is there now and tries the next one. So no writer overwrites another, a reader sees whole
versions only, and an appended row costs one folder, not the table. After ``compact_at`` folders an append writes them as
one. Older versions stay until :meth:`CommittedTable.vacuum`.

The file is put by a hard link on a local file system and by a rename that fails if the name is taken elsewhere, as HDFS
has it; a store without such a rename needs another :meth:`CommittedTable._put`.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CommittedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, compact_at: int = 32):
        self.spark, self.path, self.schema, self.compact_at = spark, path.rstrip("/"), schema, compact_at
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        log = self._path(f"{self.path}/_log")
        if not self._files.exists(log):
            return []
        names = (s.getPath().getName() for s in self._files.listStatus(log))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[0] != ".")

    def version(self) -> int:
        """The newest version; 0 if there is none."""
        return max(self.versions(), default=0)

    def _parts(self, version: int) -> list[str]:
        if version == 0:
            return []
        if version not in self.versions():
            raise ValueError(f"{self.path} has no version {version}")
        stream = self._files.open(self._path(f"{self.path}/_log/{version:020d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["parts"]
        finally:
            stream.close()

    def as_of(self, version: int) -> DataFrame:
        """The rows of a version; version 0 is empty."""
        parts = self._parts(version)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in parts]) if parts else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self.as_of(self.version())

    def _put(self, version: int, text: str) -> bool:
        """Put a commit; False if its number is taken."""
        name, temp = self._path(f"{self.path}/_log/{version:020d}.json"), self._path(f"{self.path}/_log/.{uuid.uuid4().hex}")
        out = self._files.create(temp, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self._files.getScheme() == "file":
                os.link(temp.toUri().getPath(), name.toUri().getPath())
                return True
            kinds = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            kinds[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
            self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(temp, name, kinds)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            self._files.delete(temp, False)

    def _written(self, rows: DataFrame) -> str:
        part = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{part}")
        return part

    def _commit(self, build: Callable[[int], list[str]]) -> int:
        """Put the parts that ``build`` makes of the newest version, as often as it takes; the version that they became."""
        while True:
            seen = self.version()
            parts = build(seen)
            if self._put(seen + 1, json.dumps({"parts": parts})):
                return seen + 1

    def update(self, build: Callable[[DataFrame], DataFrame]) -> int:
        """Replace the table by what ``build`` makes of it. It is asked again if another writer came between."""
        return self._commit(lambda seen: [self._written(build(self.as_of(seen)))])

    def append(self, rows: DataFrame) -> int:
        """Add rows; they are written once, whatever other writers do."""
        fresh = self._written(rows)

        def build(seen: int) -> list[str]:
            parts = [*self._parts(seen), fresh]
            if len(parts) < self.compact_at:
                return parts
            whole = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in parts])
            return [self._written(whole.coalesce(max(1, len(parts) // self.compact_at)))]

        return self._commit(build)

    def merge(self, upserts: DataFrame, gone: DataFrame, key: str, buckets: int = 64) -> int:
        """Put ``upserts`` in place of the rows of their keys and take the keys of ``gone`` (one column) away.

        The table lies in buckets by the key's hash, a folder each. Only buckets with a changed key are read and written;
        the others' files stay as they are. The number of buckets is the table's, from its first merge on.
        """
        of = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")
        keys = upserts.select(F.col(key).alias("_changed")).unionByName(gone.select(F.col(gone.columns[0]).alias("_changed"))).distinct()
        touched = sorted(r[0] for r in keys.select(of("_changed")).distinct().collect())  # numbers of buckets

        def build(seen: int) -> list[str]:
            old = {int(p.rpartition("_bucket=")[2]): p for p in self._parts(seen)}
            if max(old, default=0) >= buckets:
                raise ValueError(f"the table has more than {buckets} buckets")
            open_ = [f"{self.path}/{old[b]}" for b in touched if b in old]
            rows = upserts
            if open_:
                rows = self.spark.read.schema(self.schema).parquet(*open_).join(keys, F.col(key) == F.col("_changed"), "left_anti").unionByName(upserts)
            part = f"data-{uuid.uuid4().hex}"
            rows.withColumn("_bucket", of(key)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{part}")
            new = {}
            for s in self._files.listStatus(self._path(f"{self.path}/{part}")):
                name = s.getPath().getName()
                if name.startswith("_bucket="):
                    new[int(name[8:])] = f"{part}/{name}"
            return [p for _, p in sorted(({b: p for b, p in old.items() if b not in touched} | new).items())]

        return self._commit(build) if touched else self.version()

    def changes(self, first: int, last: int, key: str) -> DataFrame:
        """The rows of version ``last`` that ``first`` lacks (added, changed) and those of ``first`` whose key is gone (removed), with a column ``change``.

        Rows that are equal in all columns are no change; ``key`` names one row. What both versions read from the same folder is not read.
        """
        old_parts, new_parts = self._parts(first), self._parts(last)
        read = lambda parts: self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in parts]) if parts else self.spark.createDataFrame([], self.schema)
        old, new = read([p for p in old_parts if p not in new_parts]), read([p for p in new_parts if p not in old_parts])
        fields = F.struct(*[F.col(c) for c in new.columns])
        pairs = old.select(F.col(key).alias("k"), fields.alias("old")).join(new.select(F.col(key).alias("k"), fields.alias("new")), "k", "full")
        change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
        return pairs.select(F.coalesce("new", "old").alias("row"), change.alias("change")).where("change is not null").select("row.*", "change")

    def vacuum(self, keep: int = 10) -> int:
        """Delete all but the last ``keep`` versions and the folders that only they need; how many folders went. Not while writers are at work."""
        versions = self.versions()
        stay = {p.partition("/")[0] for v in versions[-keep:] for p in self._parts(v)}
        gone = {s.getPath().getName() for s in self._files.listStatus(self._path(self.path)) if s.getPath().getName().startswith("data-")} - stay if versions else set()
        for v in versions[:-keep]:
            self._files.delete(self._path(f"{self.path}/_log/{v:020d}.json"), False)
        for p in gone:
            self._files.delete(self._path(f"{self.path}/{p}"), True)
        return len(gone)
