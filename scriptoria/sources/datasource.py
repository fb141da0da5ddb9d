"""The extractors as a data source: ``spark.read.format("corpus_files")`` and ``spark.readStream.format("corpus_files")``.

``spark.dataSource.register(CorpusFiles)`` makes it known. Files below ``path`` are listed on the driver, dealt into partitions
of about ``partitionBytes`` and read and extracted in the tasks, one file at a time. The rows are those of
:func:`scriptoria.sources.extract.extracted` before its quality and preview columns, which :func:`extract.graded` adds. Filters on
type, corpus, length and relative path are taken over by the listing under the option ``pushFilters`` (which needs
``spark.sql.python.filterPushdown.enabled``), so files that they drop are not opened.

As a stream, the offset is the newest (time, path) that was listed; a batch is what is later than the one before. A file
that is written with an earlier time than what was read is not seen: put files in place by a rename. Python reads the
files, so the path must be a local or mounted one that driver and executors share; other stores go through
:func:`extract.listing`. Empty files give no row, as with Spark's own file source. Options: path, strategy, supportedOnly,
partitionBytes, maxBytes, pushFilters.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from itertools import groupby

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from . import extract

FILE = "path string, relative_path string, corpus string, modificationTime timestamp, length long, document_type string, checksum string, strategy string"


@dataclass(frozen=True)
class Found:
    path: str
    relative_path: str
    corpus: str
    time_ns: int
    length: int
    document_type: str


@dataclass
class Share(InputPartition):
    files: tuple[Found, ...]


def local(path: str) -> str:
    scheme = re.match(r"([a-z][a-z0-9+.-]*):", path)
    if scheme and scheme[1] != "file":
        raise ValueError(f"{path}: only local or mounted paths; read other stores with extract.listing")
    return re.sub(r"^file:/*", "/", path)


def written_folders(root: str, key: str) -> Callable[[Iterator[Row]], None]:
    """Writes rows (key, text) that come in the order of their keys: a folder for each key with one file, a line a text.

    Hadoop's local file system may start a process for each folder and file that it makes, so tasks write them themselves.
    A file is put in place by a rename, so a task that runs again replaces what it wrote.
    """

    def write(rows: Iterator[Row]) -> None:
        for value, texts in groupby(rows, lambda r: r[0]):
            folder = os.path.join(root, f"{key}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}")
            os.makedirs(folder, exist_ok=True)
            unfinished = os.path.join(folder, f".{uuid.uuid4().hex}")
            with open(unfinished, "wb") as file:
                for row in texts:
                    file.write(row[1].encode() + b"\n")
            os.replace(unfinished, os.path.join(folder, "part.txt"))

    return write


def found_below(root: str, supported_only: bool) -> Iterator[Found]:
    """Files that are not ignored, as the listing names them."""
    root = root.rstrip("/")
    for folder, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if not extract.ignored_name(d)]
        for name in names:
            kind = extract.TYPES.get(name.rpartition(".")[2].lower()) if "." in name else None
            if extract.ignored_name(name) or (supported_only and kind is None):
                continue
            at = os.path.join(folder, name)
            stat = os.stat(at)
            relative = os.path.relpath(at, root)
            if stat.st_size:
                yield Found(f"file:{at}", relative, relative.split("/")[0] if "/" in relative else "", stat.st_mtime_ns, stat.st_size, kind or "")


class _Files:
    """What both readers share."""

    def __init__(self, options: dict):
        given = {k.lower(): v for k, v in options.items()}
        self.root, self.strategy = local(given["path"]), given.get("strategy", "default")
        self.supported_only = given.get("supportedonly", "true").lower() == "true"
        self.partition_bytes, self.most_bytes = int(given.get("partitionbytes", 64 << 20)), int(given.get("maxbytes", extract.MOST_BYTES))

    def shares(self, files: Iterable[Found]) -> list[Share]:
        out, held, size = [], [], 0
        for f in sorted(files, key=lambda f: f.path):
            held.append(f)
            size += f.length
            if size >= self.partition_bytes:
                out.append(Share(tuple(held)))
                held, size = [], 0
        return [*out, Share(tuple(held))] if held else out

    def rows(self, share: Share) -> Iterator[tuple]:
        for f in share.files:
            content = None
            if f.length <= self.most_bytes:
                with open(local(f.path), "rb") as file:
                    content = file.read()
            e = extract.extract(content, f.document_type, self.strategy)
            checksum = hashlib.sha256(content).hexdigest() if content is not None else None
            changed = datetime.fromtimestamp(f.time_ns // 10**6 / 1000, timezone.utc)
            yield (f.path, f.relative_path, f.corpus, changed, f.length, f.document_type, checksum, self.strategy, e.title, e.text, e.pages or ([e.text] if e.text else []), e.method, e.status, e.chain or [e.method], e.warnings, e.failure)


_COLUMNS = {"document_type": lambda f: f.document_type, "corpus": lambda f: f.corpus, "length": lambda f: f.length, "relative_path": lambda f: f.relative_path}
_RULES = {
    EqualTo: lambda own, value: own == value, In: lambda own, value: own in value, StringStartsWith: lambda own, value: own.startswith(value), GreaterThan: lambda own, value: own > value,
    GreaterThanOrEqual: lambda own, value: own >= value, LessThan: lambda own, value: own < value, LessThanOrEqual: lambda own, value: own <= value,
}


class BatchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.filters = _Files(options), []

    def wanted(self, file: Found) -> bool:
        rules = {kind.__name__: rule for kind, rule in _RULES.items()}
        return all(rules[kind](_COLUMNS[column](file), value) for kind, column, value in self.filters)

    def partitions(self) -> Sequence[InputPartition]:
        return self.files.shares(f for f in found_below(self.files.root, self.files.supported_only) if self.wanted(f))

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.files.rows(partition)


class PushingReader(BatchReader):
    """With filters taken over; Spark refuses this method where its setting is off, so it is an option."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _RULES and len(f.attribute) == 1 and f.attribute[0] in _COLUMNS:
                self.filters.append((type(f).__name__, f.attribute[0], f.value))
            else:
                yield f


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.files = _Files(options)

    def initialOffset(self) -> dict:
        return {"time_ns": -1, "path": ""}

    def latestOffset(self) -> dict:
        newest = max(((f.time_ns, f.path) for f in found_below(self.files.root, self.files.supported_only)), default=(-1, ""))
        return {"time_ns": newest[0], "path": newest[1]}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        after, to = (start["time_ns"], start["path"]), (end["time_ns"], end["path"])
        return self.files.shares(f for f in found_below(self.files.root, self.files.supported_only) if after < (f.time_ns, f.path) <= to)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.files.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class CorpusFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus_files"

    def schema(self) -> str:
        return f"{FILE}, {extract.SCHEMA}"

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        pushing = {k.lower(): v for k, v in options.items()}.get("pushfilters", "false").lower() == "true"
        return PushingReader(options) if pushing else BatchReader(options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return StreamReader(dict(self.options))
