"""Ranked lexical search: an inverted index in shards, searched by term at a time and document at a time together.

The index has a row for each shard of about ``shard_bytes`` of text: its documents in the order of their ids, its terms,
and each term's postings (document, occurrences). It covers every document and every term and is written once.

A search takes the queries in blocks of about ``block_bytes``. One pass over the index counts the documents of each query
term; a second scores. In a shard the short lists of a query are summed first, term at a time, into accumulators; the
accumulators then stand beside the long lists as one more list, with bounds of its own. These lists are read document at a
time in windows of documents: a window whose bounds together cannot reach the best k so far is skipped; inside a window
the lists come in the order of their bounds, and as soon as few documents can still win, the rest of the lists are looked
up at those alone. The best k of a query go on from shard to shard of a task. All scores are exact; only documents that
cannot be among the best are left out.

What is sent to tasks: one block of queries and a number for each of its terms. What a task returns: k documents a query.

Defined results: null and blank texts have no terms and are no result; a query without terms has none; repeated rows are
documents of their own; rows without an id come after equal scores with one; repeated query rows are queries of their
own; an empty index has no results; other columns are not read. A very long text is a shard of its own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, integer_id, settings, shared_table, ship_by_value

ship_by_value(__name__)

INDEX = "n_docs long, n_terms long, doc_ids array<long>, lengths array<long>, terms array<binary>, ends array<long>, docs array<int>, counts array<int>"
#: Documents in a window; the share of a shard's documents up to which a list is short.
WINDOW, SHORT = 256, 1 / 32
_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_IN_TERM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_LOWER >= 97) & (_LOWER <= 122)) | (_BYTES >= 128)
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def _runs(data: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts that stand one after the other in ``data``, and the text of each."""
    word = _IN_TERM[data]
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    begins = ends[:-1][ends[:-1] < len(data)]
    opens[begins] |= word[begins]
    at = np.flatnonzero(opens)
    offsets = np.zeros(len(at) + 1, np.int32)
    offsets[:-1] = (np.cumsum(word, dtype=np.int32) - word)[at]
    kept = _LOWER[data[word]]
    offsets[-1] = len(kept)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]), np.searchsorted(ends, at, "right") - 1


def _shard(ids: list[pa.Array], texts: list[pa.Array]) -> pa.RecordBatch:
    doc_ids = pa.concat_arrays(ids)
    column = pc.fill_null(pa.concat_arrays(texts), b"")
    order = pc.sort_indices(doc_ids)  # nulls last
    doc_ids, column = doc_ids.take(order), column.take(order)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    runs, of = _runs(data, ends - ends[0])
    n = len(column)
    lengths = np.bincount(of, minlength=n)
    coded = runs.dictionary_encode()
    pairs, counts = np.unique(coded.indices.to_numpy().astype(np.int64) * n + of, return_counts=True)
    in_term = np.bincount(pairs // n, minlength=len(coded.dictionary)) if n else np.zeros(0, np.int64)
    lists = [doc_ids, pa.array(lengths, pa.int64()), coded.dictionary, pa.array(np.cumsum(in_term), pa.int64()), pa.array(pairs % n, pa.int32()), pa.array(counts, pa.int32())]
    one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
    return pa.RecordBatch.from_arrays([pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), *one], names=["n_docs", "n_terms", "doc_ids", "lengths", "terms", "ends", "docs", "counts"])


def _index(shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                seen = sizes[at - 1] if at else 0
                end = min(int(np.searchsorted(sizes, seen + max(shard_bytes - size, 1))) + 1, batch.num_rows)
                ids.append(batch.column(0).slice(at, end - at))
                texts.append(batch.column(1).slice(at, end - at).cast(pa.large_binary()))
                size += int(sizes[end - 1] - seen)
                at = end
                if size >= shard_bytes:
                    yield _shard(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield _shard(ids, texts)

    return run


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 8 << 20) -> DataFrame:
    """The index of every document, as a table."""
    integer_id(docs, id_col)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"))
    with arrow_batches(docs.sparkSession, 512):
        return shared_table(rows.mapInArrow(_index(shard_bytes), INDEX), "lexical_index")


def _terms(text: bytes | None) -> list[bytes]:
    lower = bytes(text or b"").translate(_LOWER.tobytes())
    return list(dict.fromkeys(_TERM.findall(lower)))


def _holders(vocabulary):
    """For each term of the queries: in how many documents of a shard it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = pc.index_in(vocabulary.value, value_set=batch.column(0)[i].values)
                found = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                sizes = np.diff(batch.column(1)[i].values.to_numpy(), prepend=0)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(sizes[at.take(pa.array(found)).to_numpy()], pa.int64())], names=["term", "n"])

    return run


class Best:
    """The k best of one query so far: scores, ids (those without an id last), and what a document must reach."""

    __slots__ = ("k", "scores", "ids", "need")

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.need = k, np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        first = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[first], ids[first]
        if len(first) == self.k:
            self.need = int(self.scores[-1])


class Shard:
    """The lists of the terms that some query asks for, with their scores and the bound of each window."""

    def __init__(self, row: dict[str, pa.Array], vocabulary: pa.Array, weights: np.ndarray, n_docs: int, n_terms: int):
        ids = row["doc_ids"]
        self.ids = pc.fill_null(ids, np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        self.n = len(ids)
        lengths = row["lengths"].to_numpy()
        if 90 * int(lengths.max(initial=0)) * n_docs < 2**63:
            self.norm = 10 + 90 * lengths * n_docs // n_terms
        else:
            self.norm = np.array([10 + 90 * int(x) * n_docs // n_terms for x in lengths], np.int64)
        at = pc.index_in(vocabulary, value_set=row["terms"])
        self.place = {int(t): int(p) for t, p in zip(np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False)), at.drop_null().to_numpy(), strict=True)}
        self.ends, self.docs, self.counts, self.weights = row["ends"].to_numpy(), row["docs"].to_numpy(), row["counts"].to_numpy(), weights
        self.edges = np.arange(0, self.n + WINDOW, WINDOW)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents, scores, where each window begins, the largest score of each window."""
        if term not in self.lists:
            p = self.place[term]
            a, b = int(self.ends[p - 1]) if p else 0, int(self.ends[p])
            docs, tf = self.docs[a:b], self.counts[a:b].astype(np.int64)
            scores = self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * self.norm[docs]))
            cuts = np.searchsorted(docs, self.edges)
            most = np.zeros(len(self.edges) - 1, np.int64)
            full = np.flatnonzero(np.diff(cuts))
            most[full] = np.maximum.reduceat(scores, cuts[:-1][full])
            self.lists[term] = docs, scores, cuts, most
        return self.lists[term]

    def search(self, terms: list[int], best: Best) -> None:
        lists = [self.postings(t) for t in terms if t in self.place]
        if not lists:
            return
        short = [x for x in lists if len(x[0]) <= SHORT * self.n]
        long_ = [x for x in lists if len(x[0]) > SHORT * self.n]
        summed = np.zeros(len(self.edges[:-1]) * WINDOW, np.int64)
        for docs, scores, _, _ in short:  # term at a time
            summed[docs] += scores
        tops = summed.reshape(-1, WINDOW).max(axis=1)
        bounds = np.array([x[3] for x in long_], np.int64).reshape(len(long_), len(tops))
        reach = tops + bounds.sum(axis=0)
        for w in np.flatnonzero(reach >= best.need).tolist():  # document at a time, by windows
            if reach[w] < best.need:
                continue
            low = w * WINDOW
            score, rest = summed[low : low + WINDOW].copy(), int(reach[w] - tops[w])
            alive = None  # all
            for i in np.argsort(-bounds[:, w], kind="stable").tolist():
                docs, gains, cuts, _ = long_[i]
                if not bounds[i, w]:
                    break
                if alive is None:
                    left = np.flatnonzero(score + rest >= best.need)
                    alive = left if len(left) <= WINDOW // 8 else None
                else:
                    alive = alive[score[alive] + rest >= best.need]
                if alive is not None and not len(alive):
                    break
                part = docs[cuts[w] : cuts[w + 1]]
                if alive is None:
                    score[part - low] += gains[cuts[w] : cuts[w + 1]]
                else:  # skip to those that can still win
                    to = np.minimum(np.searchsorted(part, alive + low), len(part) - 1)
                    hit = part[to] == alive + low
                    score[alive[hit]] += gains[cuts[w] + to[hit]]
                rest -= int(bounds[i, w])
            won = np.flatnonzero(score >= best.need) if alive is None else alive[score[alive] >= best.need]
            if len(won):
                best.add(score[won], self.ids[won + low])


def _score(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights, queries, n_docs, n_terms = block.value
        best = [Best(k) for _ in queries]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].values for name in ("doc_ids", "lengths", "terms", "ends", "docs", "counts")}
                shard = Shard(row, vocabulary, weights, n_docs, n_terms)
                for terms, top in zip(queries, best, strict=True):
                    shard.search(terms, top)
        number = np.repeat(np.arange(len(best)), [len(b.ids) for b in best])
        ids = np.concatenate([b.ids for b in best]) if best else np.zeros(0, np.int64)
        scores = np.concatenate([b.scores for b in best]) if best else np.zeros(0, np.int64)
        doc_id = pa.array(ids, pa.int64(), mask=ids == np.iinfo(np.int64).max)
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), doc_id, pa.array(scores, pa.int64())], names=["number", "doc_id", "score"])

    return run


def _weight(n_docs: int, holders: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders + 1)))


def _ranked(spark: SparkSession, index: DataFrame, rows: list, n_docs: int, n_terms: int, k: int, id_type: T.DataType) -> DataFrame:
    """The best of one block of queries."""
    asked = [_terms(r["t"]) for r in rows]
    vocabulary = sorted({t for q in asked for t in q})
    number = {t: i for i, t in enumerate(vocabulary)}
    words = pa.array(vocabulary, pa.binary())
    holders = index.select("terms", "ends").mapInArrow(_holders(spark.sparkContext.broadcast(words)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    weights = np.zeros(len(vocabulary), np.int64)
    for r in holders.collect():  # a number for each term of the block
        weights[r["term"]] = _weight(n_docs, r["n"])
    block = spark.sparkContext.broadcast((words, weights, [[number[t] for t in q] for q in asked], n_docs, n_terms))
    found = index.select("doc_ids", "lengths", "terms", "ends", "docs", "counts").mapInArrow(_score(block, k), "number int, doc_id long, score long")
    by = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.select("*", F.row_number().over(by).alias("rank")).where(F.col("rank") <= k)
    items = spark.createDataFrame([(i, r["i"]) for i, r in enumerate(rows)], T.StructType([T.StructField("number", T.IntegerType()), T.StructField("item_id", id_type)]))
    return shared_table(top.join(F.broadcast(items), "number").select("item_id", "rank", "doc_id", "score"), "ranked")  # items: one block


def search(index: DataFrame, queries: DataFrame, item_id_col: str = "item_id", item_text_col: str = "text", k: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every query, of equal scores the smaller id first."""
    spark = index.sparkSession
    id_type = queries.schema[item_id_col].dataType
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    items = queries.where(F.col(item_text_col).isNotNull()).select(F.col(item_id_col).alias("i"), F.col(item_text_col).cast("binary").alias("t"))
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    out = spark.createDataFrame([], T.StructType([T.StructField("item_id", id_type), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    if not n_terms:
        return out
    blocks = -(-total // block_bytes)
    # a shard is one row of some megabytes: few at a time, in the reader and on the way to Python
    with arrow_batches(spark, 1), settings(spark, {"spark.sql.parquet.columnarReaderBatchSize": "2"}):
        for b in range(blocks):
            rows = items.where(_in_block(F.col("t"), blocks) == b).collect()  # about block_bytes
            out = out.unionByName(_ranked(spark, index, rows, n_docs, n_terms, k, id_type)) if rows else out
    return out


def _in_block(text: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(blocks))
