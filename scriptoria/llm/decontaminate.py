"""Benchmark decontamination with one FM-index per training shard.

A test item's windows are its runs of 13 words; an item of fewer words, but not none, is one window. The words of the
test items are the alphabet; every other word is one more symbol, and a run of such words is kept as one, since no
window reaches across it. Each task cuts its rows into shards of about ``shard_words`` words, indexes a shard's
distinct texts (suffix array, wavelet matrix), searches all windows backwards at once, locates their occurrences by
sampled suffix positions and merges them into removal spans. Nothing is shuffled; a lost task is run again from its
input.

Test items come in blocks of about ``block_bytes`` of text. One pass over the rows takes ``pass_blocks`` of them: they are
one broadcast over one alphabet, a shard is indexed once for all of them, and their windows are spelled out a block at a
time. Where more blocks are left, what a pass found is written as a table that the next pass reads, so a task never has
more than one worker and a worker never holds more than one pass's items.

Defined results: null texts have no words and no spans; a test item without words has no window; occurrences of an
item without an id count for the spans but are not listed; ids of any type are listed as strings, in string order; repeated rows each get their own result; without test
items nothing is contaminated; an empty table gives an empty result; other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_name, shared_table, ship_by_value
from .fm_index import FMIndex

ship_by_value(__name__)

WINDOW = 13
#: Bytes of UTF-8: A-Z become a-z, what is no digit, letter or non-ASCII byte becomes a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Block:
    """The distinct windows of a block of test items, as symbols: places in the items' own words, with the items they belong to."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int, symbol: dict[bytes, int]):
        """``symbol`` numbers words from 2 on and grows; 0 ends a document, 1 is any word that no item has."""
        self.window, self.ids = window, sorted({i for i, _ in items if i is not None})
        number = {i: n for n, i in enumerate(self.ids)}
        words, first, owners = [], {}, []
        for item_id, text in items:
            at = len(words)
            words += [symbol.setdefault(w, len(symbol) + 2) for w in words_of(text)]
            for i in range(at, max(at + 1, len(words) - window + 1) if len(words) > at else at):
                w = first.setdefault(tuple(words[i : min(i + window, len(words))]), (len(first), i))[0]
                if item_id is not None:
                    owners.append((w, number[item_id]))
        self.words = np.array(words, np.int32)
        self.starts = np.array([i for _, i in first.values()], np.int64)
        self.lengths = np.array([len(phrase) for phrase in first], np.int32)
        pairs = np.unique(np.array(owners, np.int64).reshape(-1, 2), axis=0)
        self.owners = pairs[:, 1].astype(np.int32)
        self.offsets = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))

    def reversed(self) -> np.ndarray:
        """A row per window, its last word first; the rows of short items end in zeros."""
        at = self.lengths[:, None] - 1 - np.arange(self.window)
        return np.where(at >= 0, self.words[np.maximum(self.starts[:, None] + at, 0)], 0)

    def items_of(self, windows: np.ndarray) -> set[str]:
        return {self.ids[o] for w in windows.tolist() for o in self.owners[self.offsets[w] : self.offsets[w + 1]].tolist()}


class Windows:
    """Blocks of test items over one alphabet, searched one after the other in one index of a shard."""

    def __init__(self, blocks: Iterable[list[tuple[str | None, bytes]]], window: int):
        self.symbol: dict[bytes, int] = {}
        self.blocks = [Block(items, window, self.symbol) for items in blocks]

    def in_shard(self, texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
        """For each text: number of words, merged spans of words, ids of items with an occurrence."""
        n_words, symbols = [], []
        for text in texts:
            words = words_of(text)
            n_words.append(len(words))
            symbols.append(np.fromiter(chain(map(self.symbol.get, words, repeat(1)), (0,)), np.int32, len(words) + 1))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        if not self.symbol or not texts:
            return n_words, spans, [[] for _ in texts]
        whole = np.concatenate(symbols)
        del symbols
        first = np.concatenate(([0], np.flatnonzero(whole == 0)[:-1] + 1))
        keep = np.ones(len(whole), bool)
        keep[1:] = (whole[1:] != 1) | (whole[:-1] != 1)
        origin = np.flatnonzero(keep)
        index = FMIndex(whole[keep], len(self.symbol) + 2)
        edges = np.zeros(len(whole) + 1, np.int32)
        for block in self.blocks:
            low, high = index.search(block.reversed(), block.lengths)
            counts = high - low
            which = np.repeat(np.arange(len(counts)), counts)
            if not len(which):
                continue
            rows = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + low[which]
            begin = origin[index.locate(rows)]
            np.add.at(edges, begin, 1)
            np.add.at(edges, begin + block.lengths[which], -1)
            pairs = np.unique(np.stack((np.searchsorted(first, begin, "right") - 1, which)), axis=1)
            docs, at = np.unique(pairs[0], return_index=True)
            for d, found in zip(docs.tolist(), np.split(pairs[1], at[1:]), strict=True):
                items[d] |= block.items_of(found)
        hit = np.concatenate(([False], np.cumsum(edges[:-1]) > 0, [False]))
        turns = np.flatnonzero(hit[1:] != hit[:-1])
        for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            d = int(np.searchsorted(first, a, "right")) - 1
            spans[d].append((a - int(first[d]), b - int(first[d])))
        return n_words, spans, [sorted(x) for x in items]


def _merged(a: list[dict], b: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for start, end in sorted([(x["start"], x["end"]) for x in a] + b):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


def _pass(windows, text_col: str, keep: list[str], names: tuple[str, str, str], shard_words: int, later: bool):
    """A mapInArrow function that adds the three columns, or, if ``later``, merges into those that are there."""
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def annotate(batches: list[pa.RecordBatch], shard: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        n_words, spans, items = windows.value.in_shard(list(shard))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()
            of = [shard[t or b""] for t in texts]
            if later:
                old = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names[1:]}
                span_rows = [_merged(o, spans[k]) for o, k in zip(old[names[1]], of, strict=True)]
                item_rows = [sorted({*o, *items[k]}) for o, k in zip(old[names[2]], of, strict=True)]
            else:
                span_rows = [[{"start": a, "end": b} for a, b in spans[k]] for k in of]
                item_rows = [items[k] for k in of]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            columns += [pa.array([n_words[k] for k in of], pa.int64()), pa.array(span_rows, span_type), pa.array(item_rows, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard, size = [], {}, 0
        for whole in batches:
            texts = whole.column(whole.schema.get_field_index(text_col)).cast(pa.binary())
            at = 0
            for i, text in enumerate(texts.to_pylist()):
                text = text or b""
                if text not in shard:
                    shard[text] = len(shard)
                    size += len(text)
                if size >= 6 * shard_words:  # about six bytes a word
                    held.append(whole.slice(at, i + 1 - at))
                    yield from annotate(held, shard)
                    held, shard, size, at = [], {}, 0, i + 1
            if at < whole.num_rows:
                held.append(whole.slice(at))
        if held:
            yield from annotate(held, shard)

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None, window: int = WINDOW, shard_words: int = 1 << 20, block_bytes: int = 8 << 20, pass_blocks: int = 8) -> tuple[DataFrame, tuple[str, str, str]]:
    """The columns ``keep`` of docs (default: all) with three more, and their names: n_words, spans, items."""
    keep = list(docs.columns) if keep is None else list(keep)
    names = tuple(fresh_name([*docs.columns, *keep], n) for n in ("n_words", "spans", "items"))
    items = benchmark.where(F.col(item_text_col).isNotNull()).select(F.col(item_id_col).cast("string").alias("i"), F.col(item_text_col).cast("binary").alias("t"))
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    out, carried = docs, [*dict.fromkeys([*keep, text_col])]
    types = {f.name: f.dataType for f in docs.schema.fields}
    block = lambda b: [(r["i"], bytes(r["t"])) for r in items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b).collect()]  # noqa: E731  about block_bytes
    for start in range(0, blocks, pass_blocks):
        last = start + pass_blocks >= blocks
        kept = keep if last else carried
        schema = T.StructType([T.StructField(c, types[c]) for c in kept] + [T.StructField(names[0], T.LongType()), T.StructField(names[1], SPANS), T.StructField(names[2], T.ArrayType(T.StringType()))])
        needed = [*carried, *(names[1:] if start else ())]
        windows = docs.sparkSession.sparkContext.broadcast(Windows(map(block, range(start, min(start + pass_blocks, blocks))), window))
        out = out.select(*needed).mapInArrow(_pass(windows, text_col, kept, names, shard_words, start > 0), schema)
        if not last:
            out = shared_table(out, "searched")
    return out, names


def contaminated(n_words: Column, spans: Column, share: int = 20) -> Column:
    """Hit words are at least one in ``share``."""
    n_hit = hit_words(spans)
    return (n_hit > 0) & (n_hit * share >= n_words)


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    found, (n_words, spans, _) = find_contamination(docs, benchmark, text_col)
    return found.where(~contaminated(F.col(n_words), F.col(spans))).select(*docs.columns)
