"""Best-fit packing of documents into sequences, improved by swaps.

A document's tokens end with ``end_id``. Only documents longer than a sequence are cut; their first piece takes what is
left over, the others fill a sequence each. So a document has one piece at most that must be packed.

Pieces are packed in groups of about ``group`` by best fit, the longest first. Then local search: the emptiest sequence
that has a gap gives a piece, or two, for one, two or none of a fuller one, so that the fuller one fills its gap as well as can
be. Every step makes the sum of the squared fills larger, so the search ends; a sequence that has given all away is gone.
Full sequences are settled. Those with gaps go on to the next round, in new groups, as long as the last round emptied one in
1,000 of those it got. Groups are drawn by the number of a stored row, so no document, length or source is hot, and
a group is never larger than chance makes it. What travels is a number and a length for each piece; ids stay where they are.

Defined results: null text is empty, and an empty text is one token, ``end_id``; repeated rows are packed as often as they
stand; a row without an id has a piece like any other; an empty table has no sequences; other columns are not read. Long
texts are encoded whole. The string of a special token in a text is that token, as the vocabulary says.
"""

from __future__ import annotations

import os
import re
from bisect import insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, shared_table, ship_by_value

ship_by_value(__name__)

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
LENGTH, END_ID, GROUP = 1024, 2, 16384
#: Words that an encoder keeps in mind; beyond that it forgets all and starts again.
KEPT_WORDS = 1 << 20
_BYTES = np.arange(256)
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
_ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))
_MARK = np.isin(_BYTES, list(b'.,;:!?)("%$#*&'))  # none that a special token's string may hold inside
#: First bytes of characters of which none is white space.
_LEAD = ((_BYTES >= 0xC3) & (_BYTES <= 0xDF)) | ((_BYTES >= 0xE4) & (_BYTES <= 0xF4))
#: What a byte may be to the one before or after it. White space before a special token's string is a text's end to the
#: tokenizer, so what such a string begins with is no ink. A two-byte character that begins with a letter lead is a letter, but for two.
ALNUM, ENDS_WORD, INK, WHITE, SOLID, BREAK, BLANK, LETTER_LEAD = (np.uint8(1 << i) for i in range(8))
_KIND = np.zeros(256, np.uint8)
for _flag, _bytes in ((ALNUM, _ALNUM), (ENDS_WORD, _MARK | _SPACE), (INK, ((_BYTES < 128) & ~_SPACE & ~np.isin(_BYTES, list(b"<["))) | _LEAD), (WHITE, np.isin(_BYTES, [9, 10, 11, 12, 13, 32])), (SOLID, (_BYTES < 128) & ~_SPACE), (BREAK, np.isin(_BYTES, [9, 10, 11, 12, 13])), (BLANK, _BYTES == 32), (LETTER_LEAD, np.isin(_BYTES, [0xC3, 0xD0, 0xD1]))):
    _KIND[_bytes] |= _flag
#: Words that go to the tokenizer as one text, each behind a line feed.
JOINED = 64
#: Words that may: no white space but a space in front. A line feed before them is a pre-token, and no other yields its id.
_JOINABLE = re.compile(rb"\x20?[^\x00-\x20\x7f\xc2\xe1-\xe3]+")


class Encoder:
    """Ids of many texts. A vocabulary of byte pairs never merges across the pre-tokens it splits a text into, so a text is
    cut where a pre-token surely begins, and each distinct piece is encoded once."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.between = feed[0] if len(feed) == 1 else None
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.bounds = np.zeros(0, "<u4"), np.zeros(1, np.int64)  # of all words in a row, and where each begins

    def _plain(self, texts: list[bytes], batch: int = 1024) -> Iterator[np.ndarray]:
        for start in range(0, len(texts), batch):
            for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts[start : start + batch]], add_special_tokens=False):
                yield np.array(e.ids, "<u4")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text ends in them; ``texts`` is large binary without nulls."""
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            kind = _KIND[data]
            leads = np.flatnonzero(kind[:-1] & LETTER_LEAD)
            kind[leads[(data[leads] != 0xC3) | ((data[leads + 1] != 0x97) & (data[leads + 1] != 0xB7))] + 1] |= ALNUM
            here, after = kind[:-1], kind[1:].copy()
            after[ends[(ends > 0) & (ends < len(data))] - 1] = 0  # the next text is nothing to the end of this one
            ink = (after & INK) != 0
            cut[:-2] = ((here & (BLANK | BREAK)) != 0) & ink  # the last of a run; a space takes what comes after it along, a break does not
            cut[1:-1] |= ((here & ALNUM) != 0) & ((after & ENDS_WORD) != 0)
            cut[1:-1] |= ((here & SOLID) != 0) & ((after & WHITE) != 0)
            cut[1:-1] |= ((here & BREAK) != 0) & ink
        cut[ends] = True
        at = np.flatnonzero(cut)
        words = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.number) > KEPT_WORDS:
            self.forget()
        new = [w for w in names if w not in self.number]
        if new:
            together, alone = [], []
            for w in new:
                (together if self.between is not None and _JOINABLE.fullmatch(w) else alone).append(w)
            new = together + alone
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            known, lengths = [self.ids], [np.zeros(0, np.int64)]
            for ids in self._plain([b"\n" + b"\n".join(together[k : k + JOINED]) for k in range(0, len(together), JOINED)]):
                feeds = np.append(np.flatnonzero(ids == self.between), len(ids))
                known.append(ids[ids != self.between])
                lengths.append(np.diff(feeds) - 1)
            for ids in self._plain(alone):
                known.append(ids)
                lengths.append(np.array([len(ids)], np.int64))
            self.ids = np.concatenate(known)
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.concatenate(lengths))])
        codes = np.fromiter(map(self.number.__getitem__, names), np.int64, len(names))[words.indices.to_numpy()]
        n = np.diff(self.bounds)[codes]
        total = np.concatenate([[0], np.cumsum(n)])
        from_ = np.repeat(self.bounds[codes] - total[:-1], n) + np.arange(total[-1])
        return self.ids[from_], total[np.searchsorted(at, ends[1:])]


def _cutter(vocabulary, length: int, end_id: int, batch_bytes: int = 4 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given the cores out
        encoder, made = Encoder(vocabulary.value), TaskContext.get().partitionId() << 33
        for whole in batches:
            texts = whole.column(1).cast(pa.large_binary()).fill_null(b"")
            sizes = np.cumsum(np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]))
            at = 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + batch_bytes, "right")))
                part = texts.slice(at, end - at)
                ids, ends = encoder.encode(part)
                doc, piece, start, n, packed = [], [], [], [], []
                begin = 0
                for d, e in enumerate(ends.tolist()):
                    own = np.append(ids[begin:e], np.uint32(end_id)).astype("<u4")
                    begin = e
                    first = (len(own) - 1) % length + 1
                    cuts = [0, *range(first, len(own) + 1, length)]
                    for k in range(len(cuts) - 1):
                        doc.append(d)
                        piece.append(k)
                        start.append(cuts[k])
                        n.append(cuts[k + 1] - cuts[k])
                        packed.append(own[cuts[k] : cuts[k + 1]].tobytes())
                keys = pa.array(range(made, made + len(doc)), pa.int64())
                made += len(doc)
                yield pa.RecordBatch.from_arrays([keys, whole.column(0).slice(at, end - at).take(pa.array(doc, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], names=["key", "doc_id", "piece", "start", "length", "ids"])
                at = end

    return run


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """A table of pieces: key (its number), doc_id, piece, start, length, ids (unsigned, little-endian, 32 bits each)."""
    with open(vocabulary, encoding="utf-8") as f:  # some megabytes; tasks get it from the driver
        said = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    with arrow_batches(docs.sparkSession, 1024):
        return shared_table(rows.mapInArrow(_cutter(said, length, end_id), schema), "pieces")


def best_fit(lumps: list[list[int]], size: list[int], capacity: int) -> list[list[int]]:
    """Lumps of pieces, fullest first, each into the fullest sequence that has room for it."""
    weigh = sorted(((sum(size[i] for i in lump), n) for n, lump in enumerate(lumps)), key=lambda x: (-x[0], x[1]))
    out: list[list[int]] = []
    room: dict[int, list[int]] = defaultdict(list)
    free = 0  # bit r: some sequence has room for r more
    for weight, n in weigh:
        fits = free >> weight
        if fits:
            r = weight + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free &= ~(1 << r)
            out[b] += lumps[n]
            r -= weight
        else:
            b, r = len(out), capacity - weight
            out.append(list(lumps[n]))
        if r:
            room[r].append(b)
            free |= 1 << r
    return out


class Gaps:
    """Sequences with a gap, by the gap's size and by what they could give in exchange for filling it: nothing, one piece or two."""

    def __init__(self, size: list[int], capacity: int):
        self.size, self.capacity = size, capacity
        self.held: dict[tuple[int, int], dict[int, tuple[int, ...]]] = defaultdict(dict)  # (gap, given) -> sequence -> pieces
        self.given: dict[int, int] = defaultdict(int)  # gap -> bits of what is given
        self.gaps: list[int] = []  # in use, smallest first

    def offers(self, pieces: list[int]) -> dict[int, tuple[int, ...]]:
        one: dict[int, list[int]] = {}
        for i in pieces:
            one.setdefault(self.size[i], []).append(i)
        out: dict[int, tuple[int, ...]] = {0: ()}
        sizes = sorted(one)
        for k, a in enumerate(sizes):
            for b in sizes[k:]:
                if a != b or len(one[a]) > 1:
                    out.setdefault(a + b, (one[a][0], one[b][-1]))
        return out | {a: (own[0],) for a, own in one.items()}

    def put(self, b: int, pieces: list[int], gap: int) -> None:
        if gap not in self.given:
            insort(self.gaps, gap)
        for weight, which in self.offers(pieces).items():
            self.held[gap, weight][b] = which
            self.given[gap] |= 1 << weight

    def take(self, b: int, pieces: list[int], gap: int) -> None:
        for weight in self.offers(pieces):
            where = self.held[gap, weight]
            del where[b]
            if not where:
                del self.held[gap, weight]
                self.given[gap] &= ~(1 << weight)
        if not self.given[gap]:
            del self.given[gap]
            self.gaps.remove(gap)

    def best(self, weight: int, fill: int) -> tuple[int, int, int] | None:
        """(what stays of the gap, gap, weight given) of the best exchange for ``weight`` with a sequence at least ``fill`` full."""
        found = None
        for gap in self.gaps:
            if self.capacity - gap < fill:
                break
            low = max(weight - gap, 0)
            fits = (self.given[gap] >> low) & ((1 << (weight - low)) - 1)
            if fits:
                stays = (fits & -fits).bit_length() - 1 + low - (weight - gap)
                if found is None or stays < found[0]:
                    found = (stays, gap, weight - gap + stays)
                    if not stays:
                        break
        return found


def improve(bins: list[list[int]], size: list[int], capacity: int) -> list[list[int]]:
    """Swaps between sequences with gaps, until no exchange makes the sum of squared fills larger."""
    bins = [list(b) for b in bins]
    fill = [sum(size[i] for i in b) for b in bins]
    gaps = Gaps(size, capacity)
    for b, pieces in enumerate(bins):
        if fill[b] < capacity:
            gaps.put(b, pieces, capacity - fill[b])
    changed = True
    while changed:
        changed = False
        for donor in sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: (fill[b], b)):
            if fill[donor] == capacity:
                continue  # has been filled meanwhile
            gaps.take(donor, bins[donor], capacity - fill[donor])
            while bins[donor]:
                found = None
                for weight, given in sorted(gaps.offers(bins[donor]).items(), key=lambda x: (len(x[1]), -x[0])):
                    if given and (at := gaps.best(weight, fill[donor])) and (found is None or at[0] < found[0][0]):
                        found = at, weight, given
                        if not at[0]:
                            break
                if not found:
                    break
                changed = True
                (stays, gap, back), weight, given = found
                other, taken = next(iter(gaps.held[gap, back].items()))
                gaps.take(other, bins[other], gap)
                bins[donor] = [i for i in bins[donor] if i not in given] + list(taken)
                bins[other] = [i for i in bins[other] if i not in taken] + list(given)
                fill[donor] += back - weight
                fill[other] = capacity - stays
                if stays:
                    gaps.put(other, bins[other], stays)
            if bins[donor]:
                gaps.put(donor, bins[donor], capacity - fill[donor])
    return [b for b in bins if b]


def _pack_group(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        keys, size, old = (table.column(c).to_pylist() for c in ("key", "length", "bin"))
        lumps: dict[int, list[int]] = defaultdict(list)
        for i, b in enumerate(old):
            lumps[b].append(i)
        bins = improve(best_fit(list(lumps.values()), size, capacity), size, capacity)
        order = [i for b in bins for i in b]
        named = [min(keys[i] for i in b) for b in bins]
        starts = [s for b in bins for s in np.cumsum([0, *(size[i] for i in b[:-1])]).tolist()]
        full = [sum(size[i] for i in b) == capacity for b in bins]
        each = [len(b) for b in bins]
        columns = [pa.array([keys[i] for i in order], pa.int64()), pa.array([size[i] for i in order], pa.int64()), pa.array(np.repeat(np.array(named, np.int64), each)), pa.array(starts, pa.int64()), pa.array(np.repeat(np.array(full, bool), each))]
        return pa.Table.from_arrays(columns, names=["key", "length", "bin", "offset", "full"])

    return run


def pack(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """key, sequence_id, offset for every row of a table of pieces (key, length)."""
    open_ = pieces.where(F.col("length") < length).select("key", "length", F.col("key").alias("bin"))
    done = pieces.where(F.col("length") >= length).select("key", F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    n_pieces = n_bins = open_.count()
    number = 0
    while n_pieces:
        groups = -(-n_pieces // group)
        drawn = open_.withColumn("group", F.pmod(F.xxhash64("bin", F.lit(number)), F.lit(groups)))
        packed = shared_table(drawn.groupBy("group").applyInArrow(_pack_group(length), "key long, length long, bin long, offset long, full boolean"), f"round-{number}")
        after, left, bins_left = packed.agg(F.count_if(F.col("offset") == 0), F.count_if(~F.col("full")), F.count_if((F.col("offset") == 0) & ~F.col("full"))).first()
        result = lambda rows: rows.select("key", F.col("bin").alias("sequence_id"), "offset")
        if groups == 1 or 1000 * (n_bins - after) < n_bins:
            return done.unionByName(result(packed))
        done = done.unionByName(result(packed.where("full")))
        open_, n_pieces, n_bins, number = packed.where("not full").select("key", "length", "bin"), left, bins_left, number + 1
    return done
