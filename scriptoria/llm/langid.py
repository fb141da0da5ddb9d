"""Language ID by rank-order profiles.

A profile is a ranked list of the most frequent n-grams of one to three characters, letters in lower case and every
run of other characters one boundary. A language's profile counts all its training text; a document's profile counts
the whole document. The out-of-place distance sums, over the document's n-grams, how far each one's rank lies from
its rank in the language (``size`` if it is missing there), divided by the largest such sum. The language with the
smallest distance is predicted; ties go to the name that sorts first; the score is 1 minus that distance.

Counts are added up in the tasks, then by Spark; the driver gets ``size`` n-grams for each language of one block.

Defined results: null text, or text without a letter, gives ``und`` and score 0, and so does every text if nothing
can be learned; rows with a null language teach nothing; repeated rows count as often as they stand; of equally near
languages the name that sorts first is found; an empty table gives an empty result; other columns are untouched. More
than ``block_langs`` languages are compared in blocks of about that many, each one more pass over the rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, shared_table, ship_by_value

ship_by_value(__name__)

SIZE, ORDER, UNKNOWN = 400, 3, "und"
NO_LETTERS = re.compile(r"[\W\d_]+")


def ngrams(text: str | None) -> np.ndarray:
    """The packed n-grams of a text, 21 bits a character; none if it has no letter."""
    clean = NO_LETTERS.sub(" ", (text or "").lower())
    if not clean.replace(" ", "").isalpha():  # number signs such as fractions are words to ``re``, but no letters
        clean = " ".join("".join(c if c.isalpha() else " " for c in clean).split())
    clean = clean.strip()
    if not clean:
        return np.empty(0, np.int64)
    c = np.frombuffer(f" {clean} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    pairs = (c[:-1] << 21) | c[1:]
    return np.concatenate((c[c != 32], pairs, (pairs[:-1] << 21) | c[2:]))


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first, ties by code (codes come sorted)."""
    if len(codes) > 4 * size:  # what is below the size-th count can't be among them
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.argsort(-counts, kind="stable")[:size]]


def _counter(text_at: int, lang_at: int, chunk: int = 1 << 21):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str) -> None:
            codes, counts = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
            sizes[lang] = 0
            if lang in sums:
                all_codes, at = np.unique(np.concatenate((sums[lang][0], codes)), return_inverse=True)
                codes, counts = all_codes, np.bincount(at, np.concatenate((sums[lang][1], counts))).astype(np.int64)
            sums[lang] = codes, counts

        for batch in batches:
            for text, lang in zip(batch.column(text_at).to_pylist(), batch.column(lang_at).to_pylist(), strict=True):
                found = ngrams(text)
                waiting.setdefault(lang, []).append(found)
                sizes[lang] = sizes.get(lang, 0) + len(found)
                if sizes[lang] > chunk:
                    add(lang)
        for lang in list(waiting):
            add(lang)
        for lang, (codes, counts) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts, pa.int64())], names=["lang", "code", "n"])

    return run


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = SIZE) -> DataFrame:
    """(lang, code, rank): each language's most frequent n-grams, the most frequent has rank 1."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = rows.mapInArrow(_counter(0, 1), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    return shared_table(counts.withColumn("rank", rank).where(F.col("rank") <= size).drop("n"), "profiles")


class Profiles:
    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.size = size
        self.langs = sorted(profiles)
        self.codes, self.ranks = [], []
        for lang in self.langs:
            codes = np.array(profiles[lang], np.int64)
            order = np.argsort(codes)
            self.codes.append(codes[order])
            self.ranks.append(order)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = ngrams(text)
        if not len(found) or not self.langs:
            return UNKNOWN, 0.0
        top = ranked(*np.unique(found, return_counts=True), self.size)
        own = np.arange(len(top))
        worst, best, score = len(top) * self.size, UNKNOWN, -1.0
        for lang, codes, ranks in zip(self.langs, self.codes, self.ranks, strict=True):
            at = np.minimum(np.searchsorted(codes, top), len(codes) - 1)
            off = np.where(codes[at] == top, np.abs(ranks[at] - own), self.size)
            s = 1 - int(off.sum()) / worst
            if s > score:
                best, score = lang, s
        return best, score


def nearer(a: tuple[str, float], b: tuple[str, float]) -> tuple[str, float]:
    """Of two blocks' answers the one with the higher score; of equal ones a language before none, then by name."""
    return min(a, b, key=lambda x: (-x[1], x[0] == UNKNOWN, x[0]))


def _predictor(profiles: Profiles, text_col: str, keep: list[str], names: tuple[str, str], later: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            found = [profiles.predict(t) for t in batch.column(at(text_col)).to_pylist()]
            if later:
                before = zip(*(batch.column(at(n)).to_pylist() for n in names), strict=True)
                found = [nearer(a, b) for a, b in zip(before, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(at(c)) for c in keep], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*keep, *names])

    return run


def identify(docs: DataFrame, profiles: DataFrame, text_col: str = "text", keep: list[str] | None = None, size: int = SIZE, block_langs: int = 1000) -> tuple[DataFrame, tuple[str, str]]:
    """The columns ``keep`` of docs (default: all) with two more, and their names: lang_pred, score."""
    keep = list(docs.columns) if keep is None else list(keep)
    names = tuple(fresh_name([*docs.columns, *keep], n) for n in ("lang_pred", "score"))
    fields = {f.name: f for f in docs.schema.fields}
    carried = list(dict.fromkeys([*keep, text_col]))
    blocks = -(-profiles.select("lang").distinct().count() // block_langs) or 1
    out = docs
    for b in range(blocks):
        found: dict[str, list[int]] = {}
        for r in profiles.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == b).orderBy("lang", "rank").collect():  # about block_langs times size rows
            found.setdefault(r["lang"], []).append(r["code"])
        kept = keep if b == blocks - 1 else carried
        schema = ", ".join([f"`{c}` {fields[c].dataType.simpleString()}" for c in kept] + [f"`{names[0]}` string", f"`{names[1]}` double"])
        out = out.select(*carried, *(names if b else ())).mapInArrow(_predictor(Profiles(found, size), text_col, kept, names, b > 0), schema)
    return out, names


def held_out(id_col: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")), F.lit(0)) % folds == fold


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_score: float = 0.0) -> DataFrame:
    """The rows whose language is found with a score above ``least_score``, with their columns; learned from ``docs`` itself."""
    profiles = learn(docs.where(~held_out(F.col(id_col))), text_col, lang_col)
    found, (lang, score) = identify(docs, profiles, text_col)
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) > least_score)).select(*docs.columns)
