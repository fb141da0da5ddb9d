"""Token counts in delta-maintained rollups.

A change is a signed row: an insert adds a document and its tokens, a delete takes them away, a revision does both.
A batch's changes are added up by source, language and tokenizer version, and the sums are added to the totals: each
commit writes the next version of the totals together with the ids of the batches in it, so reading the totals costs
one small table, however many batches there were. A version counts once its success marker is there; a batch whose id
is in the newest version is left alone, so a batch may be sent any number of times, also after a failure halfway. One
writer at a time.

Tokens are counted with public BPE vocabularies whose files are named by parameters; nothing is trained. Each text is
encoded once; a revision encodes the revised texts alone, chosen by a Bloom filter over their ids in the same pass.

Defined results: null text has 0 tokens; null source or language is a key of its own; repeated rows count as often as
they stand; keys whose totals are all 0 again are left out; an empty store has no totals; ids must be whole numbers.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BatchStore, bloom_buckets, bloom_filter, bloom_passes, integer_id, shared_dir, shared_table, ship_by_value

ship_by_value(__name__)

#: Tokenizer version -> file of base64 tokens and ranks.
VOCABULARIES = {"byte-bpe-50k": "/opt/tokenizers/byte_bpe_50k.tiktoken", "byte-bpe-multi-50k": "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"}
#: Fixed value: how these vocabularies split a text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACES = re.compile(r"[\x20\x09-\x0D]+")
KEYS = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def _encoder(ranks_file: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
    return tiktoken.Encoding("counted", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def _counter(files: Mapping[str, object], words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = {name: _encoder(file.value) for name, file in files.items()}
        for batch in batches:
            texts = [t or "" for t in batch.column(3).to_pylist()]
            revised = bloom_passes(words.value, batch, 4).to_pylist() if words else [False] * len(texts)
            plain = [SPACES.sub(" ", t) if r else t for t, r in zip(texts, revised, strict=True)]
            for name, encoder in encoders.items():
                counts = [len(encoder.encode_ordinary(t)) for t in texts]
                squeezed = [None if not r else n if p == t else len(encoder.encode_ordinary(p)) for t, p, n, r in zip(texts, plain, counts, revised, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([name] * len(texts), pa.string()), pa.array(counts, pa.int64()), pa.array(squeezed, pa.int64())], names=["doc_id", *KEYS, "n_tokens", "n_squeezed"])

    return run


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", vocabularies: Mapping[str, str] = VOCABULARIES, revised: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens, n_squeezed) for each row and tokenizer version.

    n_squeezed counts the text with each run of white space as one space; it is there for the documents whose id is in
    ``revised`` (one column), and null for nearly all others.
    """
    integer_id(docs, id_col)
    sc = docs.sparkSession.sparkContext
    files = {}
    for name, path in vocabularies.items():
        with open(path, "rb") as f:  # a vocabulary is under a megabyte; tasks get it from the driver
            files[name] = sc.broadcast(f.read())
    words = sc.broadcast(bloom_filter(revised.select(F.col(revised.columns[0]).cast("long")))) if revised is not None else None
    key = F.col(id_col).cast("long")
    rows = docs.select(key.alias("doc_id"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), *bloom_buckets(key))
    return rows.mapInArrow(_counter(files, words), "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_squeezed long")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that put the counts ``new`` in place of ``old``."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Additive totals in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.versions = BatchStore(spark, path, f"{DELTA}, batch string")

    def _newest(self) -> DataFrame:
        """The newest version: rows of totals (batch is null), and one row for each batch in them."""
        return self.versions.rows(self.versions.batches()[-1:])

    def batches(self) -> list[str]:
        return sorted(r["batch"] for r in self._newest().where("batch is not null").select("batch").collect())  # ids of batches, no rows of theirs

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes to the totals; False if it is in them."""
        self.versions.committed(batch)  # the id is fit for a name
        done = self.versions.batches()
        old = self._newest()
        if not old.where(F.col("batch") == batch).isEmpty():
            return False
        delta = changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums = old.where("batch is null").drop("batch").unionByName(delta).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")
        names = old.where("batch is not null").unionByName(self.spark.createDataFrame([(None, None, None, None, None, batch)], f"{DELTA}, batch string"))
        version = int(done[-1][1:]) + 1 if done else 1
        self.versions.commit(f"v{version:012d}", sums.withColumn("batch", F.lit(None).cast("string")).unionByName(names).coalesce(1))  # one row a key or batch
        for stale in done[:-1]:  # a reader of the newest version may still be at it
            self.versions.drop(stale)
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens."""
        return self._newest().where("batch is null").drop("batch")


def corpus_rollup(docs: DataFrame, labels: DataFrame, path: str | None = None, vocabularies: Mapping[str, str] = VOCABULARIES, load_batches: int = 4) -> Rollup:
    """A rollup of documents: loaded in batches, then low-quality texts revised (runs of white space collapsed), then toxic ones deleted.

    A document may have several labels that repeat or contradict each other: one toxic label is enough, then no revision;
    without one, one of low quality is enough. Labels without a document change nothing; null labels say nothing.
    """
    import uuid

    spark = docs.sparkSession
    rollup = Rollup(spark, path or f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    said = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"), F.min("quality").alias("quality"))  # of several labels the worst counts
    poor, toxic = said.where("quality = 0 and not toxic").select("doc_id"), said.where("toxic").select("doc_id")
    counts = shared_table(count_tokens(docs, vocabularies=vocabularies, revised=poor), "counts")
    for b in range(load_batches):
        rollup.commit(f"load-{b}", inserts(counts.where(F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)), F.lit(load_batches)) == b)))
    old = counts.join(poor, "doc_id", "left_semi")
    rollup.commit("revise", revisions(old, old.withColumn("n_tokens", F.col("n_squeezed"))))
    rollup.commit("delete", deletes(counts.join(toxic, "doc_id", "left_semi")))
    return rollup
