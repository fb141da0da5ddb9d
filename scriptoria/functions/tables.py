"""Table functions for Spark SQL: one table in, rows out, partitioned and ordered as each needs.

``register(spark)`` makes them callable: ``SELECT * FROM corpus_sentences(TABLE(docs))``. Rows travel as Arrow batches. A
function asks for what it needs (``partitionBy`` and ``orderBy`` in its analysis), so the caller writes no clauses. What
a function keeps in memory is one row, or the running state of one partition.

- ``corpus_sentences(TABLE(doc_id, raw_text))``: doc_id, sentence_idx, sentence.
- ``corpus_headings(TABLE(doc_id, para_idx, text))``: doc_id, para_idx, section: the last heading at or above each
  paragraph; documents of any number of paragraphs, since they come as rows in order and not as one array.
- ``corpus_pages(TABLE(group, place, n_words), target)``: group, place, page: consecutive rows packed into pages of at most
  ``target`` words; a larger row has a page of its own.

Defined results: null text has no sentences and is no heading; a null group is a group; of equal places the order is
open; null word counts are 0; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, Row, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

#: Fixed values, as in the columns' rules: where sentences part, what a section's heading is.
SENTENCE_END = re.compile(r"(?<=[.!?])[ \t\n\r\f]+(?=[A-Z0-9])")
BLANKS = " \t\n\r\f"


def _typed(table: AnalyzeArgument, *names: str) -> list[StructField]:
    """The columns that a function reads; an error at analysis if one is missing."""
    if not table.isTable:
        raise ValueError("the first argument must be a table: TABLE(...)")
    have = {f.name.lower(): f for f in table.dataType.fields}
    missing = [n for n in names if n not in have]
    if missing:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    return [have[n] for n in names]


class Sentences:
    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        key, _ = _typed(table, "doc_id", "raw_text")
        return AnalyzeResult(StructType([StructField("doc_id", key.dataType), StructField("sentence_idx", IntegerType()), StructField("sentence", StringType())]))

    def eval(self, row: Row) -> Iterator[tuple]:
        parts = (s.strip(BLANKS) for s in SENTENCE_END.split(row["raw_text"] or ""))
        for i, sentence in enumerate(s for s in parts if s):
            yield row["doc_id"], i, sentence


class Headings:
    def __init__(self) -> None:
        self.key, self.section = object(), ""

    @staticmethod
    def analyze(table: AnalyzeArgument, pattern: AnalyzeArgument) -> AnalyzeResult:
        key, place, _ = _typed(table, "doc_id", "para_idx", "text")
        schema = StructType([StructField("doc_id", key.dataType), StructField("para_idx", place.dataType), StructField("section", StringType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("doc_id")], orderBy=[OrderingColumn("para_idx")])

    def eval(self, row: Row, pattern: str) -> Iterator[tuple]:
        if row["doc_id"] != self.key:  # a task may bring one partition after the other
            self.key, self.section = row["doc_id"], ""
        first = (row["text"] or "").split("\n", 1)[0].strip(" ")
        if re.search(pattern, first):
            self.section = first.lstrip("# ")
        yield row["doc_id"], row["para_idx"], self.section


class Pages:
    def __init__(self) -> None:
        self.key, self.page, self.words = object(), 1, 0

    @staticmethod
    def analyze(table: AnalyzeArgument, target: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(target.value, int) or target.value < 1:
            raise ValueError("target must be a positive whole number")
        key, place, _ = _typed(table, "group", "place", "n_words")
        schema = StructType([StructField("group", key.dataType), StructField("place", place.dataType), StructField("page", LongType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("group")], orderBy=[OrderingColumn("place")])

    def eval(self, row: Row, target: int) -> Iterator[tuple]:
        if row["group"] != self.key:
            self.key, self.page, self.words = row["group"], 1, 0
        n = row["n_words"] or 0
        if self.words and self.words + n > target:
            self.page, self.words = self.page + 1, 0
        self.words += n
        yield row["group"], row["place"], self.page


FUNCTIONS = {"corpus_sentences": Sentences, "corpus_headings": Headings, "corpus_pages": Pages}


def register(spark: SparkSession) -> None:
    for name, handler in FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler, useArrow=True))
