"""Pages of a package part: sections in their order, about so many words a page.

Only sizes pass through one task a part: a scan over (place, words) gives each section its page. Texts stay where they
are until they are grouped by page, so a part of any size is put together by many tasks. What becomes of a page (a
short last page joins the one before, pages without substance go, pages over the byte limit are split) is decided from
the pages' sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..shared import shared_table

#: Words of a core page and of other pages; a last page under so many words joins the one before.
CORE_WORDS, PAGE_WORDS, SHORT_CORE, SHORT_PAGE = 1600, 1700, 120, 100
#: Bytes that a file should have at most, and must not exceed; words that a core page must have.
TARGET_BYTES, MOST_BYTES, LEAST_CORE_WORDS, LEAST_WORDS = 1_200_000, 8_000_000, 40, 8


def _numbered(core: str):
    """Rows (stem, id, n_words) in order: a section that would take its page over the target opens the next one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stem, page, words = None, 0, 0
        for b in batches:
            pages = []
            for s, n in zip(b["stem"], b["n_words"], strict=True):
                if s != stem:
                    stem, page, words = s, 0, n
                elif words + n > (CORE_WORDS if s == core else PAGE_WORDS):
                    page, words = page + 1, n
                else:
                    words += n
                pages.append(page)
            yield b[["stem", "id"]].assign(page=pages)

    return run


def _substantive(lines: Column) -> Column:
    """Beside headings there are lines of three words, of eight words in all, or one of four."""
    words = F.transform(F.filter(lines, lambda line: (line != "") & ~line.startswith("#")), lambda line: F.regexp_count(line, F.lit(text.WORD)))
    real = F.filter(words, lambda n: n >= 3)
    return (F.aggregate(real, F.lit(0), lambda a, n: a + n) >= LEAST_WORDS) | F.exists(real, lambda n: n >= 4)


def _by_bytes(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in pages:
        rows = [(stem, page, i, piece) for stem, page, content in zip(b["stem"], b["page"], b["content"], strict=True) for i, piece in enumerate(by_bytes(content, TARGET_BYTES))]
        yield pd.DataFrame(rows, columns=["stem", "page", "piece", "content"])


def by_bytes(page: str, most: int) -> list[str]:
    """Pieces of at most ``most`` UTF-8 bytes, cut between paragraphs where that is possible."""
    pieces, held, size = [], [], 0
    for paragraph in page.split("\n\n"):
        raw = paragraph.encode()
        if held and size + 2 + len(raw) > most:
            pieces.append("\n\n".join(held))
            held, size = [], 0
        while len(raw) > most:  # no split inside a character
            head = raw[:most].decode("utf-8", "ignore")
            pieces.append(head)
            raw = raw[len(head.encode()) :]
        size += len(raw) + (2 if held else 0)
        held.append(raw.decode())
    return [*pieces, "\n\n".join(held)] if held else pieces


def paged(sections: DataFrame, core: str = "knowledge_core") -> DataFrame:
    """(file_name, content) from (id, stem, place, section); ``id`` tells sections apart."""
    words = F.expr(text.words("section"))
    sizes = sections.select("id", "stem", "place", words.alias("n_words"))
    numbered = sizes.repartition("stem").sortWithinPartitions("stem", "place", "id").select("stem", "id", "n_words").mapInPandas(_numbered(core), "stem string, id long, page long")
    lines = F.expr(text.lines("section"))
    facts = sections.select("id", "stem", "place", words.alias("n_words"), _substantive(lines).alias("real"), F.exists(lines, lambda line: line.startswith("- ")).alias("listed")).join(numbered, ["stem", "id"])
    stats = facts.groupBy("stem", "page").agg(F.sum("n_words").alias("n_words"), F.bool_or("real").alias("real"), F.bool_or("listed").alias("listed"))
    is_core = F.col("stem") == core
    of_stem, order = Window.partitionBy("stem"), Window.partitionBy("stem").orderBy("page")
    # pages without substance go first in the other parts; of the core, only after the last page found its place
    stats = stats.where(is_core | F.col("real")).withColumns({"total": F.count(F.lit(1)).over(of_stem), "nth": F.row_number().over(order), "before": F.lag("page").over(order), "before_words": F.lag("n_words").over(order)})
    target = F.when(is_core, CORE_WORDS).otherwise(PAGE_WORDS)
    joins = (F.col("nth") == F.col("total")) & (F.col("total") > 1) & (F.col("n_words") < F.when(is_core, SHORT_CORE).otherwise(SHORT_PAGE)) & (F.col("n_words") + F.col("before_words") <= F.floor(target * 1.25))
    stats = stats.withColumn("onto", F.when(joins, F.col("before")).otherwise(F.col("page")))
    whole = stats.groupBy("stem", "onto").agg(F.sum("n_words").alias("n_words"), F.bool_or("listed").alias("listed"), F.collect_list("page").alias("pages"))  # two pages at most
    whole = whole.withColumns({"total": F.count(F.lit(1)).over(of_stem), "nth": F.row_number().over(Window.partitionBy("stem").orderBy("onto"))})
    n = F.col("n_words")
    stays = ~is_core | (n >= LEAST_CORE_WORDS) | ((n >= LEAST_WORDS) & ((F.col("total") == 1) | ((F.col("nth") == 1) & F.col("listed"))))
    page_of = whole.where(stays).select("stem", F.col("onto").alias("final"), F.explode("pages").alias("page"))
    rows = sections.join(numbered, ["stem", "id"]).join(page_of, ["stem", "page"])
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id", "section"))), lambda x: x["section"]), "\n\n")  # of one page
    pieces = rows.groupBy("stem", F.col("final").alias("page")).agg(content.alias("content")).mapInPandas(_by_bytes, "stem string, page long, piece long, content string")
    pieces = shared_table(pieces, "pieces")
    # numbers come from the pieces' keys alone
    keys = pieces.select("stem", "page", "piece").withColumns({"n": F.row_number().over(Window.partitionBy("stem").orderBy("page", "piece")), "total": F.count(F.lit(1)).over(of_stem)})
    digits = F.lpad(F.col("n").cast("string"), F.greatest(F.lit(2), F.length(F.col("total").cast("string"))), F.lit("0"))
    suffix = F.when((F.col("total") > 1) | is_core, F.concat(F.lit("_p"), digits)).otherwise("")
    return pieces.join(keys, ["stem", "page", "piece"]).select(F.concat("stem", suffix, F.lit(".md")).alias("file_name"), "content")
