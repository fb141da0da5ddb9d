"""The knowledge package of a corpus: Markdown pages of topics, facts, terms, procedures and entities.

Detection, aggregation and paging are distributed. The writer at the end fetches the pages one by one: a page has at
most ``paging.TARGET_BYTES``, and the driver holds one at a time.
"""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import aggregate, changes, detect, enrichment, normalize, review, segment
from ..shared import shared_table
from . import paging

#: What each part holds.
DESCRIPTIONS = {"knowledge_core": "What the sources say, by topic.", "reference_facts": "Requirements, values, dates and standards.", "glossary": "Terms and acronyms.", "procedures": "Numbered instructions.", "entities": "Standards, organizations, products and documents.", "INSTRUCTIONS": "How to use this package.", "FILE_GUIDE": "What each file holds."}


def _listed(rows: DataFrame, stem: str, heading: str, group: str, order: list, line) -> DataFrame:
    """One section per group: a heading and a list."""
    items = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("items"))
    body = F.concat(F.lit("## "), F.initcap(F.col(group)), F.lit("\n\n"), F.array_join(F.transform("items", lambda x: x["line"]), "\n"))
    return items.select(F.lit(stem).alias("stem"), F.struct(F.lit(0).cast("long").alias("a"), F.col(group).alias("b")).alias("place"), body.alias("section"))


def fallback_core(clean: DataFrame, chunks: DataFrame) -> DataFrame:
    """(place, section) for each document, of its points, facts and warnings: the core of a corpus in which no topic passes."""
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index", "sentence_idx"))
    facts = aggregate.document_facts(detect.facts(chunks)).select("doc_id", order.cast("long").alias("rank"), F.col("body").alias("text"))
    points = enrichment.fallback_points(aggregate.summaries(chunks), facts, detect.warning_sentences(clean, "clean_text"))
    lists = points.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "point"))).alias("ps"))  # five a document
    rows = clean.select("doc_id", "title", "source_filename").join(lists, "doc_id")
    body = F.array_join(F.transform("ps", lambda p: F.concat(F.lit("- "), p["point"])), "\n")
    return rows.select(F.struct(F.lit(0).cast("long").alias("a"), F.concat(F.lower("title"), F.lit("\x00"), "source_filename").alias("b")).alias("place"), F.concat(F.lit("## "), "title", F.lit("\n\n"), body, F.lit("\n\nSources: "), "source_filename").alias("section"))


def sections(corpus: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """(stem, place, section) of every part of the package, from a corpus of raw texts."""
    clean = normalize.with_knowledge_text(corpus, text_col)
    chunks = shared_table(segment.knowledge_chunks(clean, "clean_text"), "chunks")
    topics = shared_table(detect.topics(chunks), "topics")
    core = shared_table(aggregate.topic_sections(topics).select(F.lit("knowledge_core").alias("stem"), F.struct((-F.col("group_score")).cast("long").alias("a"), F.lower("label").alias("b")).alias("place"), "section"), "core")
    if core.isEmpty():
        core = fallback_core(clean, chunks).select(F.lit("knowledge_core").alias("stem"), "place", "section")
    facts = aggregate.reference_facts(detect.facts(chunks))
    fact_part = _listed(facts, "reference_facts", "Reference Facts", "category", [F.col("rank")], F.concat(F.lit("- "), "text", F.lit(" [sources: "), F.array_join("sources", ", "), F.lit("]")))
    terms = aggregate.corpus_glossary(detect.glossary(chunks))
    term_part = terms.select(F.lit("glossary").alias("stem"), F.struct(F.lit(0).cast("long").alias("a"), F.lower("term").alias("b")).alias("place"), F.concat(F.lit("## "), "term", F.lit("\n"), "definition").alias("section"))
    steps = aggregate.corpus_procedures(detect.procedures(chunks))
    step_part = steps.select(F.lit("procedures").alias("stem"), F.struct((-F.col("score")).cast("long").alias("a"), F.concat(F.lower("title"), F.lit("\x00"), "steps_text").alias("b")).alias("place"), F.concat(F.lit("## "), "title", F.lit("\n\nSource: "), "source_filename", F.lit("\n\n"), "steps_text").alias("section"))
    named = aggregate.entities_by_type(detect.entities(clean, "clean_text"))
    entity_part = named.select(F.lit("entities").alias("stem"), F.struct(F.lit(0).cast("long").alias("a"), F.concat("entity_type", F.lit(" "), "value").alias("b")).alias("place"), F.concat(F.lit("- "), "entity_type", F.lit(": "), "value", F.lit(" (first in "), "source_filename", F.lit(")")).alias("section"))
    return core.unionByName(fact_part).unionByName(term_part).unionByName(step_part).unionByName(entity_part)


def artifacts(corpus: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """(file_name, content) of the package."""
    return paging.paged(shared_table(sections(corpus, text_col).withColumn("id", F.monotonically_increasing_id()), "sections"))


def guides(files: list[str], name: str) -> dict[str, str]:
    described = lambda f: next((d for stem, d in DESCRIPTIONS.items() if f.startswith(stem)), "Part of the package.")
    listing = "\n".join(f"- {f}: {described(f)}" for f in sorted(files))
    return {"INSTRUCTIONS.md": f"# {name}\n\nAnswer from the files listed below and name the file you use. If they do not say, say so.\n\n{listing}\n", "FILE_GUIDE.md": f"# Files\n\n{listing}\n"}


def validation(found: DataFrame, queue: DataFrame | None = None) -> DataFrame:
    """(message): files that are no Markdown, too large, or doubles of another; open reviews."""
    sized = found.where(~F.col("file_name").endswith(".md")).select(F.concat(F.lit("not Markdown: "), "file_name").alias("message"))
    large = found.where(F.octet_length("content") > paging.MOST_BYTES).select(F.concat(F.lit("too large: "), "file_name").alias("message"))
    double = changes.duplicate_artifacts(found).select(F.concat(F.lit("same content: "), "file_name", F.lit(" and "), "first_name").alias("message"))
    out = sized.unionByName(large).unionByName(double)
    if queue is not None:
        n = review.review_counts(queue).where("open > 0").select(F.concat(F.col("open").cast("string"), F.lit(" open reviews")).alias("message"))
        out = out.unionByName(n)
    return out


def write_files(found: DataFrame, folder: str | Path) -> list[str]:
    """Write files (file_name, content), one at a time, and return their names."""
    names = []
    for row in found.orderBy("file_name").toLocalIterator():
        file = Path(folder) / row["file_name"]
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(row["content"] + "\n", encoding="utf-8")
        names.append(row["file_name"])
    return names


def write(found: DataFrame, folder: str | Path, name: str = "knowledge", zipped: bool = False) -> list[str]:
    """Write the package's files with their guides and return their names."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    names = write_files(found, out)
    for file, body in guides(names, name).items():
        (out / file).write_text(body, encoding="utf-8")
        names.append(file)
    if zipped:
        with zipfile.ZipFile(out.with_suffix(".zip"), "w", zipfile.ZIP_DEFLATED) as z:
            for file in sorted(names):
                z.write(out / file, file)
    return sorted(names)


def debug_files(corpus: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """(file_name, content): of every document its raw and clean text, its chunks, accepted and rejected candidates.

    Documents of one name in different folders get a file each: the name is followed by the document's id.
    """
    from ..operators import reports

    clean = normalize.with_knowledge_text(corpus, text_col)
    chunks = shared_table(segment.knowledge_chunks(clean, "clean_text"), "chunks")
    found = reports.unified_candidates(detect.glossary(chunks), detect.procedures(chunks), detect.facts(chunks), detect.topics(chunks))
    stem = F.concat(F.replace(F.expr(text.slug("title", 80)), F.lit("-"), F.lit("_")), F.lit("_"), F.col("doc_id").cast("string"))
    as_file = lambda folder, suffix, content: F.struct(F.concat(F.lit(f"{folder}/"), "stem", F.lit(suffix)).alias("file_name"), content.alias("content"))

    def listed(folder: str, blocks: str, title: str) -> Column:
        """A document's blocks in their order; a document without any says so."""
        body = F.when(F.size(blocks) > 0, F.array_join(F.transform(F.sort_array(blocks), lambda b: b["block"]), "\n\n")).otherwise("Nothing recorded.")
        return as_file(folder, ".md", F.concat(F.lit(f"# {title}\n\n"), body, F.lit("\n")))

    chunk = F.concat(F.lit("## "), "chunk_id", F.lit("\n- heading: "), "heading", F.lit("\n\n"), "text")
    candidate = F.concat(F.lit("## "), "target_type", F.lit(": "), "title", F.lit("\n- score: "), F.col("score").cast("string"), F.coalesce(F.concat(F.lit("\n- rejection: "), "rejection_reason"), F.lit("")), F.lit("\n- chunk: "), "chunk_id", F.lit("\n\n"), "body")
    block = F.struct("target_type", "chunk_id", "title", "body", candidate.alias("block"))
    # candidates are found once: both lists of a document come out of one pass over them
    of_chunks = chunks.groupBy("doc_id").agg(F.collect_list(F.struct("chunk_index", chunk.alias("block"))).alias("chunks"))  # of one document
    of_found = found.groupBy("doc_id").agg(*[F.collect_list(F.when(F.col("rejection_reason").isNull() == ok, block)).alias(name) for name, ok in (("accepted", True), ("rejected", False))])
    rows = clean.select("doc_id", stem.alias("stem")).join(of_chunks, "doc_id", "left").join(of_found, "doc_id", "left")
    lists = rows.select(F.inline(F.array(listed("chunks", "chunks", "Chunks"), listed("promotion_candidates", "accepted", "Accepted Candidates"), listed("rejected_candidates", "rejected", "Rejected Candidates"))))
    texts = clean.withColumn("stem", stem).select(F.inline(F.array(as_file("extracted", ".txt", F.coalesce(text_col, F.lit(""))), as_file("normalized", ".txt", F.col("clean_text")))))
    return texts.unionByName(lists)
