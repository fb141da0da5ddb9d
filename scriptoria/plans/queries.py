"""Registered queries: each runs an operator over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..functions import tables as table_functions
from ..functions.dialect import SPARK
from ..operators import aggregate, changes, delimited, detect, duplicates, enrichment, markup, normalize, profile, reports, review, rulesets, segment
from ..shared import settings, shared_dir, shared_table
from ..sources import tables
from ..sources.datasource import CorpusFiles, local, written_folders
from ..streaming import keyed, progress, scan
from . import package
from .commits import CommittedTable

Query = Callable[[SparkSession, str], DataFrame]

#: Fixed values of the examples below: a taxonomy over paths.
TAXONOMY = [("*brand-1*", "installation"), ("**/brand-2*/*", "maintenance"), ("/manuals/*", "service")]


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """The manuals' chunks with their features: three detectors and more read them, so they are kept."""
    return shared_table(segment.knowledge_chunks(tables.manuals(spark, d)), "chunks")


def _procedures(spark: SparkSession, d: str) -> DataFrame:
    """Procedures of the manuals, from the chunks with a step: they are read once, so no table is kept."""
    return detect.procedures(segment.knowledge_chunks(tables.manuals(spark, d), mark=detect.STEP_MARK))


# words, sentences, dates, names


def word_count_by_source(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.documents(spark, d)
    return docs.groupBy(F.col("source_folder_name").alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.expr(text.words("raw_text"))).alias("n_words"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    rows = segment.sentences(tables.documents(spark, d))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.expr(text.words("sentence"))).alias("n_words"), F.max(F.length("sentence")).cast("long").alias("longest"), F.min_by("sentence", "sentence_idx").alias("first_sentence"))


def doc_date_detect(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.manuals(spark, d)
    return rows.select("doc_id", F.coalesce(F.expr(text.found_date("raw_text")), F.expr(text.found_date("source_filename")), F.lit("nodate")).alias("doc_date"))


def canonical_name(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.manuals(spark, d).withColumn("topic", changes.first_rule(F.col("source_path"), TAXONOMY, "general")).withColumn("date", F.coalesce(F.expr(text.found_date("raw_text")), F.lit("nodate")))
    stem = F.expr(text.slug("title", 50))
    name = F.concat(F.concat_ws("__", F.lit("reference"), F.col("document_type"), F.expr(text.slug("topic", 40)), stem, F.col("date"), F.substring(F.sha2("raw_text", 256), 1, 8)), F.lit(".md"))
    return rows.select("doc_id", "topic", name.alias("canonical_name"))


# profiles


def doc_profile_ratios(spark: SparkSession, d: str) -> DataFrame:
    rows = profile.profiles(tables.documents(spark, d))
    return rows.select("doc_id", *profile.measures("x", "y"), "quality_score", "mostly_tabular")


def quality_flags(spark: SparkSession, d: str) -> DataFrame:
    return profile.profiles(tables.documents(spark, d)).select(F.explode("quality_flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n_docs"))


def infer_domain_kind(spark: SparkSession, d: str) -> DataFrame:
    rows = profile.profiles(tables.manuals(spark, d))
    return rows.groupBy("probable_domain", "document_kind", profile.project_domain(rows).alias("project_domain")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("quality_score").alias("score_sum"))


def type_counts(spark: SparkSession, d: str) -> DataFrame:
    one = lambda name, kind, body: tables.table(spark, d, name).select(F.lit(kind).alias("document_type"), F.octet_length(body).cast("long").alias("size_bytes"))
    files = one("documents", "txt", "text").unionByName(one("pages", "html", "html")).unionByName(one("conversations", "log", "text")).unionByName(one("events", "json", "props"))
    return files.groupBy("document_type").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").alias("size_bytes"), F.max("size_bytes").alias("largest"))


def workload_forecast(spark: SparkSession, d: str) -> DataFrame:
    files = tables.documents(spark, d).select("source_folder_name", "document_type", F.octet_length("raw_text").cast("long").alias("size_bytes"))
    return profile.workload(files)


# chunks


def paragraph_chunks(spark: SparkSession, d: str) -> DataFrame:
    return segment.knowledge_chunks(tables.manuals(spark, d)).select("doc_id", "chunk_index", "chunk_id", "heading", "text", "promotion_text", "n_admin", "low_value")


def heading_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = segment.paragraphs(tables.manuals(spark, d), heading=segment.SECTION_HEADING, start=None)
    return rows.select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), F.col("heading").alias("section"))


def chunk_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = segment.chunk_flags(segment.paragraphs(tables.manuals(spark, d)))
    flags = ["contains_table", "contains_requirements", "contains_definitions", "contains_parts"]
    return rows.groupBy(*flags).agg(F.count(F.lit(1)).alias("n_chunks"))


def pack_chunks(spark: SparkSession, d: str) -> DataFrame:
    return segment.pack_chunks(tables.documents(spark, d), by="\n")


def preview_units(spark: SparkSession, d: str) -> DataFrame:
    return segment.preview_units(tables.documents(spark, d))


# records of the chunk engine


def _records(of: Callable[[DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return of(segment.knowledge_chunks(tables.manuals(spark, d)))

    return query


def _text_records(of: Callable[[DataFrame], DataFrame]) -> Query:
    """Of records that read no more of a chunk than its text."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = segment.paragraphs(tables.manuals(spark, d))
        return of(rows.select("doc_id", F.col("para_idx").cast("long").alias("chunk_index"), "text"))

    return query


# candidates and what the corpus makes of them


def glossary(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.document_glossary(detect.glossary(_chunks(spark, d))).select("doc_id", "chunk_id", "heading", "term", "body", "score")


def glossary_rejected(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.rejected(detect.glossary(_chunks(spark, d))).select("doc_id", "chunk_id", "line_no", "term", "body", "score", "rejection_reason")


def corpus_glossary(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.corpus_glossary(detect.glossary(_chunks(spark, d)))


def procedures(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.corpus_procedures(_procedures(spark, d))


def procedures_rejected(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.rejected(_procedures(spark, d)).select("doc_id", "chunk_id", "title", F.array_join("steps", "\n").alias("steps_text"), "score", "rejection_reason")


def facts(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.document_facts(detect.facts(_chunks(spark, d))).select("doc_id", "chunk_id", "category", "body", "score")


def facts_rejected(spark: SparkSession, d: str) -> DataFrame:
    rows = aggregate.rejected(detect.facts(_chunks(spark, d)))
    return rows.groupBy("rejection_reason", "category").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score_sum"), F.countDistinct("body").alias("n_bodies"))


def manual_reference_facts(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.reference_facts(detect.facts(_chunks(spark, d))).select("category", "rank", "text", "score", "n_sources", F.array_join("sources", ", ").alias("sources"))


def reference_facts(spark: SparkSession, d: str) -> DataFrame:
    """Documents -> sentences -> fact signal -> score -> best per document -> the best 120 of a category."""
    chunks = segment.knowledge_chunks(tables.documents(spark, d))
    return aggregate.reference_facts(detect.facts(chunks)).select("category", "rank", "text", "score", "n_sources", F.array_join("sources", ", ").alias("sources"))


def topics(spark: SparkSession, d: str) -> DataFrame:
    return detect.topics(_chunks(spark, d)).select("doc_id", "chunk_id", "topic_key", "topic_label", "body", "score", "rejection_reason")


def topic_groups(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.topic_groups(detect.topics(_chunks(spark, d)))


def topic_pages(spark: SparkSession, d: str) -> DataFrame:
    found = shared_table(detect.topics(_chunks(spark, d)), "topics")
    return aggregate.topic_sections(found)


def topic_selection(spark: SparkSession, d: str) -> DataFrame:
    found = shared_table(detect.topics(_chunks(spark, d)), "topics")
    return aggregate.selected_topics(found).select("topic_key", "doc_id", "chunk_index", "score", "pick")


def topic_terms(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.topic_terms(tables.documents(spark, d), F.expr(rules.long_words("raw_text")))


def entities(spark: SparkSession, d: str) -> DataFrame:
    return detect.entities(tables.manuals(spark, d)).select("doc_id", "entity_type", "value", "normalized_key")


def entities_by_type(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.entities_by_type(detect.entities(tables.manuals(spark, d)))


def warning_sentences(spark: SparkSession, d: str) -> DataFrame:
    return detect.warning_sentences(tables.manuals(spark, d))


def summaries(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.summaries(segment.knowledge_chunks(tables.documents(spark, d)))


def fallback_points(spark: SparkSession, d: str) -> DataFrame:
    """What stands for a document when no topic is found: its points, facts and warnings."""
    manuals = tables.manuals(spark, d)
    chunks = _chunks(spark, d)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index", "sentence_idx"))
    found = aggregate.document_facts(detect.facts(chunks)).select("doc_id", place.cast("long").alias("rank"), F.col("body").alias("text"))
    return enrichment.fallback_points(aggregate.summaries(chunks), found, detect.warning_sentences(manuals))


def enriched(spark: SparkSession, d: str) -> DataFrame:
    """Titles and hints by rule for every manual, and a model's answers for those of the cache: parts that are labelled large."""
    manuals, chunks = tables.manuals(spark, d), _chunks(spark, d)
    topics_ = aggregate.accepted(detect.topics(chunks))
    ruled = enrichment.by_rule(manuals, aggregate.summaries(chunks), aggregate.document_glossary(detect.glossary(chunks)), topics_, detect.warning_sentences(manuals))
    keys = manuals.select("doc_id", enrichment.cache_key(F.sha2("raw_text", 256), "none", "none", "1").alias("cache_key"))
    answers = tables.table(spark, d, "part").where("p_type like '%LARGE%'").select(F.col("p_partkey").alias("doc_id"), F.lit(" ").alias("clean_title"), F.lit("hardware").alias("domain"), F.col("p_name").alias("topic"), F.when(F.col("p_size") > 25, "1.7").otherwise("no number").alias("confidence"))
    cache = keys.join(answers, "doc_id").drop("doc_id")
    out = enrichment.enriched(ruled, keys, cache)
    return out.select("doc_id", "clean_title", "domain", "topic", "synopsis", F.array_join("glossary_hints", "|").alias("glossary_hints"), F.array_join("review_notes", "|").alias("review_notes"), F.floor(F.col("confidence") * 100 + 0.5).cast("long").alias("confidence"), "mode")


def enrichment_to_ask(spark: SparkSession, d: str) -> DataFrame:
    """After the documents have changed: whom a model would have to be asked about again."""
    old, new = _snapshots(spark, d)
    key = enrichment.cache_key(F.col("checksum"), "none", "none", "1").alias("cache_key")
    return enrichment.to_ask(new.select(F.col("source_path").alias("doc_id"), key), old.select(key)).select(F.col("doc_id").alias("source_path"), "cache_key")


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    every = shared_table(reports.unified_candidates(detect.glossary(chunks), detect.procedures(chunks), detect.facts(chunks), detect.topics(chunks)), "candidates")
    return reports.quality_report(every, tables.manuals(spark, d), chunks.agg(F.count(F.lit(1)).alias("n_chunks")))


def _ranked(rows: DataFrame, order: list, most: int = 50) -> DataFrame:
    """The first ``most`` rows with their place."""
    top = rows.orderBy(*order).limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))  # ``most`` rows


def glossary_order(spark: SparkSession, d: str) -> DataFrame:
    rows = aggregate.document_glossary(detect.glossary(_chunks(spark, d)))
    return _ranked(rows, [F.desc("score"), F.lower("term"), "doc_id"]).select("place", "doc_id", "term", "score")


def procedures_order(spark: SparkSession, d: str) -> DataFrame:
    rows = aggregate.corpus_procedures(_procedures(spark, d))
    return _ranked(rows, [F.desc("score"), F.lower("title"), F.lower("source_filename"), "steps_text"]).select("place", "title", "source_filename", "score")


def topics_order(spark: SparkSession, d: str) -> DataFrame:
    rows = aggregate.topic_groups(detect.topics(_chunks(spark, d)))
    return _ranked(rows, [F.desc("group_score"), F.desc("n_candidates"), F.lower("label"), "topic_key"]).select("place", "topic_key", "label", "group_score")


def record_columns(spark: SparkSession, d: str) -> DataFrame:
    """Records of three kinds in one table with the columns of all: how many rows of a kind have which."""
    chunks = _chunks(spark, d)
    kinds = {"definitions": detect.definition_records, "requirements": detect.requirement_records, "warnings": detect.warning_records}
    parts = [of(chunks).withColumn("kind", F.lit(kind)) for kind, of in kinds.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    own = ["term", "definition", "requirement_text", "requirement_type", "warning_type", "warning_text"]
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"n_{c}") for c in own])


# cleaning


#: Settings of jobs that send whole texts to Python: few rows a batch, as a worker holds a batch with all its lines.
FEW_TEXTS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "64"}


def line_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Every document's lines beside those of its clean text."""
    rows = normalize.with_knowledge_text(tables.documents(spark, d))
    with settings(spark, FEW_TEXTS):
        return shared_table(rows.select("doc_id", duplicates.line_diff(F.split("raw_text", "\n"), F.split("clean_text", "\n")).alias("x")).select("doc_id", "x.*"), "line_diffs")


def _alignments(spark: SparkSession, d: str) -> DataFrame:
    rows = normalize.with_knowledge_text(tables.documents(spark, d))
    with settings(spark, FEW_TEXTS):
        return shared_table(duplicates.aligned_lines(rows, "doc_id", F.split("raw_text", "\n"), F.split("clean_text", "\n")), "alignments")


def line_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every document beside that of its clean text."""
    return _alignments(spark, d)


def line_rebuilds(spark: SparkSession, d: str) -> DataFrame:
    """The documents put together again from their aligned lines."""
    back = duplicates.rebuilt(_alignments(spark, d), "doc_id").select("doc_id", "n_lines", F.sha2("text", 256).alias("digest"))
    return tables.documents(spark, d).select("doc_id").join(back, "doc_id", "left").select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "digest")


def path_rules(spark: SparkSession, d: str) -> DataFrame:
    """All paths by a rule for each part and one for each brand; the first that fits counts."""
    number = F.lpad(F.col("p_partkey").cast("string"), 6, "0")
    pattern = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("**/part_"), number, F.lit(".md"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("/manuals/brand-[!3]*/*_"), number, F.lit(".??")))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("*_"), number, F.lit("[.]*"))).otherwise(F.concat(F.lit("/corpus/*/doc_"), F.substring(number, 1, 5), F.lit("[0-4].txt")))
    )
    part = tables.table(spark, d, "part")
    own = part.select(F.col("p_partkey").alias("pos"), pattern.alias("pattern"), F.concat_ws("/", "p_type", F.col("p_partkey").cast("string")).alias("label"))
    brand = part.groupBy("p_brand").agg(F.max("p_partkey").alias("last")).select(F.lit(1 << 40).alias("pos"), F.concat(F.lit("*/"), F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", "-"), F.lit("/*")).alias("pattern"), F.col("p_brand").alias("label"))
    paths = tables.manuals(spark, d).select("source_path").unionByName(tables.documents(spark, d).select("source_path"))
    return rulesets.first_fitting(paths, own.unionByName(brand), "general")


def rendered_markdown(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.manuals(spark, d)
    date = F.coalesce(F.expr(text.found_date("raw_text")), F.lit("nodate"))
    out = reports.rendered_markdown(rows, "reference", changes.first_rule(F.col("source_path"), TAXONOMY, "general"), date)
    return out.select("doc_id", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("digest"))


def corpus_names(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.manuals(spark, d).select("source_folder_name").distinct()
    return rows.select("source_folder_name", F.replace(F.expr(text.slug("source_folder_name", 80)), F.lit("-"), F.lit("_")).alias("corpus_name"))


#: Fixed value: purpose, type, topic, stem, date, digest.
CANONICAL = r"^([a-z]+)__([a-z0-9]+)__([a-z0-9-]+)__([a-z0-9-]+)__(nodate|[0-9]{8})__([0-9a-f]{8})[.]md$"


def canonical_parts(spark: SparkSession, d: str) -> DataFrame:
    """Canonical names read back into their parts, and the names of the sources, which are none."""
    names = canonical_name(spark, d).select("doc_id", F.col("canonical_name").alias("name")).unionByName(tables.manuals(spark, d).select("doc_id", F.col("source_filename").alias("name")))
    part = lambda g: F.regexp_extract("name", CANONICAL, g)
    return names.select("doc_id", "name", F.col("name").rlike(CANONICAL).alias("is_canonical"), part(3).alias("topic"), part(4).alias("stem"), part(5).alias("doc_date"))


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return normalize.with_knowledge_text(tables.documents(spark, d)).select("doc_id", "clean_text")


def page_text(spark: SparkSession, d: str) -> DataFrame:
    return normalize.with_page_text(tables.documents(spark, d)).select("doc_id", "clean_text")


def repeated_edge_lines(spark: SparkSession, d: str) -> DataFrame:
    """The turns of a conversation as the pages of one document."""
    return normalize.repeated_edge_lines(tables.table(spark, d, "conversations").select("conv_id", "text"), "conv_id", "text")


# pages and events


def html_title(spark: SparkSession, d: str) -> DataFrame:
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return tables.table(spark, d, "pages").select("page_id", "url", F.trim(F.regexp_replace(title, r"[ \t\n\r\f]+", " ")).alias("title"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    return markup.with_visible_text(tables.table(spark, d, "pages")).select("page_id", "title", "text")


def low_quality_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages by whether they are of low quality; those with more links than paragraphs count as mostly not text."""
    rows = tables.table(spark, d, "pages")
    heavy = F.regexp_count("html", F.lit("<a ")) > F.regexp_count("html", F.lit("<p"))
    shown = F.array_join(F.expr(markup.pieces("html")), "\n")
    found = rows.select(heavy.alias("image_heavy"), shown.alias("shown")).select("image_heavy", reports.low_quality_page(F.col("shown"), F.col("image_heavy")).alias("low_quality"), F.length("shown").alias("n"))
    return found.groupBy("image_heavy", "low_quality").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("n").alias("n_chars"))


def cell_text(spark: SparkSession, d: str) -> DataFrame:
    """Each document as delimited text of two rows, its values in quotes, with commas and tabs in turns, and read back as cells."""
    columns = ("source", "lang", "text")
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    written = {kind: F.concat(F.lit(by.join(columns) + "\r\n"), F.concat_ws(by, *quoted)) for kind, by in delimited.DELIMITERS.items()}
    rows = tables.table(spark, d, "documents").withColumn("document_type", F.when(F.col("doc_id") % 2 == 0, "csv").otherwise("tsv"))
    rows = rows.select("doc_id", "document_type", F.when(F.col("document_type") == "csv", written["csv"]).otherwise(written["tsv"]).alias("raw"))
    return delimited.with_cell_text(rows, "raw", "document_type", "text").select("doc_id", "document_type", "text")


def json_status(spark: SparkSession, d: str) -> DataFrame:
    ok = F.try_parse_json("props").isNotNull()
    return tables.table(spark, d, "events").groupBy("event_type", F.when(ok, "success").otherwise("partial").alias("status")).agg(F.count(F.lit(1)).alias("n"))


# duplicates, review, incremental scans


def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.exact_groups(tables.documents(spark, d))


def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.near_duplicate_groups(tables.documents(spark, d))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """Document rows of the review workflow; exact copies stand for the duplicates, long sentences for the items."""
    docs = tables.documents(spark, d)
    domains = docs.select("doc_id", profile.project_domain(docs).alias("probable_domain"))
    items = docs.select("doc_id", F.expr(SPARK.size(SPARK.keep(text.sentences("raw_text"), "s", f"{text.words('s')} >= 8"))).alias("knowledge_item_count"))
    copies = duplicates.exact_groups(docs).where("source_path <> canonical").select("source_path", F.col("canonical").alias("duplicate_of"))
    return shared_table(review.document_rows(docs, domains, copies, items), "document_rows")


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return review.review_queue(_documents(spark, d)).select("review_id", "source_path", "kind", "severity", "status", "title", "detail", "confidence")


def _reviewed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The document rows, and their queue with the duplicates rejected."""
    docs = _documents(spark, d)
    return docs, shared_table(review.reject_duplicates(review.review_queue(docs)), "queue")


def review_priority(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty items of the queue in the reviewer's order."""
    docs, queue = _reviewed(spark, d)
    return review.in_order(queue, docs).limit(20).select("review_id", "kind", "severity", "status", "source_path")


def review_sorted(spark: SparkSession, d: str) -> DataFrame:
    """The first ten items by each of the five orders, the last three from behind."""
    docs, queue = _reviewed(spark, d)
    top = lambda by: review.in_order(queue, docs, by, by in ("kind", "severity", "status")).limit(10).select(F.lit(by).alias("sorted_by"), "review_id")
    first, *rest = [top(by) for by in review.SORTS]
    for part in rest:
        first = first.unionByName(part)
    return first


def review_filters(spark: SparkSession, d: str) -> DataFrame:
    return review.filter_counts(_reviewed(spark, d)[1])


def review_actions(spark: SparkSession, d: str) -> DataFrame:
    docs, queue = _reviewed(spark, d)
    rows = queue.join(docs.select("source_path", "extraction_status"), "source_path")
    return rows.select("review_id", review.action().alias("action"), F.array_join(review.tags(), ",").alias("tags"))


def review_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Edits of every open item: weak classifications get the folder as domain, low-signal ones a title and are rejected."""
    docs = _documents(spark, d).withColumn("title", F.regexp_replace("source_filename", "[.][^.]*$", ""))
    queue = shared_table(review.review_queue(docs), "queue")
    edit = lambda kind, status, title, domain: queue.join(docs.select("source_path", "source_folder_name", F.col("title").alias("own")), "source_path").where(F.col("kind") == kind).select("review_id", F.lit(status).alias("status"), title.alias("override_title"), domain.alias("override_domain"), F.lit("edited").alias("resolution_note"))
    null = F.lit(None).cast("string")
    edits = edit("taxonomy", "accepted", null, F.concat(F.lit(" Area of "), "source_folder_name")).unionByName(edit("low_signal", "rejected", F.concat(F.lit("Short: "), "own"), null))
    return review.with_overrides(docs, review.updated(queue, edits)).select("doc_id", "title", "probable_domain", "review_status")


def review_counts(spark: SparkSession, d: str) -> DataFrame:
    return review.review_counts(review.reject_duplicates(review.review_queue(_documents(spark, d))))


def retry_targets(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    return review.retry_targets(review.review_queue(docs), docs)


def export_eligible(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    return review.export_eligible(docs, review.reject_duplicates(review.review_queue(docs))).select("doc_id", "source_path", "word_count")


def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    return review.diagnostics(docs, review.review_queue(docs))


def degraded_documents(spark: SparkSession, d: str) -> DataFrame:
    return reports.degraded_documents(_documents(spark, d))


def scan_report(spark: SparkSession, d: str) -> DataFrame:
    docs, queue = _reviewed(spark, d)
    return reports.scan_report(docs, queue)


def recent_issues(spark: SparkSession, d: str) -> DataFrame:
    docs, queue = _reviewed(spark, d)
    return reports.recent_issues(docs, queue)


def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    """Every folder of documents; all but the first by name were to run."""
    docs = _documents(spark, d)
    names = docs.select(F.col("source_folder_name").alias("corpus")).distinct()
    return reports.batch_summary(docs, names.join(names.agg(F.min("corpus").alias("corpus")), "corpus", "left_anti"))


def promoted_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """The exact copies after the last path of each group was made canonical."""
    groups = duplicates.exact_groups(tables.documents(spark, d)).where("source_path <> canonical").select("source_path", F.col("canonical").alias("duplicate_of"))
    groups = shared_table(groups, "groups")
    return duplicates.promoted(groups, groups.groupBy("duplicate_of").agg(F.max("source_path").alias("source_path")).select("source_path"))


def folder_candidates(spark: SparkSession, d: str) -> DataFrame:
    return review.folder_candidates(_documents(spark, d))


def workspace_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    return review.workspace_summary(docs, review.review_queue(docs))


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """An earlier and a later state of the documents: a tenth came, a tenth went, a seventh changed."""
    docs = tables.documents(spark, d)
    later = docs.withColumn("raw_text", F.when(F.col("doc_id") % 7 == 0, F.concat("raw_text", F.lit(" Revised."))).otherwise(F.col("raw_text")))
    return changes.fingerprints(docs.where("doc_id % 10 <> 0")), changes.fingerprints(later.where("doc_id % 10 <> 1"))


def changed_docs(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    return changes.classified(new, old)


def docs_to_process(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    return changes.to_process(new, old)


def removed_docs(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    return changes.removed(new, old)


def provenance(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    found = aggregate.accepted(detect.facts(chunks)).select(F.lit("reference_facts").alias("target_type"), F.col("category").alias("title"), "body", "doc_id", "chunk_id")
    terms = aggregate.accepted(detect.glossary(chunks)).select(F.lit("glossary").alias("target_type"), F.col("term").alias("title"), "body", "doc_id", "chunk_id")
    accepted = shared_table(found.unionByName(terms), "accepted")
    return changes.provenance(accepted.select("target_type", "title", "body").distinct(), accepted)


def artifact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Every manual's last paragraph as an artifact."""
    chunks = segment.paragraphs(tables.manuals(spark, d))
    last = chunks.groupBy("source_filename").agg(F.max_by("text", "para_idx").alias("content")).withColumnRenamed("source_filename", "file_name")
    return changes.duplicate_artifacts(last)


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Log lines ``time kind key=value ...`` made of events."""
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    line = F.concat(at, F.lit(" "), "event_type", F.lit(" user="), F.col("user_id").cast("string"), F.lit(" id="), F.col("event_id").cast("string"))
    return tables.table(spark, d, "events").select("event_id", "ts", line.alias("line"))


def log_parse(spark: SparkSession, d: str) -> DataFrame:
    """Log lines read back into fields."""
    parsed = changes.log_fields(_log(spark, d))
    return parsed.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last_at"), F.countDistinct(F.col("fields")["user"]).alias("n_users"), F.max(F.col("fields")["id"].cast("long")).alias("last_id"))


def recent_activity(spark: SparkSession, d: str) -> DataFrame:
    """The last 24 of the last 40 log lines, newest first, each with a summary."""
    order = [F.desc("ts"), F.desc("event_id")]
    tail = _log(spark, d).orderBy(*order).limit(40).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # forty rows
    return changes.log_fields(tail).where("place <= 24").select(F.col("place").cast("long").alias("place"), "at", "kind", "summary")


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return scan.event_counts(tables.table(spark, d, "events"))


def stream_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents read as a stream of files into a scan state; one row per source with what the state knows of it."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    state = scan.ScanState(spark, f"{base}/state")
    schema = tables.table(spark, d, "documents").schema
    name = F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    scan.scan_stream(spark, f"{d}/documents*.parquet", schema, state, f"{base}/checkpoint", name).awaitTermination()
    return state.current().groupBy(F.split("source_path", "/")[2].alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.countDistinct("checksum").alias("n_texts"))


def corpus_source(spark: SparkSession, d: str) -> DataFrame:
    """The pages as files, a folder each, read again through the data source; its listing takes the filters over."""
    spark.dataSource.register(CorpusFiles)
    base = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    pages = tables.table(spark, d, "pages").where("html is not null").select("page_id", "html")
    pages.repartition("page_id").sortWithinPartitions("page_id").foreachPartition(written_folders(local(base), "page_id"))
    with settings(spark, {"spark.sql.python.filterPushdown.enabled": "true"}):
        rows = spark.read.format("corpus_files").option("pushFilters", "true").option("partitionBytes", str(8 << 20)).load(base).where("document_type = 'txt' and corpus <> ''")
        return shared_table(rows.select(F.regexp_extract("corpus", "page_id=([0-9]+)", 1).cast("long").alias("page_id"), "length", "checksum", "method"), "read_files")


def table_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences by the table function, from Spark SQL."""
    table_functions.register(spark)
    tables.documents(spark, d).select("doc_id", "raw_text").createOrReplaceTempView("scriptoria_documents")
    rows = spark.sql("select doc_id, sentence_idx, sentence from corpus_sentences(TABLE(scriptoria_documents))")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.expr(text.words("sentence"))).alias("n_words"), F.max(F.length("sentence")).cast("long").alias("longest"), F.min_by("sentence", "sentence_idx").alias("first_sentence"))


def table_headings(spark: SparkSession, d: str) -> DataFrame:
    """Sections by the table function, over paragraphs as rows in any order."""
    table_functions.register(spark)
    rows = segment.paragraphs(tables.manuals(spark, d), heading=segment.SECTION_HEADING, start=None)
    rows.select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), "text").createOrReplaceTempView("scriptoria_paragraphs")
    return spark.sql(f"select doc_id, para_idx, section from corpus_headings(TABLE(scriptoria_paragraphs), {SPARK.text(segment.SECTION_HEADING)})")


def _sights(spark: SparkSession, d: str) -> DataFrame:
    """Each document up to three times: as it was, an hour later with the same text, two days later with another."""
    docs = tables.documents(spark, d).select("doc_id", "source_path", F.coalesce("raw_text", F.lit("")).alias("t"))
    rows = docs.withColumn("round", F.explode(F.expr("sequence(0, cast(pmod(doc_id, 3) as int))")))
    checksum = F.sha2(F.concat("t", F.when(F.col("round") == 2, "!").otherwise("")), 256)
    modified = F.timestamp_micros(F.expr("(1704067200 + case round when 0 then 0 when 1 then 3600 else 172800 end + pmod(doc_id, 1000)) * 1000000L"))
    return rows.select("doc_id", "round", "source_path", checksum.alias("checksum"), modified.alias("modified"))


def stream_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Revised documents in a stream whose files come out of order, through the keyed state: per source what is known in the end."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    arrival = F.pmod(F.xxhash64("doc_id", "round"), F.lit(4))  # one folder after the other, the rounds of a document in any order
    sights = shared_table(_sights(spark, d).withColumn("arrival", arrival), "sights")  # texts are read and hashed once, by all tasks
    for number in range(4):
        sights.where(F.col("arrival") == number).select("source_path", "checksum", "modified").coalesce(2).write.mode("append").parquet(f"{base}/in")
    with settings(spark, keyed.PROVIDER):
        sights = spark.readStream.schema("source_path string, checksum string, modified timestamp").option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
        changes_ = keyed.changes_stream(sights)
        changes_.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    known = keyed.current(spark.read.schema(keyed.CHANGE).parquet(f"{base}/out"))
    return known.groupBy(F.split("source_path", "/")[2].alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.countDistinct("checksum").alias("n_texts"), F.min("checksum").alias("first_checksum"))


def stage_progress(spark: SparkSession, d: str) -> DataFrame:
    """Rows that went through each stage of a compile, counted while it ran."""
    stages = progress.Stages()
    chunks = stages.watch("chunks", segment.knowledge_chunks(stages.watch("documents", tables.manuals(spark, d))))
    found = stages.watch("candidates", detect.facts(chunks))
    stages.watch("accepted", found.where("rejection_reason is null")).write.format("noop").mode("overwrite").save()
    return stages.table(spark)


def _committed(spark: SparkSession, d: str) -> CommittedTable:
    """Three versions of the fingerprints: nine documents in ten, then revised and withdrawn ones, then all the rest."""
    table = CommittedTable(spark, f"{shared_dir(spark)}/committed-{uuid.uuid4().hex}", "doc_id long, checksum string")
    marks = tables.documents(spark, d).select("doc_id", F.sha2(F.coalesce("raw_text", F.lit("")), 256).alias("checksum"))
    none = marks.select("doc_id").limit(0)
    table.merge(marks.where("pmod(doc_id, 10) <> 0"), none, "doc_id")
    revised = marks.where("pmod(doc_id, 10) <> 0 and pmod(doc_id, 7) = 0 and pmod(doc_id, 11) <> 0").withColumn("checksum", F.lit("revised"))
    table.merge(revised, marks.where("pmod(doc_id, 11) = 0").select("doc_id"), "doc_id")
    table.merge(marks.where("pmod(doc_id, 10) = 0"), none, "doc_id")
    return table


def state_changes(spark: SparkSession, d: str) -> DataFrame:
    """What changed between versions of a committed table, document by document."""
    table = _committed(spark, d)
    feed = table.changes(1, 2, "doc_id").withColumn("version", F.lit(2)).unionByName(table.changes(2, 3, "doc_id").withColumn("version", F.lit(3)))
    return feed.select("version", "change", "doc_id", "checksum")


def state_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The table as of its second version."""
    return _committed(spark, d).as_of(2)


def package_files(spark: SparkSession, d: str) -> DataFrame:
    """The files of the manuals' knowledge package, with size and digest."""
    return package.artifacts(tables.manuals(spark, d)).select("file_name", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("digest"))


def debug_files(spark: SparkSession, d: str) -> DataFrame:
    """The manuals' debug files, with size and digest."""
    return package.debug_files(tables.manuals(spark, d)).select("file_name", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("digest"))


QUERIES: dict[str, Query] = {
    "reference_facts": reference_facts,
    "word_count_by_source": word_count_by_source,
    "sentence_split": sentence_split,
    "doc_date_detect": doc_date_detect,
    "canonical_name": canonical_name,
    "doc_profile_ratios": doc_profile_ratios,
    "quality_flags": quality_flags,
    "infer_domain_kind": infer_domain_kind,
    "type_counts": type_counts,
    "workload_forecast": workload_forecast,
    "paragraph_chunks": paragraph_chunks,
    "heading_fill": heading_fill,
    "chunk_flags": chunk_flags,
    "pack_chunks": pack_chunks,
    "preview_units": preview_units,
    "definitions": _records(detect.definition_records),
    "requirements": _text_records(detect.requirement_records),
    "warnings": _records(detect.warning_records),
    "parts": _text_records(detect.part_records),
    "specs": _text_records(detect.spec_records),
    "procedure_steps": _records(detect.step_records),
    "table_lines": _records(detect.table_records),
    "glossary": glossary,
    "glossary_rejected": glossary_rejected,
    "corpus_glossary": corpus_glossary,
    "procedures": procedures,
    "procedures_rejected": procedures_rejected,
    "facts": facts,
    "facts_rejected": facts_rejected,
    "manual_reference_facts": manual_reference_facts,
    "topics": topics,
    "topic_groups": topic_groups,
    "topic_selection": topic_selection,
    "topic_pages": topic_pages,
    "topic_terms": topic_terms,
    "entities": entities,
    "entities_by_type": entities_by_type,
    "warning_sentences": warning_sentences,
    "summaries": summaries,
    "clean_text": clean_text,
    "page_text": page_text,
    "repeated_edge_lines": repeated_edge_lines,
    "html_title": html_title,
    "html_text": html_text,
    "cell_text": cell_text,
    "json_status": json_status,
    "exact_duplicates": exact_duplicates,
    "near_duplicates": near_duplicates,
    "review_queue": review_queue,
    "review_priority": review_priority,
    "review_counts": review_counts,
    "retry_targets": retry_targets,
    "export_eligible": export_eligible,
    "diagnostics": diagnostics,
    "folder_candidates": folder_candidates,
    "workspace_summary": workspace_summary,
    "changed_docs": changed_docs,
    "docs_to_process": docs_to_process,
    "removed_docs": removed_docs,
    "provenance": provenance,
    "artifact_duplicates": artifact_duplicates,
    "log_parse": log_parse,
    "event_windows": event_windows,
    "stream_scan": stream_scan,
    "corpus_source": corpus_source,
    "table_sentences": table_sentences,
    "table_headings": table_headings,
    "stream_revisions": stream_revisions,
    "stage_progress": stage_progress,
    "state_changes": state_changes,
    "state_as_of": state_as_of,
    "review_sorted": review_sorted,
    "review_filters": review_filters,
    "review_actions": review_actions,
    "review_overrides": review_overrides,
    "fallback_points": fallback_points,
    "enriched": enriched,
    "enrichment_to_ask": enrichment_to_ask,
    "quality_report": quality_report,
    "glossary_order": glossary_order,
    "procedures_order": procedures_order,
    "topics_order": topics_order,
    "record_columns": record_columns,
    "line_diffs": line_diffs,
    "line_alignments": line_alignments,
    "line_rebuilds": line_rebuilds,
    "path_rules": path_rules,
    "rendered_markdown": rendered_markdown,
    "corpus_names": corpus_names,
    "canonical_parts": canonical_parts,
    "low_quality_pages": low_quality_pages,
    "degraded_documents": degraded_documents,
    "scan_report": scan_report,
    "recent_issues": recent_issues,
    "batch_summary": batch_summary,
    "promoted_duplicates": promoted_duplicates,
    "recent_activity": recent_activity,
    "package_files": package_files,
    "debug_files": debug_files,
}
