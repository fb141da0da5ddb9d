"""Best candidate per key, corpus-wide tables of facts, terms, procedures, entities and topics, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text


def accepted(candidates: DataFrame) -> DataFrame:
    return candidates.where("rejection_reason is null")


def rejected(candidates: DataFrame) -> DataFrame:
    return candidates.where("rejection_reason is not null")


def best_per_key(candidates: DataFrame, key: Column, place: list[str], by: list[str]) -> DataFrame:
    """The candidate with the highest score of each (``by``, key); of equal scores the first."""
    rows = candidates.withColumn("normalized_key", key)
    columns = [c for c in rows.columns if c not in ("normalized_key", *by)]
    top = F.min(F.struct((-F.col("score")).alias("_neg"), *[F.col(c).alias(f"_{c}") for c in place], F.struct(*columns).alias("row"))).alias("top")
    return rows.groupBy(*by, "normalized_key").agg(top).select(*by, "normalized_key", *[F.col(f"top.row.{c}").alias(c) for c in columns])


def document_glossary(candidates: DataFrame) -> DataFrame:
    return best_per_key(accepted(candidates), F.expr(text.slug("term", 100)), ["chunk_index", "line_no"], ["doc_id"])


def document_facts(candidates: DataFrame) -> DataFrame:
    return best_per_key(accepted(candidates), F.expr(text.slug("body", 220)), ["chunk_index", "sentence_idx"], ["doc_id"])


def corpus_glossary(candidates: DataFrame) -> DataFrame:
    """term, definition, source_filename: the first document's best definition of each exact term."""
    rows = document_glossary(candidates)
    first = F.min(F.struct("doc_id", (-F.col("score")).alias("s"), "body", "source_filename")).alias("f")
    return rows.groupBy("term").agg(first, F.countDistinct("doc_id").alias("n_docs")).select("term", F.col("f.body").alias("definition"), F.col("f.source_filename").alias("source_filename"), "n_docs")


def reference_facts(candidates: DataFrame, most: int = 120) -> DataFrame:
    """category, rank, text, score, n_sources, sources: facts that differ only in case or spacing are one; ``most`` a category.

    The first ranks are found within map tasks before anything is shuffled by category.
    """
    rows = document_facts(candidates).withColumn("key", F.lower(F.expr(text.squeezed("body"))))
    merged = rows.groupBy("category", "key").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("doc_id"), "body")).alias("best"), F.max("score").alias("score"), F.array_sort(F.collect_set("source_filename")).alias("sources"))
    merged = merged.select("category", F.col("best.body").alias("text"), "score", F.size("sources").cast("long").alias("n_sources"), "sources")
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n_sources"), F.desc("score"), F.lower("text"), "text"))
    return merged.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)


def corpus_procedures(candidates: DataFrame) -> DataFrame:
    """Distinct (title without case, steps) with the first source and the best score."""
    rows = accepted(candidates).withColumn("steps_text", F.array_join("steps", "\n")).withColumn("key", F.lower("title"))
    first = F.min(F.struct("doc_id", "chunk_index", "title", "source_filename")).alias("f")
    return rows.groupBy("key", "steps_text").agg(first, F.max("score").alias("score"), F.count(F.lit(1)).alias("n_found")).select(F.col("f.title").alias("title"), "steps_text", F.col("f.source_filename").alias("source_filename"), "score", "n_found")


def entities_by_type(entities: DataFrame) -> DataFrame:
    """entity_type, value, n_docs and the first source of each entity of the corpus."""
    first = F.min(F.struct("doc_id", "place", "value", "source_filename")).alias("f")
    return entities.groupBy("entity_type", "normalized_key").agg(first, F.countDistinct("doc_id").alias("n_docs")).select("entity_type", F.col("f.value").alias("value"), F.col("f.source_filename").alias("source_filename"), "n_docs")


def topic_groups(candidates: DataFrame) -> DataFrame:
    """topic_key, label, n_candidates, n_sources, group_score (thousandths): the order of topics in a package."""
    rows = accepted(candidates)
    grouped = rows.groupBy("topic_key").agg(F.min(F.struct("doc_id", "chunk_index", "topic_label")).alias("f"), F.count(F.lit(1)).alias("n_candidates"), F.countDistinct("source_filename").alias("n_sources"), F.sum("score").alias("total"))
    return grouped.select("topic_key", F.col("f.topic_label").alias("label"), "n_candidates", "n_sources", (F.col("total") + 250 * F.col("n_sources")).alias("group_score"))


def selected_topics(candidates: DataFrame, most: int = 5) -> DataFrame:
    """Of each topic ``most`` candidates: one per source in order of rank, then the rest in that order."""
    rows = accepted(candidates)
    order = [F.desc("score"), F.lower("source_filename"), "doc_id", "chunk_index"]
    rows = rows.withColumn("in_source", F.row_number().over(Window.partitionBy("topic_key", "source_filename").orderBy(*order))).where(F.col("in_source") <= most)
    pick = F.row_number().over(Window.partitionBy("topic_key").orderBy(F.when(F.col("in_source") == 1, 0).otherwise(1), *order))
    return rows.withColumn("pick", pick.cast("long")).where(F.col("pick") <= most).select("topic_key", "topic_label", "doc_id", "source_filename", "chunk_index", "score", "body", "pick")


def condensed(body: Column) -> Column:
    return F.when(F.length(body) > 320, F.concat(F.rtrim(F.substring(body, 1, 317)), F.lit("..."))).otherwise(body)


def topic_sections(candidates: DataFrame, most: int = 5) -> DataFrame:
    """topic_key, label, group_score, section: a Markdown section of each topic."""
    rows = selected_topics(candidates, most).withColumn("bullet", condensed(F.col("body"))).withColumn("n", F.expr(text.words("bullet"))).where("n >= 6").withColumn("key", F.expr(text.slug("bullet", 220)))
    first = rows.groupBy("topic_key", "key").agg(F.min(F.struct("pick", "bullet")).alias("b"))
    bullets = first.groupBy("topic_key").agg(F.array_sort(F.collect_list("b")).alias("bs"))  # at most ``most`` rows a topic
    sources = rows.groupBy("topic_key").agg(F.array_join(F.array_sort(F.collect_set("source_filename")), ", ").alias("sources"))
    joined = topic_groups(candidates).join(bullets, "topic_key").join(sources, "topic_key")
    section = F.concat(F.lit("## "), "label", F.lit("\n\n"), F.array_join(F.transform("bs", lambda b: F.concat(F.lit("- "), b["bullet"])), "\n"), F.lit("\n\nSources: "), "sources")
    return joined.select("topic_key", "label", "group_score", "n_candidates", section.alias("section"))


def topic_terms(corpus: DataFrame, words: Column, most: int = 3) -> DataFrame:
    """doc_id, rank, term, n: a document's most frequent topic words, by count, length, spelling; found inside the row."""
    from .detect import with_ranked_words

    rows = with_ranked_words(corpus, words, "terms", most, counts=True, keep=rules.topic_word)
    return rows.select("doc_id", F.posexplode("terms").alias("place", "t")).select("doc_id", F.col("t.term").alias("term"), F.col("t.n").alias("n"), (F.col("place") + 1).cast("long").alias("rank"))


def summaries(chunks: DataFrame, most: int = 6) -> DataFrame:
    """doc_id, rank, point: headings that are no titles and lead sentences of 8 to 35 words, each once, the first ``most``."""
    rows = chunks.withColumn("flat", F.translate("text", "\n", " ")).withColumn("lead", F.expr(f"element_at({text.sentences('flat')}, 1)")).withColumn("n", F.expr(text.words("lead")))
    heading = F.when((F.col("heading") != "") & (F.col("heading") != F.col("title")), F.col("heading"))
    lead = F.when(F.col("n").between(8, 35), F.col("lead"))
    points = rows.select("doc_id", "chunk_index", F.posexplode(F.array_compact(F.array(heading, lead))).alias("sub", "point"))
    # points are gathered chunk by chunk until there are enough, and only then made distinct
    before = F.count(F.lit(1)).over(Window.partitionBy("doc_id").orderBy("chunk_index").rangeBetween(Window.unboundedPreceding, -1))
    taken = points.withColumn("before", before).where(F.col("before") < most).withColumn("key", F.expr(text.slug("point", 220)))
    first = taken.groupBy("doc_id", "key").agg(F.min(F.struct("chunk_index", "sub", "point")).alias("f"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("f.chunk_index", "f.sub"))
    return first.select("doc_id", rank.cast("long").alias("rank"), F.col("f.point").alias("point")).where(F.col("rank") <= most)
