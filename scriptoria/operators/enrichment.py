"""Titles, taxonomy and hints for documents: a rule for all of them, a cache, and a place for a model's answers.

No model is called here. A caller who has one writes its answers to the cache; what the cache lacks gets the rule's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import profile

#: Confidence of the rule's answers, lengths of titles, topics and lists.
RULE_CONFIDENCE, TITLE_CHARS, TOPIC_CHARS, POINTS, HINTS, NOTES = 0.55, 80, 60, 3, 8, 4


def safe_confidence(value: Column, fallback: float) -> Column:
    """A number between 0 and 1; what is no number gets the fallback."""
    number = value.try_cast("double")  # greatest and least pass over nulls
    return F.when(number.isNull(), F.lit(fallback)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def distinct_texts(values: Column, most: int) -> Column:
    """The first ``most`` different texts that are not blank, stripped, in their order."""
    return F.slice(F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda x: x != "")), 1, most)


def cache_key(checksum: Column, provider: str, model: str, prompt_version: str) -> Column:
    return F.sha2(F.concat_ws("|", checksum, F.lit(provider), F.lit(model), F.lit(prompt_version)), 256)


def to_ask(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """Documents (doc_id, cache_key) that the cache (cache_key) has no answer for; of equal keys the smallest id asks."""
    fresh = keys.join(cache.select("cache_key"), "cache_key", "left_anti")
    return fresh.groupBy("cache_key").agg(F.min("doc_id").alias("doc_id"))


def by_rule(corpus: DataFrame, summaries: DataFrame, glossary: DataFrame, topics: DataFrame, warnings: DataFrame) -> DataFrame:
    """doc_id, clean_title, domain, topic, synopsis, glossary_hints, review_notes, confidence.

    ``summaries`` has (doc_id, rank, point), ``glossary`` the best terms (doc_id, chunk_index, line_no, term, score),
    ``topics`` accepted candidates (doc_id, chunk_index, topic_label, score), ``warnings`` (doc_id, rank, sentence).
    """
    listed = lambda rows, order, value, most: rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order, value.alias("v")))).alias("x")).select("doc_id", F.transform(F.slice("x", 1, most), lambda s: s["v"]).alias("x"))
    points = listed(summaries.where(F.col("rank") <= POINTS), [F.col("rank")], F.col("point"), POINTS).withColumnRenamed("x", "points")
    terms = listed(glossary, [(-F.col("score")).alias("s"), F.lower("term").alias("t")], F.col("term"), HINTS).withColumnRenamed("x", "terms")  # terms of one document
    label = topics.groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "chunk_index", "topic_label")).alias("top")).select("doc_id", F.col("top.topic_label").alias("label"))
    notes = listed(warnings.where(F.col("rank") <= NOTES), [F.col("rank")], F.col("sentence"), NOTES).withColumnRenamed("x", "notes")
    rows = corpus.select("doc_id", "title", profile.project_domain(corpus).alias("domain"))
    for side in (points, terms, label, notes):
        rows = rows.join(side, "doc_id", "left")
    none = F.expr("cast(array() as array<string>)")
    first = F.get("points", F.lit(0))
    title = F.coalesce(F.regexp_replace(F.substring(first, 1, TITLE_CHARS), "[.]+$", ""), F.trim("title"))
    topic = F.coalesce(F.substring("label", 1, TOPIC_CHARS), F.substring(F.get("terms", F.lit(0)), 1, TOPIC_CHARS), F.lit("general"))
    return rows.select("doc_id", title.alias("clean_title"), "domain", topic.alias("topic"), F.trim(F.array_join(F.coalesce("points", none), " ")).alias("synopsis"), F.coalesce("terms", none).alias("glossary_hints"), F.coalesce("notes", none).alias("review_notes"), F.lit(RULE_CONFIDENCE).alias("confidence"))


def enriched(ruled: DataFrame, keys: DataFrame, cache: DataFrame) -> DataFrame:
    """``ruled`` with a model's title, domain, topic and confidence where the cache (cache_key, clean_title, domain, topic, confidence) has them."""
    own = keys.select("doc_id", "cache_key").join(cache.select("cache_key", *[F.col(c).alias(f"model_{c}") for c in ("clean_title", "domain", "topic", "confidence")]), "cache_key", "left")
    rows = ruled.join(own, "doc_id", "left")
    answered = F.col("model_clean_title").isNotNull()
    out = {c: F.coalesce(F.nullif(F.trim(f"model_{c}"), F.lit("")), F.col(c)) for c in ("clean_title", "domain", "topic")}
    confidence = F.when(answered, safe_confidence(F.col("model_confidence"), RULE_CONFIDENCE)).otherwise(F.col("confidence"))
    return rows.withColumns(out | {"confidence": confidence, "mode": F.when(answered, "model").otherwise("deterministic")}).drop("cache_key", "model_clean_title", "model_domain", "model_topic", "model_confidence")


def fallback_points(summaries: DataFrame, facts: DataFrame, warnings: DataFrame, most: int = 5) -> DataFrame:
    """doc_id, place, point: summary points, then three facts, then two warnings, each once, of four words at least, the first ``most``.

    ``facts`` has (doc_id, rank, text), in their order within the document.
    """
    from ..functions import rules, text

    part = lambda rows, n, value: rows.select("doc_id", F.lit(n).alias("part"), F.col("rank"), F.col(value).alias("value"))
    rows = part(summaries, 0, "point").unionByName(part(facts.where("rank <= 3"), 1, "text")).unionByName(part(warnings.where("rank <= 2"), 2, "sentence"))
    rows = rows.withColumn("lines", F.expr(text.lines("value"))).withColumn("clean", F.expr(rules.promotion_text("lines"))).withColumn("bare", F.expr(rules.bare("clean")))
    rows = rows.where((F.col("clean") != "") & ~F.expr(rules.admin_at_least("value", "lines", 50)) & ~F.expr(rules.admin_heading("bare")) & (F.expr(text.words("clean")) >= 4))
    rows = rows.withColumn("key", F.expr(text.slug("clean", 220))).groupBy("doc_id", "key").agg(F.min(F.struct("part", "rank", "clean")).alias("f"))
    points = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("f")).alias("fs"))  # at most eleven a document
    return points.select("doc_id", F.posexplode(F.slice("fs", 1, most)).alias("place", "f")).select("doc_id", (F.col("place") + 1).cast("long").alias("place"), F.col("f.clean").alias("point"))
