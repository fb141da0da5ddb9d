"""Reports over documents, review items and candidates: scan report, recent issues, degraded documents, quality, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import review

#: How many issues a scan report lists, which statuses count as degraded.
RECENT_ISSUES, DEGRADED = 12, ("partial", "failed", "metadata_only", "unsupported")


def reason(docs: DataFrame) -> Column:
    """The first warning, else the failure, else the status, as far as ``docs`` has these columns."""
    known = [F.get("warnings", F.lit(0))] if "warnings" in docs.columns else []
    known += [F.nullif(F.trim("failure"), F.lit(""))] if "failure" in docs.columns else []
    return F.coalesce(*known, F.concat(F.lit("Extraction finished with status "), "extraction_status", F.lit(".")))


def _name(path: str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def degraded_documents(docs: DataFrame) -> DataFrame:
    """source_path, status, reason, document_type, duplicate_of of documents that are not whole or double another."""
    rows = docs.where((F.col("extraction_status") != "success") | F.col("duplicate_of").isNotNull())
    return rows.select("source_path", F.col("extraction_status").alias("status"), reason(docs).alias("reason"), "document_type", F.coalesce("duplicate_of", F.lit("")).alias("duplicate_of"))


def scan_report(docs: DataFrame, queue: DataFrame) -> DataFrame:
    """metric, n: documents by type and by degraded status, duplicates, open reviews."""
    types = docs.groupBy(F.concat(F.lit("type:"), F.coalesce("document_type", F.lit("unknown"))).alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    names = ["documents", *(f"{s}_docs" for s in DEGRADED), "duplicates"]
    counts = docs.agg(F.count(F.lit(1)), *[F.count_if(F.col("extraction_status") == s) for s in DEGRADED], F.count("duplicate_of")).toDF(*names)
    long = counts.select(F.expr(f"stack({len(names)}, {', '.join(f'{n!r}, {n}' for n in names)}) as (metric, n)"))
    return types.unionByName(long).unionByName(queue.agg(F.count_if(F.col("status") == "open").alias("n")).select(F.lit("open_reviews").alias("metric"), "n"))


def recent_issues(docs: DataFrame, queue: DataFrame, most: int = RECENT_ISSUES) -> DataFrame:
    """place, source_path, status, reason: degraded documents and duplicates by path, then open reviews, the first ``most``."""
    bad = F.col("extraction_status").isin(*DEGRADED)
    why = F.when(bad, reason(docs)).otherwise(F.concat(F.lit("Near-duplicate of "), _name("duplicate_of"), F.lit(".")))
    first = docs.where(bad | F.col("duplicate_of").isNotNull()).select(F.lit(0).alias("part"), "source_path", F.lit(0).alias("k"), F.when(bad, F.col("extraction_status")).otherwise("duplicate").alias("status"), why.alias("reason"))
    rest = queue.where("status = 'open'").select(F.lit(1).alias("part"), "source_path", review.rank("kind", review.QUEUE_KINDS).alias("k"), F.col("kind").alias("status"), F.col("title").alias("reason"))
    order = ["part", "source_path", "k"]
    top = first.unionByName(rest).orderBy(*order).limit(most)
    return top.agg(F.array_sort(F.collect_list(F.struct(*order, "status", "reason"))).alias("i")).select(F.posexplode("i").alias("place", "i")).select((F.col("place") + 1).cast("long").alias("place"), "i.source_path", "i.status", "i.reason")  # ``most`` rows


def unified_candidates(glossary: DataFrame, procedures: DataFrame, facts: DataFrame, topics: DataFrame) -> DataFrame:
    """target_type, title, body, normalized_key, score, rejection_reason, doc_id, chunk_id of all four kinds."""
    kind = lambda rows, name, title, body, key: rows.select(F.lit(name).alias("target_type"), title.alias("title"), body.alias("body"), F.concat(F.lit(f"{name}::"), key).alias("normalized_key"), "score", "rejection_reason", "doc_id", "chunk_id")
    return (
        kind(glossary, "glossary", F.col("term"), F.col("body"), F.expr(text.slug("term", 100)))
        .unionByName(kind(procedures, "procedures", F.col("title"), F.array_join("steps", "\n"), F.lower("title")))
        .unionByName(kind(facts, "reference_facts", F.col("category"), F.col("body"), F.expr(text.slug("body", 220))))
        .unionByName(kind(topics, "knowledge_core", F.col("topic_label"), F.col("body"), F.col("topic_key")))
    )


def quality_report(candidates: DataFrame, docs: DataFrame, n_chunks: DataFrame) -> DataFrame:
    """One row of counters, and the share (thousandths) of accepted candidates whose key another has; ``n_chunks`` is one row."""
    ok = F.col("rejection_reason").isNull()
    kept = [F.count_if(ok & (F.col("target_type") == t)).alias(f"{t}_kept") for t in ("glossary", "procedures", "reference_facts", "knowledge_core")]
    a = candidates.agg(*kept, F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), F.countDistinct(F.when(ok, F.col("normalized_key"))).alias("n_keys"))
    d = docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.coalesce(F.trim("raw_text"), F.lit("")) == "").alias("empty_documents"))
    share = F.when(F.col("accepted") > 0, F.floor((F.col("accepted") - F.col("n_keys")) * 1000 / F.col("accepted") + 0.5)).otherwise(0).cast("long")
    return a.join(F.broadcast(d)).join(F.broadcast(n_chunks)).withColumn("dedupe_thousandths", share).drop("n_keys")  # one row each


def batch_summary(docs: DataFrame, selected: DataFrame) -> DataFrame:
    """corpus, status, processed, contributed, failed of every folder; ``selected`` (corpus) names those that were to run."""
    failed = F.col("extraction_status").isin("failed", "unsupported")
    rows = docs.groupBy(F.col("source_folder_name").alias("corpus")).agg(F.count(F.lit(1)).alias("processed"), F.count_if((F.col("word_count") > 0) & ~failed).alias("contributed"), F.count_if(failed).alias("failed"))
    rows = rows.join(selected.select("corpus", F.lit(True).alias("chosen")), "corpus", "left")
    status = F.when(F.col("chosen").isNull(), "SKIPPED").when(F.col("contributed") > 0, "SUCCESS").otherwise("FAILED")
    count = lambda c: F.when(F.col("chosen").isNull(), F.lit(0).cast("long")).otherwise(F.col(c)).alias(c)
    return rows.select("corpus", status.alias("status"), *[count(c) for c in ("processed", "contributed", "failed")])


def low_quality_page(shown: Column, image_heavy: Column) -> Column:
    """Blank, or of images mostly, with less than 40 characters or few letters among them."""
    letters = F.regexp_count(shown, F.lit(r"\p{L}"))
    n = F.length(F.trim(shown))
    return (n == 0) | (image_heavy & ((n < 40) | (letters < F.greatest(F.lit(10.0), n * 0.2))))


def rendered_markdown(docs: DataFrame, purpose: str, topic: Column, date: Column) -> DataFrame:
    """doc_id and content: a document as Markdown with its metadata in front."""
    spaces = lambda x: F.trim(F.regexp_replace(x, text.SPACE + "+", " "))
    title = F.coalesce(F.nullif(spaces(F.translate("title", "-_", "  ")), F.lit("")), F.lit("Knowledge File"))
    lines = F.regexp_replace(F.regexp_replace(F.coalesce("raw_text", F.lit("")), r"\r\n?", "\n"), r"[ \t\f]+(\n|$)", "$1")
    body = F.expr(text.stripped("_body"))
    head = F.concat(F.lit("# "), title, F.lit("\n\n## Metadata\n\n- Source file: "), "source_filename", F.lit("\n- Source path: "), "source_path", F.lit("\n- Document type: "), "document_type", F.lit(f"\n- Knowledge set: {purpose}\n- Topic: "), topic, F.when(date != "nodate", F.concat(F.lit("\n- Document date: "), date)).otherwise(""))
    rows = docs.withColumn("_body", F.regexp_replace(lines, r"\n{3,}", "\n\n"))
    return rows.select("doc_id", F.concat(head, F.lit("\n\n## Content\n\n"), body, F.lit("\n")).alias("content"))
