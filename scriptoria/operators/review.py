"""The review workflow: document rows with status, the queue of issues, its order, reports, updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Fixed values.
LOW_SIGNAL_WORDS, LOW_CONFIDENCE = 80, 0.6
STATUSES = ("open", "accepted", "rejected")
#: What a reviewer sees first, by status, extraction status, kind and severity; kinds as the rules find them.
STATUS_ORDER, EXTRACTION_ORDER = ("open", "resolved", "accepted", "rejected"), ("failed", "unsupported", "partial", "metadata_only", "success")
KIND_ORDER, SEVERITY_ORDER = ("empty", "extraction_issue", "duplicate", "ocr", "ai_low_confidence", "taxonomy", "low_signal"), ("critical", "high", "medium", "low")
QUEUE_KINDS = ("duplicate", "extraction_issue", "empty", "ocr", "low_signal", "taxonomy", "ai_low_confidence")
#: Named filter -> statuses, kinds; an empty one lets all pass.
FILTERS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "All": ((), ()),
    "Open": (("open",), ()),
    "Accepted": (("accepted",), ()),
    "Rejected": (("rejected",), ()),
    "Extraction Issues": ((), ("extraction_issue", "empty")),
    "Duplicates": ((), ("duplicate",)),
    "Taxonomy": ((), ("taxonomy",)),
    "Low Confidence OCR": ((), ("ocr",)),
    "Low Signal": ((), ("low_signal",)),
    "AI Low Confidence": ((), ("ai_low_confidence",)),
}
SORTS = ("priority", "file", "kind", "severity", "status")
SUGGESTIONS = {
    "duplicate": "Keep one canonical copy and reject the others.",
    "extraction_issue": "Retry with another strategy or repair the source.",
    "empty": "Check the source; nothing could be read from it.",
    "ocr": "Compare the recognised text with the page images.",
    "low_signal": "Merge with a related document or leave out.",
    "taxonomy": "Assign a domain by hand.",
    "ai_low_confidence": "Confirm title and domain by hand.",
}


def document_rows(corpus: DataFrame, profiled: DataFrame, duplicates: DataFrame, n_items: DataFrame) -> DataFrame:
    """One row per document with what the queue's rules read.

    ``duplicates`` has source_path and duplicate_of, ``n_items`` doc_id and knowledge_item_count.
    """
    words = F.coalesce(F.expr(text.words("raw_text")), F.lit(0))
    status = F.when(F.col("raw_text").isNull(), "failed").when((words > 0) & (words < 25), "partial").otherwise("success")
    rows = corpus.select("doc_id", "source_path", "source_filename", "source_folder_name", "document_type", words.alias("word_count"), status.alias("extraction_status"), F.lit(False).alias("ocr_used"))
    rows = rows.join(profiled, "doc_id", "left").join(duplicates.select("source_path", "duplicate_of"), "source_path", "left")
    return rows.join(n_items, "doc_id", "left").withColumn("knowledge_item_count", F.coalesce("knowledge_item_count", F.lit(0)))


def _issue(rule: Column, kind: str, severity: Column | str, title: str, detail: Column, confidence: Column | float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(rule, F.struct(F.lit(kind).alias("kind"), as_col(severity).alias("severity"), F.lit(title).alias("title"), detail.alias("detail"), as_col(confidence).cast("double").alias("confidence")))


def review_queue(docs: DataFrame, previous: DataFrame | None = None, low_signal_words: int = LOW_SIGNAL_WORDS) -> DataFrame:
    """One row per document and issue; status, overrides and notes carry over from ``previous`` by path and kind."""
    status, words = F.col("extraction_status"), F.col("word_count")
    base = F.element_at(F.split("duplicate_of", "/"), -1)
    reason = F.concat(F.lit("Extraction status: "), status)
    # only a model's answers can be unsure; documents without such a column were never asked about
    asked = [_issue(F.col("ai_confidence") < LOW_CONFIDENCE, "ai_low_confidence", "medium", "Enrichment confidence is low", F.lit("A model was unsure of title and domain"), F.col("ai_confidence"))] if "ai_confidence" in docs.columns else []
    issues = F.array_compact(F.array(
        _issue(F.col("duplicate_of").isNotNull(), "duplicate", "high", "Possible duplicate document", F.concat(F.lit("Near-duplicate of "), base), 0.3),
        _issue(status.isin("failed", "unsupported", "metadata_only", "partial"), "extraction_issue", F.when(status.isin("failed", "unsupported"), "high").otherwise("medium"), "Extraction requires review", reason, F.when(status == "partial", 0.35).otherwise(0.2)),
        _issue((words == 0) & ~status.isin("unsupported", "metadata_only"), "empty", "high", "Document produced no usable knowledge", reason, 0.15),
        _issue(F.col("ocr_used"), "ocr", "medium", "OCR-backed extraction used", F.lit("Text was recognised from images"), 0.5),
        _issue((words > 0) & (words < low_signal_words) & ~status.isin("unsupported", "metadata_only", "failed"), "low_signal", "medium", "Low-signal document", F.concat(words.cast("string"), F.lit(" words remained")), 0.45),
        _issue((F.col("probable_domain") == "general") & (F.col("knowledge_item_count") <= 1) & (words > 0), "taxonomy", "low", "Weak classification signal", F.lit("No domain found"), 0.5),
        *asked,
    ))
    suggestion = F.element_at(F.create_map(*[F.lit(x) for kv in SUGGESTIONS.items() for x in kv]), F.col("kind"))
    queue = docs.select("doc_id", "source_path", F.explode(issues).alias("i")).select("doc_id", "source_path", F.concat(F.col("doc_id").cast("string"), F.lit("::"), "i.kind").alias("review_id"), "i.*").withColumn("suggestion", suggestion)
    if previous is None:
        return queue.withColumns({"status": F.lit("open"), "override_title": F.lit(""), "override_domain": F.lit(""), "resolution_note": F.lit("")})
    kept = previous.select("source_path", "kind", "status", "override_title", "override_domain", "resolution_note")
    out = queue.join(kept, ["source_path", "kind"], "left")
    return out.withColumns({"status": F.coalesce("status", F.lit("open"))} | {c: F.coalesce(c, F.lit("")) for c in ("override_title", "override_domain", "resolution_note")})


def rank(column: str, order: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(F.col(column) == v, i) for i, v in enumerate(order)], F.lit(9))


def _file() -> Column:
    return F.lower(F.element_at(F.split("source_path", "/"), -1))


def sort_key(by: str = "priority") -> list[Column]:
    """What a queue with its documents' ``extraction_status`` is sorted by, in one of five ways."""
    if by == "file":
        return [_file()]
    if by == "kind":
        return [F.col("kind")]
    if by == "severity":
        return [rank("severity", SEVERITY_ORDER)]
    if by == "status":
        return [rank("status", STATUS_ORDER)]
    return [rank("status", STATUS_ORDER), rank("extraction_status", EXTRACTION_ORDER), rank("kind", KIND_ORDER), rank("severity", SEVERITY_ORDER), _file()]


def in_order(queue: DataFrame, docs: DataFrame, by: str = "priority", descending: bool = False) -> DataFrame:
    """The queue with its documents' extraction status, sorted; what ties stands by path and kind."""
    rows = queue.join(docs.select("source_path", F.col("extraction_status")), "source_path", "left").withColumn("extraction_status", F.coalesce("extraction_status", F.lit("success")))
    keys = [c.desc() if descending else c.asc() for c in sort_key(by)]
    return rows.orderBy(*keys, "source_path", rank("kind", QUEUE_KINDS))


def passes(name: str) -> Column:
    """One of the ten named filters over the queue."""
    statuses, kinds = FILTERS[name]
    rule = F.lit(True)
    if statuses:
        rule = rule & F.col("status").isin(*statuses)
    if kinds:
        rule = rule & F.col("kind").isin(*kinds)
    return rule


def filter_counts(queue: DataFrame) -> DataFrame:
    """filter, n: how many items each named filter shows."""
    hits = F.array(*[F.when(passes(name), F.lit(name)) for name in FILTERS])
    return queue.select(F.explode(F.array_compact(hits)).alias("filter")).groupBy("filter").agg(F.count(F.lit(1)).alias("n"))


def action() -> Column:
    """What a reviewer is told to do, by kind and the document's extraction status."""
    kind, status = F.col("kind"), F.col("extraction_status")
    return (
        F.when(kind.isin("extraction_issue", "empty") | status.isin("failed", "unsupported"), "retry_then_ignore").when(kind == "duplicate", "keep_stronger_copy").when(kind == "taxonomy", "override_then_accept")
        .when(kind.isin("ocr", "ai_low_confidence"), "inspect_then_accept_or_retry").when(kind == "low_signal", "keep_if_useful").otherwise("accept_or_ignore")
    )


def tags() -> Column:
    """Marks of a row: severity, decision, extraction."""
    return F.array_compact(F.array(
        F.when(F.col("severity").isin("critical", "high"), "sev_high").when(F.col("severity") == "medium", "sev_medium"),
        F.when(F.col("status") == "accepted", "status_accepted").when(F.col("status") == "rejected", "status_rejected"),
        F.when(F.col("kind").isin("extraction_issue", "empty"), "kind_extraction"),
    ))


def with_overrides(docs: DataFrame, queue: DataFrame) -> DataFrame:
    """``docs`` (with title, probable_domain) as the reviews leave them: title and domain overridden, review_status added.

    Of several overrides of one document that of the last review_id counts. A domain becomes a short name of letters.
    """
    given = lambda c: F.max(F.when(F.trim(c) != "", F.struct("review_id", F.trim(c).alias("v"))))
    per_doc = queue.groupBy("source_path").agg(given("override_title").alias("t"), given("override_domain").alias("d"), F.count_if(F.col("status") == "rejected").alias("n_rejected"), F.count_if(F.col("status") == "open").alias("n_open"))
    rows = docs.join(per_doc, "source_path", "left").withColumn("_domain", F.col("d.v"))
    state = F.when(F.col("n_rejected") > 0, "rejected").when(F.col("n_open") > 0, "flagged").otherwise("clean")
    domain = F.when(F.col("_domain").isNotNull(), F.replace(F.expr(text.slug("_domain", 40)), F.lit("-"), F.lit("_"))).otherwise(F.col("probable_domain"))
    return rows.withColumns({"title": F.coalesce("t.v", "title"), "probable_domain": domain, "review_status": state}).drop("t", "d", "n_rejected", "n_open", "_domain")


def approve_all(queue: DataFrame) -> DataFrame:
    return queue.withColumn("status", F.when(F.col("status") == "open", "accepted").otherwise(F.col("status")))


def reject_duplicates(queue: DataFrame) -> DataFrame:
    return queue.withColumn("status", F.when((F.col("status") == "open") & (F.col("kind") == "duplicate"), "rejected").otherwise(F.col("status")))


def updated(queue: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` (review_id, status, override_title, override_domain, resolution_note): null leaves a field as it is."""
    fields = ["status", "override_title", "override_domain", "resolution_note"]
    new = changes.select("review_id", *[F.col(c).alias(f"new_{c}") for c in fields])
    return queue.join(new, "review_id", "left").withColumns({c: F.coalesce(f"new_{c}", c) for c in fields}).drop(*[f"new_{c}" for c in fields])


def review_counts(queue: DataFrame) -> DataFrame:
    return queue.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count(F.lit(1)).alias("total"))


def retry_targets(queue: DataFrame, docs: DataFrame, kinds: tuple[str, ...] = ("extraction_issue",), document_types: tuple[str, ...] = (), status: str = "open") -> DataFrame:
    """Distinct paths of queue items that a filtered retry runs again."""
    rows = queue.where((F.col("status") == status) & F.col("kind").isin(*kinds)).join(docs.select("source_path", "document_type", "extraction_status"), "source_path")
    if document_types:
        rows = rows.where(F.col("document_type").isin(*document_types))
    return rows.select("source_path", "document_type", "extraction_status").distinct()


def export_eligible(docs: DataFrame, queue: DataFrame) -> DataFrame:
    """Documents that are readable and that no reviewer rejected; rejection is read from the queue itself."""
    refused = queue.where("status = 'rejected'").select("source_path").distinct()
    return docs.where(~F.col("extraction_status").isin("failed", "unsupported", "metadata_only")).join(refused, "source_path", "left_anti")


def diagnostics(docs: DataFrame, queue: DataFrame) -> DataFrame:
    """metric, n: documents by status, duplicates, open reviews."""
    per_doc = docs.agg(F.count(F.lit(1)).alias("documents"), *[F.count_if(F.col("extraction_status") == s).alias(s) for s in ("success", "partial", "failed", "unsupported", "metadata_only")], F.count_if(F.col("duplicate_of").isNotNull()).alias("duplicates"))
    names = per_doc.columns
    long = per_doc.select(F.expr(f"stack({len(names)}, {', '.join(f'{n!r}, {n}' for n in names)}) as (metric, n)"))
    return long.unionByName(queue.agg(F.count_if(F.col("status") == "open").alias("n")).select(F.lit("open_reviews").alias("metric"), "n"))


def folder_candidates(docs: DataFrame) -> DataFrame:
    """Folders with degraded documents: how many, how many failed, of how many."""
    bad = F.col("extraction_status") != "success"
    rows = docs.groupBy("source_folder_name").agg(F.count_if(bad).alias("n_degraded"), F.count_if(F.col("extraction_status") == "failed").alias("n_failed"), F.count(F.lit(1)).alias("n_docs"))
    return rows.where("n_degraded > 0")


def workspace_summary(docs: DataFrame, queue: DataFrame) -> DataFrame:
    """One row: counts and the two state labels of a workspace."""
    d = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("word_count").alias("n_words"), F.count_if(F.col("extraction_status") != "success").alias("n_degraded"), F.count_if(F.col("duplicate_of").isNotNull()).alias("n_duplicates"))
    q = queue.agg(F.count_if(F.col("status") == "open").alias("n_open"), F.count_if((F.col("status") == "open") & (F.col("severity") == "high")).alias("n_high"))
    health = F.when(F.col("n_docs") == 0, "empty").when(F.col("n_high") > 0, "needs_review").when(F.col("n_degraded") > 0, "degraded").otherwise("healthy")
    ready = F.when(F.col("n_docs") == 0, "nothing_to_export").when(F.col("n_high") > 0, "blocked").when(F.col("n_open") > 0, "review_recommended").otherwise("ready")
    return d.join(F.broadcast(q)).select("*", health.alias("corpus_health"), ready.alias("export_state"))  # one row each
