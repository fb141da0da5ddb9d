"""A project workspace: scan folders, keep state and a review queue, export a package.

State tables are committed version by version (:mod:`.commits`): two writers lose nothing, a scan writes only the buckets
of documents that it changes, a line of the log is a row that is added.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import changes, detect, duplicates, profile, reports, review, segment
from ..shared import shared_table
from ..sources import extract
from . import package
from .commits import CommittedTable

DOCUMENT = "doc_id string, source_path string, source_filename string, source_folder_name string, document_type string, checksum string, extraction_status string, quality double, title string, raw_text string, strategy string"

LINES, EXPORT, CANONICAL = "n long, line string", "n long, exported_at string, folder string, n_files long", "source_path string, canonical string"
REVIEW = "doc_id string, source_path string, review_id string, kind string, severity string, title string, detail string, confidence double, suggestion string, status string, override_title string, override_domain string, resolution_note string"


class Project:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        tables = {"documents": DOCUMENT, "reviews": REVIEW, "exports": EXPORT, "canonicals": CANONICAL, "log": LINES}
        self.documents, self.reviews, self.exports, self.canonicals, self.lines = (CommittedTable(spark, f"{folder.rstrip('/')}/{t}", schema) for t, schema in tables.items())

    def log(self, kind: str, **fields: object) -> None:
        """Add a line to the workspace's log."""
        line = F.concat_ws(" ", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(kind), *[F.lit(f"{k}={v}") for k, v in fields.items()])
        fresh = self.spark.range(1).select(F.lit(self.lines.version() + 1).cast("long").alias("n"), line.alias("line"))
        self.lines.append(fresh)

    def history(self, most: int = 24, of: int = 40) -> DataFrame:
        """The last lines of the log, newest last, with their fields and a summary."""
        tail = self.lines.read().orderBy(F.desc("n")).limit(of).orderBy(F.desc("n")).limit(most)
        return changes.log_fields(tail).orderBy("n")

    def scan(self, source: str | list[str], force: bool = False, only: list[str] | None = None, strategy: str = "default", include: list[str] | None = None, exclude: list[str] | None = None, since: str | None = None) -> DataFrame:
        """Scan folders; returns (change, n): added, changed, removed, unchanged. ``only`` makes it a targeted rescan.

        ``since`` (a timestamp) leaves alone the files that are older: they stay in the state as they are.
        """
        files = extract.listing(self.spark, source, supported_only=False)
        if include:
            files = files.where(changes.glob(F.col("relative_path"), include))
        if exclude:
            files = files.where(~changes.glob(F.col("relative_path"), exclude))
        if only is not None:
            files = files.where(F.col("path").isin(only))
        state = self.documents.read()
        marks = files.select(F.col("path").alias("source_path"), F.coalesce(F.sha2(F.when(F.col("length") <= extract.MOST_BYTES, F.col("content")), 256), F.lit("")).alias("checksum"))
        marks = shared_table(marks, "marks")
        todo = changes.to_process(marks, state, force)
        if since is not None:
            late = files.where(F.col("modificationTime") >= F.lit(since).cast("timestamp")).select(F.col("path").alias("source_path"))
            todo = todo.join(late, "source_path", "left_semi")
        fresh = extract.extracted(files.join(todo.select(F.col("source_path").alias("path")), "path", "left_semi"), strategy)
        rows = fresh.select(F.substring(F.coalesce("checksum", F.sha2("path", 256)), 1, 16).alias("doc_id"), F.col("path").alias("source_path"), F.element_at(F.split("path", "/"), -1).alias("source_filename"), F.element_at(F.split("path", "/"), -2).alias("source_folder_name"), "document_type", F.coalesce("checksum", F.lit("")).alias("checksum"), F.col("status").alias("extraction_status"), "quality", "title", F.col("text").alias("raw_text"), "strategy")
        rows = shared_table(rows, "fresh")
        gone = state.select("source_path")
        gone = shared_table(gone.join(marks.select("source_path"), "source_path", "left_anti") if only is None else gone.limit(0), "gone")
        counts = changes.classified(marks, state).groupBy("change").agg(F.count(F.lit(1)).alias("n"))
        counts = shared_table(counts if only is None else counts.where("change <> 'removed'"), "counts")
        self.documents.merge(rows, gone, "source_path")
        self.refresh_reviews()
        self.log("scan", files=marks.count())
        return counts

    def rows(self) -> DataFrame:
        """Document rows with what the review rules read."""
        docs = self.documents.read()
        copies = duplicates.near_duplicate_groups(docs, "raw_text", preferred=self.canonicals.read())
        domain = docs.select("source_path", profile.project_domain(docs).alias("probable_domain"))
        words = F.coalesce(F.expr(text.words("raw_text")), F.lit(0))
        chunks = segment.knowledge_chunks(docs.where("raw_text is not null").withColumn("doc_id", F.xxhash64("source_path")))
        found = reports.unified_candidates(detect.glossary(chunks), detect.procedures(chunks), detect.facts(chunks), detect.topics(chunks))
        items = found.where("rejection_reason is null").groupBy(F.col("doc_id").alias("key")).agg(F.count(F.lit(1)).alias("n_items"))
        rows = docs.withColumn("word_count", words).withColumn("ocr_used", F.lit(False)).withColumn("key", F.xxhash64("source_path"))
        rows = rows.join(items, "key", "left").withColumn("knowledge_item_count", F.coalesce("n_items", F.lit(0))).drop("key", "n_items")
        return rows.join(domain, "source_path").join(copies.select("source_path", "duplicate_of"), "source_path", "left")

    def queue(self) -> DataFrame:
        return self.reviews.read()

    def refresh_reviews(self) -> None:
        rows = shared_table(self.rows().drop("raw_text"), "rows")
        self.reviews.update(lambda old: review.review_queue(rows, old).select(*old.columns))

    def review(self, step) -> DataFrame:
        """Apply a change such as ``review.approve_all`` to the queue; returns its counts."""
        self.reviews.update(step)
        return review.review_counts(self.queue())

    def update(self, review_id: str, status: str | None = None, title: str | None = None, domain: str | None = None, note: str | None = None) -> DataFrame:
        """Edit one item; null leaves a field as it is. What it overrides shows in ``current`` and in the next export."""
        if self.queue().where(F.col("review_id") == review_id).isEmpty():
            raise ValueError(f"no review item {review_id}")
        edit = self.spark.createDataFrame([(review_id, status, title, domain, note)], "review_id string, status string, override_title string, override_domain string, resolution_note string")
        counts = self.review(lambda queue: review.updated(queue, edit))
        self.log("review_update", review_id=review_id, status=status or "")
        return counts

    def current(self) -> DataFrame:
        """Documents with titles and domains as the reviews leave them."""
        docs = self.documents.read()
        return review.with_overrides(docs.withColumn("probable_domain", profile.project_domain(docs)), self.queue())

    def retry(self, source: str | list[str], strategy: str = "default", kinds: tuple[str, ...] = ("extraction_issue",), document_types: tuple[str, ...] = ()) -> DataFrame:
        """Read again, with a strategy, the documents of open items of these kinds."""
        targets = review.retry_targets(self.queue(), self.documents.read(), kinds, document_types)
        paths = [r["source_path"] for r in targets.select("source_path").collect()]  # what a reviewer picked
        return self.scan(source, force=True, only=paths, strategy=strategy)

    def promote(self, review_id: str) -> None:
        """Make the document of a duplicate item the canonical one of its group."""
        item = self.queue().where(F.col("review_id") == review_id).select("kind", "source_path", "doc_id").first()
        if item is None or item["kind"] != "duplicate":
            raise ValueError(f"no duplicate item {review_id}")
        groups = duplicates.near_duplicate_groups(self.documents.read(), "raw_text", preferred=self.canonicals.read())
        members = groups.select("source_path", "duplicate_of").unionByName(groups.select(F.col("duplicate_of").alias("source_path"), "duplicate_of").distinct())
        group = members.where(F.col("source_path") == item["source_path"]).select("duplicate_of")
        votes = members.join(group, "duplicate_of", "left_semi").select("source_path", F.lit(item["source_path"]).alias("canonical"))
        votes = shared_table(votes, "votes")
        self.canonicals.update(lambda old: old.join(votes.select("source_path"), "source_path", "left_anti").unionByName(votes))
        self.refresh_reviews()
        self.log("duplicate_promote", canonical=item["source_path"])

    def diagnostics(self, folder: str) -> dict:
        """Metrics, degraded documents and open reviews as JSON and Markdown files; what is listed is what a reviewer has to see."""
        rows, queue = shared_table(self.rows().drop("raw_text"), "rows"), self.queue()
        metrics = {r["metric"]: r["n"] for r in review.diagnostics(rows, queue).collect()}
        bad = [r.asDict() for r in reports.degraded_documents(rows).orderBy("source_path").toLocalIterator()]
        open_items = [r.asDict() for r in review.in_order(queue.where("status = 'open'"), rows).select("review_id", "source_path", "kind", "severity", "title").toLocalIterator()]
        out = Path(folder)
        out.mkdir(parents=True, exist_ok=True)
        found = {"corpus_metrics": metrics, "degraded_documents": bad, "open_reviews": open_items}
        (out / "diagnostics.json").write_text(json.dumps(found, indent=2, ensure_ascii=False), encoding="utf-8")
        name = lambda path: path.rpartition("/")[2]
        parts = [
            ("Corpus Metrics", [f"{k.replace('_', ' ')}: {v}" for k, v in sorted(metrics.items())]),
            ("Degraded Documents", [f"`{name(x['source_path'])}` [{x['status']}] {x['reason']}" for x in bad]),
            ("Open Reviews", [f"`{name(x['source_path'])}` [{x['severity']}] {x['kind']}: {x['title']}" for x in open_items]),
        ]
        body = "\n\n".join(f"## {title}\n\n" + "\n".join(f"- {line}" for line in lines or ["None"]) for title, lines in parts)
        (out / "diagnostics.md").write_text(f"# Corpus Diagnostics\n\n{body}\n", encoding="utf-8")
        self.log("diagnostics", folder=folder)
        return found

    def validation(self) -> DataFrame:
        """(message): what stands against an export."""
        docs, queue = self.documents.read(), self.queue()
        said = lambda rows, rule, words: rows.agg(F.count_if(rule).alias("n")).where("n > 0").select(F.concat(F.col("n").cast("string"), F.lit(f" {words}")).alias("message"))
        out = said(docs, F.col("extraction_status").isin("failed", "unsupported"), "documents could not be read")
        out = out.unionByName(said(docs, F.coalesce(F.trim("raw_text"), F.lit("")) == "", "documents without text"))
        out = out.unionByName(said(queue, (F.col("status") == "open") & (F.col("severity") == "high"), "open reviews of high severity"))
        return out.unionByName(docs.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("no documents: scan first").alias("message")))

    def export(self, folder: str, zipped: bool = False) -> tuple[list[str], list[str]]:
        """Write the package of all eligible documents, under their overridden titles: (files, validation messages)."""
        queue = self.queue()
        docs = review.export_eligible(self.current(), queue)
        found = shared_table(package.artifacts(docs.withColumn("doc_id", F.xxhash64("source_path"))), "artifacts")
        messages = [r["message"] for r in package.validation(found, queue).collect()]  # about the package's few files
        files = package.write(found, folder, zipped=zipped)
        history = self.spark.range(1).select(F.lit(self.exports.version() + 1).cast("long").alias("n"), F.current_timestamp().cast("string").alias("exported_at"), F.lit(folder).alias("folder"), F.lit(len(files)).cast("long").alias("n_files"))
        self.exports.append(history)
        self.log("export", package=folder)
        return files, sorted(messages)

    def latest_export(self) -> str | None:
        """The folder of the newest export."""
        return self.exports.read().agg(F.max_by("folder", "n")).first()[0]


def compile_batch(spark: SparkSession, root: str, out: str, only: list[str] | None = None, zipped: bool = False) -> DataFrame:
    """Compile every child folder of ``root`` into a package of its own; the summary has a row for each folder.

    A folder that fails does not stop the others; loose files in the root are left alone.
    """
    files = shared_table(extract.extracted(extract.listing(spark, root).where("corpus <> ''")), "files")
    docs = files.select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("source_path"), F.element_at(F.split("path", "/"), -1).alias("source_filename"), F.col("corpus").alias("source_folder_name"), "document_type", "title", F.col("text").alias("raw_text"), F.col("status").alias("extraction_status"), F.coalesce(F.expr(text.words("text")), F.lit(0)).alias("word_count"))
    names = sorted(r[0] for r in docs.select("source_folder_name").distinct().collect())  # child folders
    chosen = [n for n in names if only is None or n in only]
    errors = []
    for name in chosen:
        try:
            found = package.artifacts(docs.where((F.col("source_folder_name") == name) & (F.col("word_count") > 0)))
            package.write(found, f"{out}/{name}", name, zipped)
        except Exception as e:  # the folder's row says so
            errors.append((name, f"{type(e).__name__}: {e}"[:500]))
    summary = reports.batch_summary(docs, spark.createDataFrame([(n,) for n in chosen], "corpus string"))
    failed = spark.createDataFrame(errors, "corpus string, error string")
    return summary.join(failed, "corpus", "left").withColumn("status", F.when(F.col("error").isNotNull(), "FAILED").otherwise(F.col("status"))).orderBy("corpus")
