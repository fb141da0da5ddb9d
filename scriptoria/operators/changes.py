"""What changed between a stored state and a new scan, and small joins over listings."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprints(corpus: DataFrame, text_col: str = "raw_text") -> DataFrame:
    return corpus.select("source_path", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("checksum"))


def to_process(scan: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """Rows of the scan whose (path, checksum) the state lacks; all of them under ``force``."""
    return scan if force else scan.join(state.select("source_path", "checksum"), ["source_path", "checksum"], "left_anti")


def removed(scan: DataFrame, state: DataFrame) -> DataFrame:
    return state.join(scan.select("source_path"), "source_path", "left_anti")


def classified(scan: DataFrame, state: DataFrame) -> DataFrame:
    """source_path and change: added, removed, changed or unchanged."""
    new, old = scan.select("source_path", F.col("checksum").alias("new")), state.select("source_path", F.col("checksum").alias("old"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged")
    return new.join(old, "source_path", "full").select("source_path", change.alias("change"))


def upserted(state: DataFrame, scan: DataFrame, full_scan: bool = True) -> DataFrame:
    """The state after a scan: scanned paths as scanned; of the rest, what a partial scan did not look at."""
    rest = state.join(scan.select("source_path"), "source_path", "left_anti")
    return scan if full_scan else scan.unionByName(rest)


def glob(path: Column, patterns: list[str]) -> Column:
    """One of the shell patterns fits: a star also crosses slashes, and **/x fits x at the top."""
    plain = [p for pattern in patterns for p in ([pattern, pattern[3:]] if pattern.startswith("**/") else [pattern])]
    rule = F.lit(False)
    for p in dict.fromkeys(plain):
        rule = rule | path.rlike(fnmatch.translate(p).replace(r"\Z", r"\z"))
    return rule


def first_rule(path: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first (pattern, label) whose pattern fits."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(glob(path, [pattern]), F.lit(label)).otherwise(out)
    return out


def provenance(promoted: DataFrame, accepted: DataFrame) -> DataFrame:
    """Promoted items (target_type, body) with the accepted candidates of the same type and trimmed body."""
    where = accepted.select("target_type", F.trim("body").alias("key"), "doc_id", "chunk_id")
    rows = promoted.withColumn("key", F.trim("body")).join(where, ["target_type", "key"], "left")
    return rows.groupBy("target_type", "title", "body").agg(F.count("chunk_id").alias("n_places"), F.countDistinct("doc_id").alias("n_docs"), F.min("chunk_id").alias("first_chunk"))


def log_fields(lines: DataFrame) -> DataFrame:
    """``lines`` (line) with at, kind, detail, fields and a summary: ``time kind key=value key=value``; a value ends where the next key begins."""
    x = F.trim("line")
    parsed = lines.withColumns({"at": F.regexp_extract(x, r"^([^ ]+) ", 1), "kind": F.regexp_extract(x, r"^[^ ]+ ([^ ]+)", 1), "detail": F.trim(F.regexp_extract(x, r"^[^ ]+ [^ ]+ (.*)$", 1))})
    keys = F.regexp_extract_all("detail", F.lit(r"([A-Za-z0-9_]+)="), F.lit(1))
    values = F.transform(F.split("detail", r"(?:^|[^A-Za-z0-9_])[A-Za-z0-9_]+="), lambda v: F.trim(v))
    pairs = F.zip_with(keys, F.slice(values, 2, F.size(values)), lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    # of a key that stands twice the last value counts
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    parsed = parsed.withColumn("fields", F.map_from_entries(last))
    field = lambda name: F.coalesce(F.try_element_at("fields", F.lit(name)), F.lit(""))
    file = lambda name, none: F.coalesce(F.nullif(F.element_at(F.split(field(name), "/"), -1), F.lit("")), F.lit(none))
    kind = F.col("kind")
    summary = (
        F.when(kind == "scan", F.concat(F.lit("Scan run: "), "detail")).when(kind == "review_update", F.concat(F.lit("Review updated: "), field("review_id"), F.lit(" -> "), field("status")))
        .when(kind == "duplicate_promote", F.concat(F.lit("Duplicate canonical changed: "), file("canonical", "unknown"))).when(kind == "export", F.concat(F.lit("Export completed: "), file("package", "package")))
        .otherwise(F.coalesce(F.nullif("detail", F.lit("")), kind))
    )
    unknown = ~x.contains(" ")
    return parsed.withColumns({"at": F.when(unknown, "").otherwise(F.col("at")), "kind": F.when(unknown, "unknown").otherwise(kind), "summary": F.when(unknown, x).otherwise(summary)})


def kept_outputs(outputs: DataFrame, valid: DataFrame) -> DataFrame:
    """Derived outputs (source_path, ...) whose document is still there; the rest is to be deleted."""
    return outputs.join(valid.select("source_path"), "source_path", "left_semi")


def duplicate_artifacts(artifacts: DataFrame) -> DataFrame:
    """Artifacts (file_name, content) whose content an artifact with a smaller name has already."""
    first = artifacts.groupBy(F.sha2("content", 256).alias("digest")).agg(F.min("file_name").alias("first_name"), F.count(F.lit(1)).alias("n"))
    rows = artifacts.withColumn("digest", F.sha2("content", 256)).join(first.where("n > 1"), "digest")
    return rows.where("file_name <> first_name").select("file_name", "first_name")
