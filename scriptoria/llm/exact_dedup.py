"""Exact dedup by skew-safe combining.

Texts are equal when identical after each run of white space becomes one space; of equal texts the row with the
smallest id stays. Three stages, each grouping by the digest *and* the full normalised text, so content is compared
in full every time: within a map task (partial aggregation), within a salt, then over the salt winners. The salt is
the input split's number, so a text of which a third of all rows are copies leaves each task as one row and meets
only ``salts`` rows at last.

Defined results: null text counts as empty; rows of one id and one text are one document and fare alike (they have
one verdict each, and ``keep_first`` leaves one of them); a null id never wins over another and two null ids count
as one; an empty table gives an empty result; other columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, fresh_name, shared_table


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row (digest, keep_id, group_size) for each distinct text; ``text`` is set only where digests collide."""
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text")).select("id", "text", F.sha2("text", 256).alias("digest"), (F.spark_partition_id() % salts).alias("salt"))
    salted = rows.groupBy("digest", "salt", "text").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    merged = salted.groupBy("digest", "text").agg(F.min("id").alias("id"), F.sum("n").alias("n"))
    by_digest = shared_table(merged.groupBy("digest").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("n_texts")), "digests")
    clean = by_digest.where("n_texts = 1").select("digest", "keep_id", "group_size", F.lit(None).cast("string").alias("text"))
    clashing = by_digest.where("n_texts > 1").select("digest")
    if clashing.isEmpty():
        return clean
    texts = merged.join(clashing, "digest", "left_semi").select("digest", F.col("id").alias("keep_id"), F.col("n").alias("group_size"), "text")
    return clean.unionByName(shared_table(texts, "clashes"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    found = winners(docs, id_col, text_col, salts)
    rows = docs.select(F.col(id_col).alias("_id"), F.sha2(normalised(F.col(text_col)), 256).alias("digest"), normalised(F.col(text_col)).alias("_text"))
    clashes = found.where("text is not null")
    if clashes.isEmpty():
        rows, found, same = rows.drop("_text"), found.drop("text"), ["digest"]
        joined = rows.join(found, same)
    else:
        r, w = rows.alias("r"), found.alias("w")
        joined = r.join(w, F.expr("r.digest = w.digest and (w.text is null or w.text = r._text)")).select("r._id", "r.digest", "w.keep_id", "w.group_size")
    return joined.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they are."""
    digest, taken = fresh_name(docs.columns, "digest"), fresh_name(docs.columns, "taken_id")
    text = fresh_name(docs.columns, "winner_text")
    found = winners(docs, id_col, text_col, salts).select(F.col("digest").alias(digest), F.col("keep_id").alias(taken), F.col("text").alias(text))
    rows = docs.withColumn(digest, F.sha2(normalised(F.col(text_col)), 256))
    if found.where(F.col(text).isNotNull()).isEmpty():
        rule = (rows[digest] == found[digest]) & rows[id_col].eqNullSafe(found[taken])
    else:
        rule = (rows[digest] == found[digest]) & rows[id_col].eqNullSafe(found[taken]) & (found[text].isNull() | (found[text] == normalised(rows[text_col])))
    return rows.join(found, rule, "left_semi").dropDuplicates([digest, id_col]).select(*docs.columns)
