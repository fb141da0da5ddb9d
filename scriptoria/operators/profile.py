"""Document profiles: shares of noise, headings, tables and repeats, quality score and flags, domain and kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.dialect import SPARK, Dialect

#: Fixed values.
NOISE = r"[^\p{L}\p{N}_ \t\n\r\f.,;:()\[\]/#%+-]"
TABLE_HINT = r"[ \t]\|[ \t]|,{2,}|\t"
NUMBERED_HEADING = r"^[0-9]+(?:\.[0-9]+){0,4}[ \t]+[A-Z]"
DOMAINS = (("telecommunications", "telecommunications fiber cabling tower".split()), ("safety", "safety osha hazard warning".split()), ("operations", "installation maintenance manual".split()))
PROJECT_DOMAINS = (("policy", "policy compliance contract legal agreement".split()), ("training", "training course lesson quiz exercise".split()), ("product", "product release feature roadmap requirements".split()), ("operations", "procedure installer sop workflow maintenance".split()))
PART_WORD = r"(?i)(?:^|[^A-Za-z0-9_])(?:PN|P/N|Part(?:[ \t]+No[.]?)?|Model|SKU)[ \t]*[:#-]?[ \t]*[A-Z0-9][A-Z0-9._/-]{2,}"


def heading_line(x: str, d: Dialect = SPARK) -> str:
    return f"(length({x}) <= 120 and ({d.has(x, '^#')} or {d.has(x, NUMBERED_HEADING)} or ({text.is_upper(x)} and {text.tokens(x, d)} <= 12)))"


def measures(x: str, ls: str, d: Dialect = SPARK) -> dict[str, str]:
    """SQL of the counts behind every share; ``ls`` is the column of the text's stripped non-blank lines."""
    return {
        "n_chars": f"cast(length({x}) as bigint)",
        "n_words": f"greatest({text.words(x, d)}, 1)",
        "n_lines": d.size(ls),
        "line_chars": f"cast(length({d.join(ls, d.text(''))}) as bigint)",
        "n_unprintable": text.unprintable(x, d),
        "n_noise": d.count(x, NOISE),
        "n_breaks": d.count(x, r"\n\n"),
        "n_headings": d.size(d.keep(ls, "l", heading_line("l", d))),
        "n_table_lines": d.size(d.keep(ls, "l", d.has("l", TABLE_HINT))),
        "n_distinct_lines": d.size(d.distinct(ls)),
        "n_requirements": d.count(x, r"(?i)shall|must|required|prohibited"),
        "n_warnings": d.count(x, r"(?i)warning|caution|danger|note"),
        "n_parts": d.count(x, PART_WORD),
    }


def score_sql() -> str:
    """The extraction quality as a double, from the measures; the same arithmetic in both engines."""
    chars, lines = "greatest(n_chars, 1)", "greatest(n_lines, 1)"
    return (
        "greatest(0.05e0, least(0.99e0, 1e0"
        f" - least(cast(n_noise as double) / {chars} * 2.5e0, 0.35e0)"
        f" - least((1e0 - case when n_chars = 0 then 0e0 else cast(n_chars - n_unprintable as double) / {chars} end) * 0.5e0, 0.25e0)"
        f" - least(cast(n_breaks as double) / {lines} * 0.15e0, 0.15e0)"
        f" - least(case when n_lines = 0 then 0e0 else 1e0 - cast(n_distinct_lines as double) / {lines} end * 0.35e0, 0.2e0)"
        f" - case when line_chars < 18 * {lines} then 0.1e0 else 0e0 end"
        " + case when n_headings >= 3 then 0.05e0 else 0e0 end))"
    )


#: Flag -> rule over the measures.
FLAGS = {
    "low_printable_ratio": "n_chars - n_unprintable < 0.95 * n_chars or n_chars = 0",
    "high_symbol_noise": "n_noise > 0.08 * greatest(n_chars, 1)",
    "short_broken_lines": "line_chars < 18 * greatest(n_lines, 1)",
    "weak_heading_structure": "n_headings = 0",
    "duplicate_blocks_detected": "n_lines - n_distinct_lines > 0.2 * greatest(n_lines, 1)",
}


def first_label(x: str, cascade: tuple[tuple[str, list[str]], ...], d: Dialect = SPARK) -> str:
    """The first label one of whose words is a part of the text."""
    cases = " ".join(f"when {' or '.join(d.has_text(x, d.text(w)) for w in words)} then '{label}'" for label, words in cascade)
    return f"case {cases} else 'general' end"


def document_kind(x: str, doc_type: str, d: Dialect = SPARK) -> str:
    has = lambda w: d.has_text(x, d.text(w))
    return (
        f"case when {doc_type} = 'pptx' then 'presentation' when {doc_type} in ('csv', 'xlsx') then 'spreadsheet' when {has('table of contents')} and {has('shall')} then 'standard'"
        f" when {has('manual')} then 'manual' when {has('catalog')} or {has('part number')} then 'catalog' when {has('specification')} then 'specification'"
        f" when {has('warning')} or {has('caution')} or {has('danger')} then 'safety_document' else 'document' end"
    )


def profiles(corpus: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """The measures of each document, with score (thousandths), flags, domain and kind."""
    rows = corpus.withColumn("_t", F.coalesce(F.col(text_col), F.lit(""))).withColumn("_ls", F.expr(text.lines("_t"))).withColumn("_low", F.lower("_t"))
    rows = rows.withColumns({k: F.expr(v) for k, v in measures("_t", "_ls").items()})
    flags = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in FLAGS.items()]))
    rows = rows.withColumn("quality_score", F.expr(f"cast(floor({score_sql()} * 1000 + 0.5e0) as bigint)")).withColumn("quality_flags", flags)
    rows = rows.withColumn("probable_domain", F.expr(first_label("_low", DOMAINS))).withColumn("document_kind", F.expr(document_kind("_low", "document_type")))
    rows = rows.withColumn("mostly_tabular", (F.col("n_table_lines") > 0.2 * F.greatest("n_lines", F.lit(1))) | F.col("document_type").isin("csv", "xlsx"))
    return rows.drop("_t", "_ls", "_low")


def project_domain(corpus: DataFrame, text_col: str = "raw_text") -> Column:
    """Over path, title and the first 600 characters of the text, as the project workspace reads them."""
    return F.expr(first_label(f"concat(source_path, ' ', lower(title), ' ', lower(substr({text_col}, 1, 600)))", PROJECT_DOMAINS))


def workload(files: DataFrame) -> DataFrame:
    """One row per folder of a listing (source_folder_name, document_type, size_bytes): counts, bytes, heavy files, class."""
    heavy = F.count_if(F.col("size_bytes") >= 5 * 1024 * 1024)
    ocr = F.count_if(F.col("document_type").isin("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp"))
    out = files.groupBy("source_folder_name").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").cast("long").alias("size_bytes"), heavy.alias("n_heavy"), ocr.alias("n_ocr"))
    label = F.when((F.col("n_files") >= 250) | (F.col("n_heavy") >= 15), "heavy").when((F.col("n_files") >= 50) | (F.col("n_heavy") >= 3) | (F.col("n_ocr") > 0), "moderate").otherwise("light")
    return out.withColumn("workload", label)
