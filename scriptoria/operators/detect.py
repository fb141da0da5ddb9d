"""Candidates: glossary terms, procedures, facts, topics, entities, and the structured records of the chunk engine.

Accepted and rejected candidates come in one table; a candidate is accepted if its rejection_reason is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..functions.dialect import SPARK
from ..functions.quick import quick
from .settle import settled

#: Acceptance thresholds in thousandths.
GLOSSARY_LEAST, PROCEDURE_LEAST, FACT_LEAST, TOPIC_LEAST = 450, 500, 450, 400
#: Patterns of entities and of the chunk engine's records.
STANDARD = r"(?:^|[^A-Za-z0-9_])((?:ANSI|TIA|OSHA|BICSI|IEEE|NEC|NFPA|ISO|IEC)(?:[A-Z0-9/.-]*[A-Z0-9])?)(?:$|[^A-Za-z0-9_])"
ORGANIZATION = r"(?:^|[^A-Za-z0-9_])(OpenAI|Microsoft|Google|Amazon|TowerCo|American National Standards Institute)(?:$|[^A-Za-z0-9_])"
PART_ID = r"(?i)(?:^|[^A-Za-z0-9_])(?:PN|P/N|Part(?:[ \t]+No[.]?)?|Model|SKU)[ \t]*[:#-]?[ \t]*([A-Z0-9](?:[A-Z0-9._/-]*[A-Z0-9_])[A-Z0-9_]|[A-Z0-9][A-Z0-9._/-][A-Z0-9_])"
NAMED_TITLE = r"^(?:#[ \t]+)?([A-Z][A-Za-z0-9 ,/&()_-]{5,120})$"
DEFINITION = r"(?i)^([A-Z][A-Za-z0-9 /()-]{2,60})[ \t]+(?:means|is defined as)[ \t]+(.+)$"
WARNING = r"(?i)^(warning|caution|danger|note)[ \t]*[:-]?[ \t]*(.+)$"
SPEC = r"(?:^|[^A-Za-z0-9_])([A-Z][A-Za-z0-9 /()-]{2,40}?)[ \t]*[:=][ \t]*([-+]?[0-9]+(?:\.[0-9]+)?)[ \t]*([A-Za-z%/.-]{0,11}[A-Za-z]|)(?:$|[^A-Za-z0-9_])"
#: What each part and each measured value holds, tried first: the whole patterns look at most places of a text.
PART_MARK, SPEC_MARK = r"(?i)PN|P/N|Part|Model|SKU", r"[:=][ \t]*[-+]?[0-9]"
#: What every line of a step holds: a chunk without it has no procedure.
STEP_MARK = r"[0-9][.)][ \t]"
REQUIREMENT = rf"(?i)(?:^|{text.NOT_W})(shall|must|required|prohibited)(?:$|{text.NOT_W})"
#: Fixed value: characters on either side of where a part or a measured value stands.
CONTEXT_CHARS = 120
WARNING_WORD = text.bounded("warning|caution|danger|note")
ENTITY_STOP = ("NECESSARY", "SHALL", "QTY", "SIZE", "NOTE", "NOTES", "CONSTRUCTION", "GENERAL", "DETAIL", "TITLE", "PAGE", "NUMBER", "NUMBERS", "DESCRIPTION", "WEIGHT", "PROVIDED", "WITHOUT", "DRAWING", "SHEET", "PROJECT", "REVISION", "STANDARD", "SYSTEM", "ENTITY", "ENTITIES", "SITE", "LEGAL", "ISOLATED", "TAGS", "NUMBERS/TAGS", "LAT")
STANDARD_BODIES = ("ANSI", "OSHA", "BICSI", "IEEE", "NFPA", "NEC", "ISO", "IEC", "TIA")


def lines_of(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", "source_filename", "heading", "title", "chunk_id", "chunk_index", "low_value", F.posexplode(F.split("text", "\n")).alias("line_no", "raw_line")).withColumn("line", F.expr(text.stripped("raw_line"))).where("line <> ''").drop("raw_line")


def glossary(chunks: DataFrame) -> DataFrame:
    """doc_id, source_filename, chunk_id, heading, chunk_index, line_no, term, body, score, rejection_reason."""
    rows = lines_of(chunks).where("not low_value")
    which = F.coalesce(*[F.when(F.col("line").rlike(p), F.lit(i)) for i, p in enumerate(rules.TERM_LINES)], F.when(F.col("line").rlike(rules.ACRONYM_LINE), F.lit(len(rules.TERM_LINES))))
    part = lambda g: F.coalesce(*[F.when(F.col("rule") == i, F.regexp_extract("line", p, g)) for i, p in enumerate((*rules.TERM_LINES, rules.ACRONYM_LINE))])
    rows = rows.withColumn("rule", which).where("rule is not null").withColumn("term", F.trim(part(1))).withColumn("body", F.trim(part(2)))
    rows = rows.withColumn("bare_term", F.expr(rules.bare("term"))).withColumn("flat", F.expr(text.squeezed("body"))).withColumn("n", F.expr(text.words("flat")))
    rows = settled(rows.withColumn("clean", F.expr(rules.clean_term("bare_term"))), "clean")
    rows = rows.where(f"clean or rule < {len(rules.TERM_LINES)}")  # an unclean acronym is no candidate at all
    rows = rows.withColumn("raw_score", F.expr(rules.glossary_score("term", "bare_term", "flat", "n")))
    reason = F.when(~F.col("clean"), "unclean_term").when(F.col("raw_score") < GLOSSARY_LEAST, "below_threshold")
    out = rows.select("doc_id", "source_filename", "chunk_id", "heading", "chunk_index", F.col("line_no").cast("long").alias("line_no"), "term", "body", F.when(F.col("clean"), F.col("raw_score")).otherwise(F.lit(0).cast("long")).alias("score"), reason.alias("rejection_reason"))
    return settled(out, "score", "rejection_reason")


def procedures(chunks: DataFrame) -> DataFrame:
    """doc_id, source_filename, chunk_id, heading, chunk_index, title, steps, score, rejection_reason."""
    rows = chunks.where("not low_value").withColumn("usable", F.expr(rules.usable_steps("line_list"))).withColumn("n_steps", F.expr(SPARK.size(SPARK.keep("line_list", "l", SPARK.has("l", rules.STEP_LINE))))).where("n_steps > 0")
    named = (F.col("heading") != "") & (F.col("heading") != F.col("title"))
    rows = rows.withColumn("proc_title", F.when(named, F.col("heading")).otherwise(F.concat("title", F.lit(" Procedure"))))
    rows = rows.withColumn("joined", F.array_join("usable", " ")).withColumn("hits", F.expr(rules.imperatives("usable")))
    rows = rows.withColumn("raw_score", F.expr(rules.procedure_score("proc_title", "heading", "usable", "joined", "hits")))
    weak = (F.col("hits") == 0) & ~F.col("proc_title").rlike(quick(rules.PROCEDURE_WORDS))
    reason = F.when(F.size("usable") < 2, "insufficient_usable_steps").when(weak, "weak_procedural_signal").when(F.col("raw_score") < PROCEDURE_LEAST, "below_threshold")
    rows = rows.withColumn("rejection_reason", reason)
    scored = F.col("rejection_reason").isNull() | (F.col("rejection_reason") == "below_threshold")
    steps = F.transform("usable", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    out = rows.select("doc_id", "source_filename", "chunk_id", "heading", "chunk_index", F.col("proc_title").alias("title"), steps.alias("steps"), F.when(scored, F.col("raw_score")).otherwise(F.lit(0).cast("long")).alias("score"), "rejection_reason")
    return settled(out, "score", "rejection_reason")


def facts(chunks: DataFrame) -> DataFrame:
    """doc_id, source_filename, chunk_id, heading, chunk_index, sentence_idx, body, category, score, rejection_reason."""
    per_line = F.expr(f"flatten({SPARK.each('line_list', 'x', text.sentences('x'))})")
    rows = chunks.select("doc_id", "source_filename", "chunk_id", "heading", "chunk_index", F.posexplode(per_line).alias("sentence_idx", "sentence")).where(F.col("sentence").rlike(quick(rules.FACT_SIGNAL)))
    rows = rows.withColumn("body", F.expr(rules.fact_sentence("sentence"))).withColumn("n", F.expr(text.words("body"))).withColumn("atomic", F.expr(rules.atomic_fact("body"))).withColumn("raw_score", F.when(F.col("atomic"), F.expr(rules.fact_score("body", "n"))).otherwise(F.lit(0).cast("long")))
    reason = F.when(~F.col("atomic"), "non_atomic_fact").when(F.col("raw_score") < FACT_LEAST, "below_threshold")
    out = rows.select("doc_id", "source_filename", "chunk_id", "heading", "chunk_index", F.col("sentence_idx").cast("long").alias("sentence_idx"), "body", F.expr(rules.fact_category("body")).alias("category"), F.col("raw_score").alias("score"), reason.alias("rejection_reason"))
    return settled(out, "body", "category", "score", "rejection_reason")


def _runs(rows: DataFrame, sorted_col: str, word: Callable[[Column], Column], run: Callable[[Column, Column, Column], Column], out: str) -> DataFrame:
    """``rows`` with ``run(entry, start, end)`` of each run of equal words in a sorted array, in place of that array."""
    n, at = F.size(sorted_col), lambda i: F.get(sorted_col, i)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (word(at(i)) != word(at(i - 1))))
    rows = settled(rows.withColumn("_starts", F.when(n > 0, starts)), "_starts")
    found = F.zip_with("_starts", F.concat(F.slice("_starts", 2, n), F.array(n)), lambda a, b: run(at(a), a, b))
    return settled(rows.withColumn(out, found), out).drop(sorted_col, "_starts")


def with_ranked_words(rows: DataFrame, words: Column, out: str, size: int = 3, counts: bool = False, keep: Callable[[str], str] | None = None) -> DataFrame:
    """``rows`` with the most frequent words of an array: by count, then length, both falling, then by themselves.

    With ``counts`` the new column has structs of term and n. With ``keep`` only words that it holds for count, and what
    counts is their lower case; it (a rule as SQL text) is asked once for each different word.

    Equal words stand together in a sorted array, so counts are the lengths of its runs: one pass, however long it is.
    """
    rows = settled(rows.withColumn("_sorted", F.sort_array(words)), "_sorted")
    rows = _runs(rows, "_sorted", lambda w: w, lambda w, a, b: F.struct(w.alias("w"), (b - a).alias("n")), "_counted")
    if keep is not None:
        small = F.transform(F.expr(SPARK.keep("_counted", "x", keep("x.w"))), lambda x: F.struct(F.lower(x["w"]).alias("w"), x["n"].alias("n")))
        rows = settled(rows.withColumn("_sorted", F.sort_array(small)), "_sorted")
        total = lambda a, b: F.aggregate(F.slice("_sorted", a + 1, b - a), F.lit(0), lambda s, x: s + x["n"])
        rows = _runs(rows, "_sorted", lambda x: x["w"], lambda x, a, b: F.struct(x["w"].alias("w"), total(a, b).alias("n")), "_counted")
    runs = F.transform("_counted", lambda x: F.struct((-x["n"]).alias("n"), (-F.length(x["w"])).alias("l"), x["w"].alias("w")))
    pick = (lambda x: F.struct(x["w"].alias("term"), (-x["n"]).cast("long").alias("n"))) if counts else (lambda x: x["w"])
    top = F.transform(F.slice(F.sort_array(runs), 1, size), pick)
    none = F.expr(f"cast(array() as array<{'struct<term:string,n:bigint>' if counts else 'string'}>)")
    return rows.withColumn(out, F.coalesce(top, none)).drop("_counted")


def topics(chunks: DataFrame) -> DataFrame:
    """doc_id, source_filename, chunk_id, heading, chunk_index, topic_key, topic_label, body, score, rejection_reason."""
    rows = with_ranked_words(chunks, F.expr(rules.long_words("promotion_text")), "terms", keep=rules.topic_word)
    named = (F.col("heading") != "") & (F.col("heading") != F.col("title")) & ~F.col("heading").rlike("^[0-9]+$") & ~F.expr(rules.admin_heading("bare_heading"))
    rows = rows.withColumn("bare_heading", F.expr(rules.bare("heading"))).withColumn("joined_terms", F.array_join("terms", " "))
    label = F.when(named, F.col("heading")).when(F.size("terms") > 0, F.expr(text.title_case("joined_terms"))).otherwise(F.col("title"))
    rows = rows.withColumn("topic_label", label).withColumn("n", F.expr(text.words("promotion_text")))
    rows = rows.where("low_value or n >= 8").withColumn("flat", F.expr(text.squeezed("promotion_text"))).withColumn("bare_label", F.expr(rules.bare("topic_label"))).withColumn("n_terms", F.size("terms"))
    rows = rows.withColumn("raw_score", F.expr(rules.topic_score("flat", "n", "heading", "title", "n_terms >= 2")))
    reason = F.when(F.col("low_value"), "admin_boilerplate").when(F.expr(rules.admin_heading("bare_label")) & (F.col("n") < 12), "weak_sheet_anchor").when(F.col("raw_score") < TOPIC_LEAST, "below_threshold")
    rows = rows.withColumn("rejection_reason", reason)
    scored = F.col("rejection_reason").isNull() | (F.col("rejection_reason") == "below_threshold")
    out = rows.select("doc_id", "source_filename", "chunk_id", "heading", "chunk_index", F.expr(text.slug("topic_label", 80)).alias("topic_key"), "topic_label", F.col("promotion_text").alias("body"), F.when(scored, F.col("raw_score")).otherwise(F.lit(0).cast("long")).alias("score"), "rejection_reason")
    return settled(out, "topic_key", "score", "rejection_reason")


def _real_entity(s: str) -> Column:
    """Of a bare text."""
    codes = ", ".join(SPARK.text(b) for b in STANDARD_BODIES)
    return F.expr(
        f"({s} <> '' and length({s}) >= 3 and not upper({s}) in ({', '.join(SPARK.text(w) for w in ENTITY_STOP)}) and not lower({s}) in ({', '.join(SPARK.text(w) for w in rules.GENERIC_NOTES)})"
        f" and not {rules.admin_heading(s)} and not ({text.is_upper(s)} and {text.tokens(s)} > 2) and not ({SPARK.has(s, '^[A-Z]{1,4}$')} and {s} not in ({codes})) and not {SPARK.has(s, rf'(?i)^[0-9]+(?:[.][0-9]+)?[ ]?(?:{rules.UNITS}|%)$')})"
    )


def entities(corpus: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """Distinct doc_id, source_filename, entity_type, value, normalized_key of each document, with its first place."""
    base = settled(corpus, text_col)
    base = settled(base.withColumn("line_list", F.expr(text.lines(text_col))), "line_list").where(~F.expr(rules.admin_at_least(text_col, "line_list", 70)))
    found = lambda pattern: F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(1))
    rows = base.select("doc_id", "source_filename", "title", found(STANDARD).alias("standards"), found(ORGANIZATION).alias("orgs"), found(PART_ID).alias("parts"))
    outside = F.filter("orgs", lambda o: ~F.exists("standards", lambda s: s.contains(o)))
    named = F.regexp_extract("title", NAMED_TITLE, 1)
    generic = F.lower(named).isin("entities", "entity", "drawing", "topic", "notes", "general notes", "title page") | F.lower(named).startswith("entity ")
    as_type = lambda kind: lambda v: F.struct(F.lit(kind).alias("entity_type"), v.alias("value"))
    every = F.concat(F.transform("standards", as_type("standard")), F.transform(outside, as_type("organization")), F.transform("parts", as_type("product")), F.when((named != "") & ~generic, F.array(F.struct(F.lit("document").alias("entity_type"), named.alias("value")))).otherwise(F.expr("cast(array() as array<struct<entity_type:string,value:string>>)")))
    rows = rows.select("doc_id", "source_filename", F.posexplode(every).alias("place", "e")).select("doc_id", "source_filename", "place", "e.entity_type", F.trim("e.value").alias("value")).withColumn("bare_value", F.expr(rules.bare("value")))
    rows = settled(rows, "bare_value").where(_real_entity("bare_value"))
    rows = rows.withColumn("both", F.concat("entity_type", F.lit("-"), "value")).withColumn("normalized_key", F.expr(text.slug("both", 180)))
    return rows.groupBy("doc_id", "source_filename", "normalized_key").agg(F.min(F.struct("place", "entity_type", "value")).alias("first")).select("doc_id", "source_filename", "first.entity_type", "first.value", "normalized_key", F.col("first.place").cast("long").alias("place"))


def warning_sentences(corpus: DataFrame, text_col: str = "raw_text", most: int = 200) -> DataFrame:
    """Distinct sentences with a warning word, in order; the first ``most`` of a document."""
    rows = corpus.select("doc_id", F.posexplode(F.expr(text.sentences(text_col))).alias("place", "sentence")).where(F.col("sentence").rlike(quick(WARNING_WORD))).withColumn("key", F.expr(text.slug("sentence", 220)))
    first = rows.groupBy("doc_id", "key").agg(F.min(F.struct("place", "sentence")).alias("f"))
    return first.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("f.place")).cast("long").alias("rank"), F.col("f.sentence").alias("sentence")).where(F.col("rank") <= most)


# records of the chunk engine: kind, item ordinal within its chunk, payload columns


def definition_records(chunks: DataFrame) -> DataFrame:
    return lines_of(chunks).where(F.col("line").rlike(DEFINITION)).select("doc_id", "chunk_index", F.col("line_no").cast("long").alias("item"), F.trim(F.regexp_extract("line", DEFINITION, 1)).alias("term"), F.trim(F.regexp_extract("line", DEFINITION, 2)).alias("definition"))


def requirement_records(chunks: DataFrame) -> DataFrame:
    rows = chunks.select("doc_id", "chunk_index", F.posexplode(F.expr(text.sentences("text"))).alias("item", "requirement_text"))
    return rows.where(F.col("requirement_text").rlike(quick(REQUIREMENT))).select("doc_id", "chunk_index", F.col("item").cast("long").alias("item"), "requirement_text", F.lower(F.regexp_extract("requirement_text", REQUIREMENT, 1)).alias("requirement_type"))


def warning_records(chunks: DataFrame) -> DataFrame:
    return lines_of(chunks).where(F.col("line").rlike(WARNING)).select("doc_id", "chunk_index", F.col("line_no").cast("long").alias("item"), F.lower(F.regexp_extract("line", WARNING, 1)).alias("warning_type"), F.trim(F.regexp_extract("line", WARNING, 2)).alias("warning_text"))


def with_contexts(rows: DataFrame, text_col: str, pattern: str, least: int, out: str, radius: int = CONTEXT_CHARS) -> DataFrame:
    """``rows`` with ``out``: for each match of ``pattern``, ``radius`` characters on either side of where it starts, stripped.

    A match may take along the character before it, which then counts as standing before the start. The text is parted
    into what lies between the matches and the matches; of each piece the first and last ``radius`` characters are kept, and
    a context is read off the nearest pieces. A match has ``least`` characters or more, so that is a fixed number of pieces:
    the cost grows with the length of the text, however many matches there are, and no text is copied for one.
    """
    found = F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))
    rows = settled(rows.withColumn("_found", found).withColumn("_gaps", F.split(F.col(text_col), pattern, -1)), "_found", "_gaps")
    before = F.transform("_found", lambda m: F.regexp_extract(m, "^[^A-Za-z0-9_]", 0))
    pairs = F.zip_with("_gaps", F.arrays_zip(F.col("_found").alias("m"), before.alias("b")), lambda gap, x: F.array(F.concat(gap, F.coalesce(x["b"], F.lit(""))), F.coalesce(F.substr(x["m"], F.length(x["b"]) + 1), F.lit(""))))
    rows = settled(rows.withColumn("_pieces", F.flatten(pairs)), "_pieces")
    rows = settled(rows.withColumn("_heads", F.transform("_pieces", lambda p: F.left(p, F.lit(radius)))).withColumn("_tails", F.transform("_pieces", lambda p: F.right(p, F.lit(radius)))), "_heads", "_tails")
    near = 2 * (-(-radius // least) + 1)  # pieces: a match and a gap, in turns
    at = lambda i: 2 * i + 2  # noqa: E731  of the i-th match, counted from 1
    left = lambda i: F.right(F.array_join(F.slice("_tails", F.greatest(F.lit(1), at(i) - near), F.least(F.lit(near), at(i) - 1)), ""), F.lit(radius))
    right = lambda i: F.left(F.array_join(F.slice("_heads", at(i), F.lit(near)), ""), F.lit(radius))
    contexts = F.transform("_found", lambda m, i: F.concat(left(i), right(i)))
    rows = settled(rows.withColumn("_contexts", contexts), "_contexts")
    return rows.withColumn(out, F.expr(SPARK.each("_contexts", "c", text.stripped("c")))).drop("_found", "_gaps", "_pieces", "_heads", "_tails", "_contexts")


def part_records(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_index, part_number, item, description: each part once a chunk, where it stands first, with what is around it."""
    rows = chunks.select("doc_id", "chunk_index", "text").where(F.col("text").rlike(PART_MARK))
    rows = with_contexts(rows, "text", PART_ID, 5, "contexts")  # two characters of a label, three of a number
    numbers = F.regexp_extract_all(F.col("text"), F.lit(PART_ID), F.lit(1))
    rows = rows.select("doc_id", "chunk_index", F.posexplode(F.arrays_zip(numbers.alias("part_number"), F.col("contexts").alias("description"))).alias("item", "p"))
    first = F.min(F.struct("item", "p.description")).alias("f")
    return rows.groupBy("doc_id", "chunk_index", "p.part_number").agg(first).select("doc_id", "chunk_index", "part_number", F.col("f.item").cast("long").alias("item"), F.col("f.description").alias("description"))


def spec_records(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_index, item, parameter, value, unit and what is around it; null text has none."""
    rows = chunks.select("doc_id", "chunk_index", "text").where(F.col("text").rlike(SPEC_MARK))
    rows = with_contexts(rows, "text", SPEC, 5, "contexts")  # three characters of a name, a sign, a digit
    found = lambda g: F.regexp_extract_all(F.col("text"), F.lit(SPEC), F.lit(g))
    rows = rows.select("doc_id", "chunk_index", F.posexplode(F.arrays_zip(found(1).alias("parameter"), found(2).alias("value"), found(3).alias("unit"), F.col("contexts").alias("context"))).alias("item", "s"))
    return rows.select("doc_id", "chunk_index", F.col("item").cast("long").alias("item"), F.trim("s.parameter").alias("parameter"), "s.value", "s.unit", "s.context")


def step_records(chunks: DataFrame) -> DataFrame:
    return lines_of(chunks).where(F.col("line").rlike(r"^[0-9]+[.)][ \t]+")).select("doc_id", "chunk_index", F.col("line_no").cast("long").alias("item"), F.col("line").alias("step_text"))


def table_records(chunks: DataFrame) -> DataFrame:
    rows = F.filter("line_list", lambda line: line.contains(" | "))
    return chunks.where(F.size(rows) > 0).select("doc_id", "chunk_index", F.array_join(rows, "\n").alias("table_text"))
