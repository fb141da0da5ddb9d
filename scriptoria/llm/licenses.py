"""License scans: an exact set-similarity join between text blocks and license templates.

Templates are texts by label. One of L words has blocks of 2 S words moved by S, where S is L rounded up to a power of
two, so every passage of the template's length lies whole inside one block. A block meets the template if it holds at
least ``ceil(threshold * m)`` of its m distinct words. Words are ordered by how many documents of the whole input hold
them, rarest first. A block that meets the threshold holds one of the template's first ``m - need + 1`` words (prefix
filter): only blocks around such a word are cut at all. What they hold of the templates' words must be ``need`` words
(length filter), and from the first shared word on enough words must be left on both sides (positional filter); what
passes is compared in full.

Beside the join, ``phrase_places`` finds the places where a phrase's words stand consecutively.

The templates' words stand in the plan as literals, and the index of their first words is broadcast. So templates are
joined in parts of at most ``MOST_WORDS`` words, a part's tables written before the next begins; a longer template is a
part of its own. Whether a block meets a template depends on nothing but the two, so the parts' rows are the whole join.

Defined results: null text has no words; a document without matches has an empty label list and score 0; repeated
rows of one id share their labels; a template without words matches nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_WORD_RUN, shared_table
from .license_texts import TEMPLATES

#: Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Words of the templates that are joined at a time.
MOST_WORDS = 50_000
THRESHOLD = 0.9


#: The letters that are made small: no others.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_text(text: Column) -> Column:
    """The lower-case words of a text with one space around each; a single space if there is none."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), NOT_WORD_RUN, " ")), F.lit(" "))


def word_count(padded: Column) -> Column:
    n = F.length(padded) - F.length(F.replace(padded, F.lit(" "), F.lit("")))
    return F.when(padded == "  ", F.lit(0)).otherwise(n - 1).cast("long")


def phrase_places(padded: Column, phrase: str) -> Column:
    """struct<n,first,last>: how often the phrase's words stand consecutively, and the first and last start in words."""
    none = F.expr("named_struct('at', 0L, 'n', 0L, 'first', cast(null as bigint), 'last', cast(null as bigint))")
    spaces = F.transform(F.split(padded, f"(?<= )(?={re.escape(phrase)} )", -1), lambda p: F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit(""))))

    def step(acc: Column, gap: Column) -> Column:
        at = acc["at"]  # spaces so far: 0 before the leading piece, which is no place
        seen = F.struct((at + gap).alias("at"), (acc["n"] + 1).alias("n"), F.coalesce(acc["first"], at - 1).alias("first"), (at - 1).alias("last"))
        return F.when(at == 0, F.struct(gap.cast("long").alias("at"), acc["n"].alias("n"), acc["first"].alias("first"), acc["last"].alias("last"))).otherwise(seen)

    return F.when(F.contains(padded, F.lit(f" {phrase} ")), F.aggregate(spaces, none, step)).otherwise(none)


def word_list(text: str) -> list[str]:
    return [w for w in re.split(NOT_WORD_RUN, text.translate(str.maketrans(UPPER, UPPER.lower()))) if w]


def template_sets(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, int, list[str]]]:
    """(label, step of its blocks, distinct words) of every template that has words."""
    lists = [(label, word_list(text)) for label, text in templates]
    return [(label, 1 << (len(words) - 1).bit_length(), list(dict.fromkeys(words))) for label, words in lists if words]


def in_parts(sets: list[tuple[str, int, list[str]]], most_words: int) -> list[list[tuple[str, int, list[str]]]]:
    """The templates in their order, in runs of at most so many words."""
    parts: list[list[tuple[str, int, list[str]]]] = []
    room = 0
    for one in sets:
        if not parts or len(one[2]) > room:
            parts.append([])
            room = most_words
        parts[-1].append(one)
        room -= len(one[2])
    return parts


def template_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, most_words: int = MOST_WORDS) -> DataFrame:
    """(id, step, block, label, containment) for every block and template that meet the threshold."""
    parts = in_parts(template_sets(templates), most_words) or [[]]
    found = [_matches_of(docs, id_col, text_col, part, threshold) for part in parts]
    if len(found) == 1:
        return found[0]
    return reduce(DataFrame.unionByName, [shared_table(rows, "matches") for rows in found]).distinct()  # templates of one label


def _matches_of(docs: DataFrame, id_col: str, text_col: str, sets: list[tuple[str, int, list[str]]], threshold: float) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted({w for _, _, words in sets for w in words})
    literals = lambda words: F.array(*[F.lit(w) for w in sorted(words)])
    rows = docs.select(F.col(id_col).alias("id"), F.split(F.trim(words_text(F.col(text_col))), " ").alias("words"))
    counted = {r["word"]: r["n"] for r in rows.select(F.explode(F.array_intersect("words", literals(vocabulary))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per template word at most
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counted.get(w, 0), w)))}
    index, heads, own_words = [], {}, {}
    for label, step, own in sets:
        own = sorted(own, key=rank.__getitem__)
        need = math.ceil(threshold * len(own) - 1e-9)
        first = own[: len(own) - need + 1]
        index += [(w, label, step, own, need, at) for at, w in enumerate(first)]
        heads.setdefault(step, set()).update(first)
        own_words.setdefault(step, set()).update(own)
    index = spark.createDataFrame(index, "word string, label string, step int, own array<string>, need int, at int")
    none = F.expr("cast(array() as array<struct<step:int,block:int,held:array<string>>>)")

    def around(step: int) -> Column:
        """The blocks of one size around the first words of its templates, with what they hold of these templates."""
        places = F.filter(F.transform("words", lambda w, i: F.when(w.isin(sorted(heads[step])), i)), lambda i: i.isNotNull())
        numbers = F.array_distinct(F.flatten(F.transform(places, lambda i: F.filter(F.array(F.floor(i / step).cast("int"), F.floor(i / step).cast("int") - 1), lambda k: k >= 0))))
        return F.transform(numbers, lambda k: F.struct(F.lit(step).alias("step"), k.alias("block"), F.array_intersect(F.slice("words", k * step + 1, 2 * step), literals(own_words[step])).alias("held")))

    found = F.concat(*[around(step) for step in sorted(heads)]) if heads else none
    blocks = shared_table(rows.select("id", F.explode(found).alias("b")).select("id", "b.*"), "blocks")
    ranks = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, rank[w])]) if vocabulary else F.expr("cast(map() as map<string,int>)")
    ordered = F.transform(F.array_sort(F.transform("held", lambda w: F.struct(F.element_at(ranks, w).alias("r"), w.alias("w")))), lambda x: x["w"])
    tokens = blocks.select("id", "step", "block", ordered.alias("held")).select("id", "step", "block", "held", F.posexplode("held").alias("pos", "word"))
    left = F.least(F.size("held") - F.col("pos"), F.size("own") - F.col("at"))
    candidates = tokens.join(F.broadcast(index), ["word", "step"]).where((F.size("held") >= F.col("need")) & (left + F.least("at", "pos") >= F.col("need")))
    shared = F.size(F.array_intersect("held", "own"))
    return candidates.where(shared >= F.col("need")).select("id", "step", "block", "label", (shared / F.size("own")).alias("containment")).distinct().withColumnRenamed("id", id_col)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, most_words: int = MOST_WORDS) -> DataFrame:
    """One row per input row: id, n_words, phrases array<struct<label,n,first,last>>, template_labels, score."""
    padded = words_text(F.col(text_col))
    base = docs.select(F.col(id_col).alias("id"), padded.alias("padded")).select("id", word_count(F.col("padded")).alias("n_words"), F.array(*[F.struct(F.lit(label).alias("label"), phrase_places(F.col("padded"), phrase).alias("places")) for phrase, label in PHRASES]).alias("phrases"))
    found = template_matches(docs, id_col, text_col, templates, threshold, most_words).groupBy(F.col(id_col).alias("found_id")).agg(F.array_sort(F.collect_set("label")).alias("template_labels"), F.max("containment").alias("score"))
    return base.join(found, base["id"].eqNullSafe(found["found_id"]), "left").select(F.col("id").alias(id_col), "n_words", "phrases", F.coalesce("template_labels", F.expr("cast(array() as array<string>)")).alias("template_labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
