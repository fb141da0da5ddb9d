"""Rules from a table: the first of many shell patterns that fits a path, without a branch per rule.

A pattern's literal runs are text that every path it fits must hold. Of each run, cut to a size of the ladder below, the
windows of that size may stand for the rule (runs of less than half the longest one's size are left out); the one that the
fewest paths hold is the rule's anchor. Paths meet rules in one equality join, of their own windows of the sizes in use
with the anchors, as 64-bit hashes; only what meets is tested by the whole pattern. So the work grows with the paths and
with what their rarest literals find, not with paths times rules, and rules change without a new plan. Windows of paths
that are no rule's are dropped in a first join. Both sides of every join are shuffled: a table of rules is never
sent whole, as its size on disk says little of its windows'.

Patterns are shell patterns: ``*`` (also across slashes), ``?``, ``[abc]``, ``[a-c]``, ``[!a]``; ``**/x`` also fits x at the
top. Case counts.

Defined results: null paths and paths that no rule fits get the default and a null position; rules with a null position,
pattern or label fit nothing; of rules at one position the smallest label counts; repeated paths fare alike; without rules all get the
default; a pattern without any literal is tested on every path; a path longer than any file system takes (4 KB) gets its
rule too, but cutting its windows costs the square of its length; an empty table gives an empty result; other columns are
kept, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import shared_table

#: Sizes of windows, in characters.
SIZES = (32, 24, 16, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
IN_CLASS = re.compile(r"[\\\[\]&^~-]")


def _tokens(pattern: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of a shell pattern: literal, any (one character), many, class."""
    at = 0
    while at < len(pattern):
        c = pattern[at]
        close = pattern.find("]", at + (3 if pattern[at + 1 : at + 2] == "!" else 2)) if c == "[" else -1
        if close > 0:
            yield "class", pattern[at + 1 : close]
            at = close
        else:
            yield {"*": "many", "?": "any"}.get(c, "literal"), c
        at += 1


def _class(inside: str) -> str:
    """A class as a regular expression; ranges that run backwards hold nothing."""
    negated, inside = inside.startswith("!"), inside.removeprefix("!")
    parts, at = [], 0
    while at < len(inside):
        low, high = inside[at], inside[at + 2] if inside[at + 1 : at + 2] == "-" and at + 2 < len(inside) else inside[at]
        at += 3 if inside[at + 1 : at + 2] == "-" and at + 2 < len(inside) else 1
        if low <= high:
            parts.append("-".join(IN_CLASS.sub(r"\\\g<0>", x) for x in dict.fromkeys((low, high))))
    if not parts:
        return "." if negated else "(?!)"
    return f"[{'^' * negated}{''.join(parts)}]"


def shell_regex(pattern: str) -> str:
    """The regular expression that fits the same whole paths, for the JVM and for Python."""
    words = {"many": ".*", "any": "."}
    tokens = _tokens(re.sub(r"\*{2,}", "*", pattern))
    return "".join(words.get(kind) or (_class(x) if kind == "class" else re.escape(x)) for kind, x in tokens)


def anchors(pattern: str) -> list[str]:
    """Windows of the pattern's longer runs, of which every path that it fits holds each; one empty window without literals."""
    runs = "".join(x if kind == "literal" else "\0" for kind, x in _tokens(pattern)).split("\0")
    sized = [(run, next((n for n in SIZES if n <= len(run)), 0)) for run in runs]
    longest = max(size for _, size in sized)
    if not longest:
        return [""]
    return list(dict.fromkeys(run[i : i + size] for run, size in sized if 2 * size >= longest for i in range(len(run) - size + 1)))


def _compiled(patterns: pd.Series) -> pd.DataFrame:
    out = []
    for p in patterns:
        short = p.removeprefix("**/")
        both = [shell_regex(p)] + ([shell_regex(short)] if short != p else [])
        out.append((rf"\A(?s:{'|'.join(both)})\z", anchors(short)))
    return pd.DataFrame(out, columns=["regex", "grams"])


def compiled(rules: DataFrame) -> DataFrame:
    """``rules`` (pos, pattern, label) with the regular expression and the possible anchors of each."""
    rows = rules.where("pos is not null and pattern is not null and label is not null").select(F.col("pos").cast("long").alias("pos"), "pattern", "label")
    return rows.withColumn("x", F.pandas_udf(_compiled, "regex string, grams array<string>")("pattern")).select("pos", "label", "x.regex", "x.grams")


def first_fitting(rows: DataFrame, rules: DataFrame, default: str, path_col: str = "source_path") -> DataFrame:
    """(path_col, rule_pos, rule_label) of each distinct path of ``rows`` by ``rules`` (pos, pattern, label)."""
    paths = shared_table(rows.select(F.col(path_col).alias("path")).distinct().select(F.monotonically_increasing_id().alias("id"), "path"), "rule_paths")
    ruled = shared_table(compiled(rules).select(F.monotonically_increasing_id().alias("rule"), "*"), "rules")
    possible = ruled.select("rule", F.explode("grams").alias("window"))
    used = [r["size"] for r in possible.select(F.length("window").alias("size")).distinct().collect()]  # of ``SIZES``, and 0
    possible = possible.select("rule", F.xxhash64("window").alias("gram"))
    n = F.length("path")
    cut = lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.xxhash64(F.substring("path", i, F.lit(size))))
    none = F.array().cast("array<bigint>")
    windows = F.concat(none, *[F.when(n >= size, cut(size)).otherwise(none) if size else F.array(F.xxhash64(F.lit(""))) for size in used])
    held = paths.where("path is not null").select("id", F.explode(F.array_distinct(windows)).alias("gram"))
    met = shared_table(held.join(possible.select("gram").distinct().hint("merge"), "gram", "left_semi"), "met")
    counts = met.groupBy("gram").agg(F.count(F.lit(1)).alias("f"))
    # a window that no path holds rules its pattern out, so it must be the one that is taken
    seen = possible.join(counts.hint("merge"), "gram", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    chosen = seen.groupBy("rule").agg(F.min(F.struct("f", "gram")).alias("x")).where("x.f > 0").select("x.gram", "rule")
    pairs = met.join(chosen.hint("merge"), "gram").select("id", "rule")
    tested = pairs.join(paths.hint("merge"), "id").join(ruled.drop("grams").hint("merge"), "rule")
    first = tested.where(F.expr("path rlike regex")).groupBy("id").agg(F.min(F.struct("pos", "label")).alias("first"))
    out = paths.join(first.hint("merge"), "id", "left")
    return out.select(F.col("path").alias(path_col), F.col("first.pos").alias("rule_pos"), F.coalesce("first.label", F.lit(default)).alias("rule_label"))


def with_rule(rows: DataFrame, rules: DataFrame, default: str, path_col: str = "source_path", label_col: str = "rule_label") -> DataFrame:
    """``rows`` with the label of the first rule that fits each one's path, as a last column."""
    found = first_fitting(rows, rules, default, path_col).select(F.col(path_col).alias("__ruled_path"), F.col("rule_label").alias("__ruled_label"))
    joined = rows.join(found, rows[path_col].eqNullSafe(F.col("__ruled_path")))
    return joined.select(*[rows[c] for c in rows.columns], F.col("__ruled_label").alias(label_col))
