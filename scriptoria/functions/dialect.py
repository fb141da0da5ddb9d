"""The few spellings in which Spark SQL and the oracle's SQL differ. Operators use ``SPARK`` inside ``F.expr``."""

from __future__ import annotations

from .quick import quick


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark
        #: Repeats a group without end and gives nothing back: Java's engine goes a step deeper for each repetition
        #: otherwise and runs out of stack on long texts; the oracle's never does.
        self.all_of = "*+" if spark else "*"

    def text(self, value: str) -> str:
        """A string literal."""
        if not self.spark:
            return "'" + value.replace("'", "''") + "'"
        if '"' in value and "'" in value:
            raise ValueError(f"both quotes in {value!r}")
        quote = "'" if '"' in value else '"'
        return f"r{quote}{value}{quote}"

    def has(self, x: str, pattern: str) -> str:
        return f"rlike({x}, {self.text(quick(pattern))})" if self.spark else f"regexp_matches({x}, {self.text(pattern)})"

    def has_marked(self, x: str, marks: tuple[str, ...], pattern: str) -> str:
        """``has`` of a pattern of which every match holds one of ``marks``: those are looked for first."""
        if not self.spark:
            return self.has(x, pattern)
        return f"(({' or '.join(self.has_text(x, self.text(m)) for m in marks)}) and {self.has(x, pattern)})"

    def count(self, x: str, pattern: str) -> str:
        return f"cast(regexp_count({x}, {self.text(pattern)}) as bigint)" if self.spark else f"len(regexp_extract_all({x}, {self.text(pattern)}))"

    def sub(self, x: str, pattern: str, new: str) -> str:
        """``new`` may name groups as \\1."""
        if self.spark:
            return f"regexp_replace({x}, {self.text(pattern)}, {self.text(new.replace(chr(92), '$'))})"
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(new)}, 'g')"

    def group(self, x: str, pattern: str, number: int) -> str:
        return f"regexp_extract({x}, {self.text(pattern)}, {number})"

    def groups(self, x: str, pattern: str, number: int) -> str:
        return f"regexp_extract_all({x}, {self.text(pattern)}, {number})"

    def size(self, array: str) -> str:
        return f"cast(size({array}) as bigint)" if self.spark else f"len({array})"

    def keep(self, array: str, var: str, rule: str) -> str:
        return f"filter({array}, {var} -> {rule})" if self.spark else f"list_filter({array}, lambda {var}: {rule})"

    def each(self, array: str, var: str, value: str) -> str:
        return f"transform({array}, {var} -> {value})" if self.spark else f"list_transform({array}, lambda {var}: {value})"

    def join(self, array: str, by: str) -> str:
        return f"array_join({array}, {by})" if self.spark else f"array_to_string({array}, {by})"

    def split(self, x: str, by: str) -> str:
        """By a literal string that has no special meaning in patterns."""
        return f"split({x}, {by})" if self.spark else f"string_split({x}, {by})"

    def distinct(self, array: str) -> str:
        return f"array_distinct({array})" if self.spark else f"list_distinct({array})"

    def has_text(self, x: str, part: str) -> str:
        return f"contains({x}, {part})"


SPARK, ANSI = Dialect(True), Dialect(False)
