"""Visible text and title of HTML, as columns.

What is hidden (comments, scripts, styles, templates) is taken out, the text between tags is kept piece by piece, and
character references are resolved. The references that pages use most are plain replacements; only texts with others
go through the standard library's table in Arrow batches.
"""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.dialect import SPARK, Dialect
from .settle import settled

TITLE = r"(?is)<title[^>]*>(.*?)</title[ \t\n\r\f]*>"
SPACE = r"[ \t\n\r\f]"
#: Elements whose content is not shown; one that is not closed hides the rest.
SILENT = ("script", "style", "noscript", "template")
#: References that are replaced in place, the ampersand last; a reference may lack its semicolon.
COMMON = (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&nbsp;?", " "), ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&"))
OTHER = r"&(?:#[0-9xX]|(?:[b-fh-kmo-pr-zA-Z]|g[^t]|l[^t]|n[^b]|q[^u]|a[^m])[A-Za-z0-9]*;)"


def _attributes(d: Dialect) -> str:
    """The rest of a tag up to its end; in quotes after an equals sign a closing angle bracket is plain text."""
    return rf"""(?:={SPACE}*"[^"]*"|={SPACE}*'[^']*'|[^>]){d.all_of}"""


def _sub(x: str, pattern: str, new: str, d: Dialect) -> str:
    """``pattern`` holds both quotes, which a raw literal can't: they come in by their codes."""
    return d.sub(x, pattern.replace('"', r"\x22").replace("'", r"\x27"), new)


def _hidden(d: Dialect) -> str:
    elements = [rf"<{name}(?:[ \t\n\r\f/]{_attributes(d)})?>.*?(?:</{name}{SPACE}*>|\z)" for name in SILENT]
    return "|".join([r"(?is)<!--.*?(?:-->|\z)", *elements])


def _tag(d: Dialect) -> str:
    """A tag, or one that the text ends within."""
    return rf"<[!?][^>]*>|</?[A-Za-z]{_attributes(d)}(?:>|\z)"


def resolved(x: str, d: Dialect = SPARK) -> str:
    for pattern, char in COMMON:
        x = d.sub(x, pattern, char)
    return x


def pieces(html: str, d: Dialect = SPARK) -> str:
    """The visible pieces of text, references unresolved."""
    shown = d.sub(_sub(html, _hidden(d), "<!>", d), TITLE, "<!>")
    marked = _sub(shown, _tag(d), "\x1f", d)
    return d.keep(d.each(d.split(marked, "chr(31)"), "p", text.stripped("p", d)), "p", "p <> ''")


def raw_title(html: str, d: Dialect = SPARK) -> str:
    return d.group(_sub(html, _hidden(d), "<!>", d), TITLE, 1)


def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unescape(t))


def with_visible_text(pages: DataFrame, html_col: str = "html", title: str = "title", body: str = "text") -> DataFrame:
    """``pages`` with the two columns; null HTML has neither title nor text."""
    rows = pages.withColumn("_shown", F.array_join(F.expr(pieces(f"coalesce({html_col}, '')")), "\n")).withColumn("_title", F.expr(raw_title(f"coalesce({html_col}, '')")))
    rows = settled(rows, "_shown", "_title")

    def plain(c: str) -> Column:
        other = F.when(F.col(c).rlike(OTHER), F.col(c))
        return F.coalesce(F.pandas_udf(_unescaped, "string")(other), F.expr(resolved(c)))

    return rows.withColumns({body: plain("_shown"), title: F.nullif(F.trim(F.regexp_replace(plain("_title"), text.SPACE + "+", " ")), F.lit(""))}).drop("_shown", "_title")
