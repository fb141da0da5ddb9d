"""Delimited text as columns: cells and rows are found by one pattern inside the row, without Python and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .settle import settled

#: The delimiter of each document type, and what is stripped from a cell.
DELIMITERS = {"csv": ",", "tsv": "\t"}
CELL_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85                 　"
QUOTED = r'"[^"]*+(?:""[^"]*+)*+'


def cell_pattern(delimiter: str) -> str:
    """A cell (group 1) and what ends it (group 2).

    A quoted cell that is never closed runs to the end of the text; what stands between a closing quote and the next end
    belongs to the cell. Possessive throughout, so the engine's stack does not grow with the text.
    """
    open_end, closed, bare = rf"{QUOTED}\z", rf'{QUOTED}"[^{delimiter}\r\n]*+', rf'[^"{delimiter}\r\n][^{delimiter}\r\n]*+'
    return rf"({open_end}|(?:{closed}|{bare}|)(?={delimiter}|\r|\n))({delimiter}|\r\n|\n|\r|\z)"


def _cell(x: Column) -> Column:
    inner = F.regexp_extract(x, f"^({QUOTED})", 1)
    unquoted = F.concat(F.replace(F.substr(inner, F.lit(2)), F.lit('""'), F.lit('"')), F.substr(x, F.length(inner) + 2))
    return F.btrim(F.when(x.startswith('"'), unquoted).otherwise(x), F.lit(CELL_SPACE))


def with_cell_text(rows: DataFrame, text_col: str, type_col: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the cells of each row stripped and joined by `` | ``, the rows by line feeds.

    ``type_col`` says the delimiter: a tab for ``tsv``, else a comma. Rows end at CR LF, LF or CR outside quotes; quotes are
    doubled inside quotes and plain characters inside a bare cell; blank rows stay blank. Null text gives null, empty text
    empty. A cell may have any length. Columns that start with ``_cells`` are overwritten.
    """
    raw = F.col(text_col)
    ended = F.when(raw.endswith("\n") | raw.endswith("\r"), raw).otherwise(F.concat(raw, F.lit("\n")))
    rows = settled(rows.withColumn("_cells_raw", ended), "_cells_raw")

    def found(group: int) -> Column:
        by = {kind: F.regexp_extract_all(F.col("_cells_raw"), F.lit(cell_pattern(d)), F.lit(group)) for kind, d in DELIMITERS.items()}
        return F.when(F.col(type_col) == "tsv", by["tsv"]).otherwise(by["csv"])

    rows = settled(rows.withColumn("_cells", found(1)).withColumn("_cells_end", found(2)), "_cells", "_cells_end")
    between = lambda end: F.when(end.isin("\n", "\r", "\r\n"), "\n").when(end == "", "").otherwise(" | ")
    joined = F.array_join(F.zip_with("_cells", "_cells_end", lambda c, end: F.concat(_cell(c), between(end))), "")
    rows = settled(rows.withColumn("_cells_joined", joined), "_cells_joined")
    last = F.try_element_at("_cells_end", F.lit(-1)) != ""
    body = F.when(last, F.left("_cells_joined", F.length("_cells_joined") - 1)).otherwise(F.col("_cells_joined"))
    return rows.withColumn(out, body).drop("_cells_raw", "_cells", "_cells_end", "_cells_joined")
