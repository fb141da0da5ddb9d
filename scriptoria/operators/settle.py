"""A barrier for filters on costly columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with these columns computed once, below a one-row generator.

    The optimizer moves a filter on a computed column below the projection that computes it, and so computes the column
    twice; it moves no filter on a generator's output below the generator.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns)))).select(*df.columns)
