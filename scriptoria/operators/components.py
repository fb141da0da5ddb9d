"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import shared_table


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v): each node's neighbours (large: the larger ones; small: the smaller ones and itself) move to its smallest."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = shared_table(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "least")
    moved = both.join(least, both["u"] == least["w"])
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every node of ``edges`` (u, v); component is the smallest id it can reach.

    Each round shortens every path to the smallest node; rounds end when no parent has a parent, which takes about the
    logarithm of the longest path, and one round for stars. All state lies in shared tables.
    """
    now = shared_table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(rounds):
        if now.join(now.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").isEmpty() and now.groupBy("u").count().where("count > 1").isEmpty():
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        now = shared_table(_stars(shared_table(_stars(now, True), "large"), False), "small")
    raise RuntimeError(f"no fixed point after {rounds} rounds")
