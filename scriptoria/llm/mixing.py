"""Mixing sources to target weights: temperature mixing with budgeted block permutations.

A source's weight is its share of tokens to the power t, normalised. The exponent is bisected on [0, 1]: the largest
t whose weights still reach the target entropy, or, to keep the repetition limit, the smallest t at which no source
is read more than ``max_epochs`` times; with ``cover``, under the budget that covers at that t. Six steps of the bisection are one aggregation over the table of sources: it
evaluates all 63 inner points of the present bracket, and the driver, which gets those 63 numbers, walks down them.

Weights become token quotas: a source is read ``quota div tokens`` times in full, and once more up to the rest, in
the order of its block permutation. Documents fall into blocks of about ``block_docs`` by a keyed digest and stand in
a keyed order within their block, so no sort ever sees more than a block; block totals give each block's offset.

Where both targets are given and disagree, or the repetition limit can't be met at any exponent (a budget of many times
the tokens), the repetition limit decides the exponent as far as it goes; ``targets_met`` tells which targets hold.

Defined results: null text has no tokens, a null source is the source named by the empty string; documents without
tokens are read as often as their source is read in full; an empty table gives an empty result. Rows, not ids, are
placed: repeated rows, rows of one id and rows without an id each get a place of their own; of equal keys the text with
the smaller digest stands first. Other columns are untouched; the new ones get underscores if their names are taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BY_SPACE, fresh_name, shared_table

STEPS, PASSES = 6, 5


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_BY_SPACE)), F.lit(0)).cast("long")


def _evaluated(sources: DataFrame, low: float, high: float, budget: int | None, cover: bool, at: list[float] | None = None) -> list[tuple[float, float, float]]:
    """(t, entropy, most epochs) at the inner points of the bracket, or ``at`` given ones, from one pass over the sources.

    With ``cover`` each point has its own budget, that with which its least read source is read once.
    """
    n = 2**STEPS
    points = F.explode(F.array(*[F.lit(t) for t in at or [low + (high - low) * i / n for i in range(1, n)]]))
    total = sources.where("tokens > 0").agg(F.sum("tokens")).first()[0] or 1
    rows = sources.where("tokens > 0").select("tokens", points.alias("t")).withColumn("p", F.pow(F.col("tokens") / F.lit(float(total)), F.col("t")))
    epochs = F.col("p") / F.col("tokens")
    got = rows.groupBy("t").agg(F.sum("p").alias("z"), F.sum(F.col("p") * F.log("p")).alias("plogp"), F.max(epochs).alias("most"), F.min(epochs).alias("least")).collect()
    per_epoch = lambda r: 1 / r["least"] if cover else (budget if budget is not None else total) / r["z"]
    return sorted((r["t"], math.log(r["z"]) - r["plogp"] / r["z"], r["most"] * per_epoch(r)) for r in got)


def bisect_exponent(sources: DataFrame, entropy_share: float | None = None, max_epochs: float | None = None, budget: int | None = None, cover: bool = False) -> float:
    """The exponent for a table (source, tokens); without a target it is 1, the sources' own shares.

    ``entropy_share`` is a share of the greatest entropy, ln(number of sources with tokens).
    """
    n = sources.where("tokens > 0").count()
    if n < 2 or (entropy_share is None and max_epochs is None):
        return 1.0

    def bisect(low_is_right) -> float:
        """``low_is_right(entropy, epochs)``: the answer lies above this point."""
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            points = _evaluated(sources, low, high, budget, cover)
            a, b = 0, 2**STEPS
            lo, hi = low, high
            while b - a > 1:
                mid = (a + b) // 2
                t, entropy, most = points[mid - 1]
                if low_is_right(entropy, most):
                    a, lo = mid, t
                else:
                    b, hi = mid, t
            low, high = lo, hi
        return (low, high)

    found = []
    if entropy_share is not None:
        target = entropy_share * math.log(n)
        found.append(bisect(lambda entropy, _: entropy >= target)[0])  # entropy falls as t grows
    if max_epochs is not None:
        found.append(bisect(lambda _, most: most > max_epochs)[1])  # epochs of the smallest source fall as t grows
    return max(found)


def targets_met(sources: DataFrame, t: float, entropy_share: float | None = None, max_epochs: float | None = None, budget: int | None = None, cover: bool = False) -> dict[str, bool]:
    """Whether the exponent ``t`` reaches each target that is given, for a table (source, tokens)."""
    n = sources.where("tokens > 0").count()
    if not n:
        return {k: True for k, v in (("entropy", entropy_share), ("epochs", max_epochs)) if v is not None}
    (_, entropy, most), *_ = _evaluated(sources, 0.0, 0.0, budget, cover, [t])
    met = {}
    if entropy_share is not None:
        met["entropy"] = entropy >= entropy_share * math.log(n) - 1e-9
    if max_epochs is not None:
        met["epochs"] = most <= max_epochs + 1e-9
    return met


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy_share: float | None = 0.95, max_epochs: float | None = 4.0, budget_tokens: int | None = None, cover: bool = False, seed: str = "mix-1", block_docs: int = 4096) -> DataFrame:
    """One row per input row: id, source, n_tokens, copies, start_token; ``source`` is the empty string for null."""
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.col(text_col).alias("text"))
    out, (n_tokens, copies, start) = with_places(slim, "id", "text", "source", entropy_share, max_epochs, budget_tokens, cover, seed, block_docs, ["id", "source"])
    return out.select(F.col("id").alias(id_col), "source", F.col(n_tokens).alias("n_tokens"), F.col(copies).alias("copies"), F.col(start).alias("start_token"))


def with_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy_share: float | None = 0.95, max_epochs: float | None = 4.0, budget_tokens: int | None = None, cover: bool = False, seed: str = "mix-1", block_docs: int = 4096, keep: list[str] | None = None) -> tuple[DataFrame, tuple[str, str, str]]:
    """The columns ``keep`` of docs (default: all) with three more, and their names: n_tokens, copies, start_token.

    ``copies``: how often the row is read. ``start_token``: where it starts in its source's permutation. The budget is
    ``budget_tokens``, by default the tokens of the input; with ``cover`` it is the least with which every source is
    read at least once, so that no document is lost, and ``max_epochs`` (1 at least) holds for that budget. Rows move
    once, to their block.
    """
    keep = list(docs.columns) if keep is None else list(keep)
    names = tuple(fresh_name([*docs.columns, *keep], n) for n in ("n_tokens", "copies", "start_token"))
    keyed = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    # what is kept travels as one column, so that no name can clash
    rows = docs.select(F.struct(*keep).alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), token_count(F.col(text_col)).alias("n_tokens"), keyed.alias("key"), F.xxhash64(text_col).alias("digest"))
    slim = shared_table(rows.select("source", "n_tokens", F.substring("key", 1, 8).alias("head")), "tokens")
    sources = shared_table(slim.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "sources")
    budget = budget_tokens if budget_tokens is not None else sources.agg(F.sum("tokens")).first()[0] or 0
    t = bisect_exponent(sources, entropy_share, max_epochs, budget, cover)
    total = sources.agg(F.sum("tokens")).first()[0] or 1
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(t))).otherwise(0.0)
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    weight = power / F.lit(z)
    if cover:
        budget = sources.where("tokens > 0").agg(F.max(F.ceil(F.col("tokens") / weight))).first()[0] or 0
    quota = F.floor(weight * F.lit(float(budget)) + F.lit(1e-6)).cast("long")
    plan = sources.select("source", F.greatest(F.lit(1), F.ceil(F.col("docs") / block_docs)).cast("long").alias("blocks"), quota.alias("quota"), F.greatest(F.col("tokens"), F.lit(1)).alias("size"))
    full = F.greatest(F.floor(F.col("quota") / F.col("size")), F.lit(1 if cover else 0)).cast("long")
    rest = F.when(F.lit(cover) & (F.col("quota") < F.col("size")), F.lit(0)).otherwise(F.pmod("quota", "size")).cast("long")
    plan = shared_table(plan.select("source", "blocks", full.alias("full"), rest.alias("rest")), "plan")
    block_of = lambda head: F.pmod(F.conv(head, 16, 10).cast("long"), F.col("blocks"))
    totals = slim.join(plan, "source").groupBy("source", block_of(F.col("head")).alias("block")).agg(F.sum("n_tokens").alias("in_block"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shared_table(totals.select("source", "block", F.coalesce(F.sum("in_block").over(before), F.lit(0)).alias("offset")), "offsets")
    placed = rows.join(plan, "source").withColumn("block", block_of(F.substring("key", 1, 8)))
    within = Window.partitionBy("source", "block").orderBy("key", "id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(offsets.hint("merge"), ["source", "block"])
    start = (F.col("offset") + F.col("inner")).cast("long")
    copies = F.col("full") + F.when((F.col("n_tokens") > 0) & (start + F.col("n_tokens") <= F.col("rest")), 1).otherwise(0)
    new = (F.col("n_tokens"), copies.cast("long"), start)
    return placed.select(*[F.col("row").getField(c).alias(c) for c in keep], *[c.alias(n) for c, n in zip(new, names, strict=True)]), names
