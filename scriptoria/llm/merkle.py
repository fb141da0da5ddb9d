"""A Merkle manifest of a table, with a proof for each row, by a butterfly exchange.

Rows are leaves, in order within their group; runs of ``fanout`` consecutive nodes hash to their parent, up to a subroot
for each group; the subroots in the order of their groups hash to the root in the same way.

The leaves are numbered by a range partitioning and cut into blocks of fanout ** block_levels consecutive ones. A block
hashes its own subtree. Then the blocks swap roots round by round: in a round, each block sends the root of the node that
it stands for to one block at least of each sibling node, and every block hashes the parent for itself. After the last
round every block holds the root and its own upper proof: nothing is passed down. A message is one digest, a block gets
at most fanout of them a round, and what is exchanged is one row in 4,096 leaves, so that each round is one small shuffle.
Where a sibling has fewer blocks (the ragged end, or a smaller group), its blocks serve those of the larger one in turn.

Defined results: a null field is ``-``, an empty text ``0:``; a null group is a group, the first; rows of one id stand in
the order of their leaves (rows that are equal in all fields are interchangeable); a row without an id stands before all
others; other columns, whatever their names, are carried along and not hashed; an empty table has no rows and no root.
The length of a text does not matter beyond its own row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_name, shared_table, ship_by_value

ship_by_value(__name__)

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT, BLOCK_LEVELS = 8, 4
PROOF = "array<struct<left:string,right:string>>"
_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])


def record_hash(fields: Iterable[Column]) -> Column:
    """SHA-256 of the fields, each as its length in bytes, a colon and its text; ``-`` if it is null."""
    said = [F.when(f.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string"))) for f in fields]
    return F.sha2(F.concat(*said), 256)


def siblings(proof: Column) -> Column:
    """The digests of a proof as one text, from the leaf's run up to the root's, each run from left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf has under a proof."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def _levels(n: int, fanout: int) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def _climb(nodes: list[str], levels: int, fanout: int) -> tuple[list[list[tuple[str, str]]], str]:
    """What stands left and right of each node, level by level, and the last digest."""
    beside = []
    for _ in range(levels):
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        whole = ["".join(r) for r in runs]
        size = len(nodes[0])
        beside.append([(w[: size * j], w[size * (j + 1) :]) for r, w in zip(runs, whole, strict=True) for j in range(len(r))])
        nodes = [hashlib.sha256(w.encode()).hexdigest() for w in whole]
    return beside, nodes[0]


def _block_roots(fanout: int, block_levels: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        levels = min(block_levels, _levels(table.column("members")[0].as_py(), fanout))
        _, root = _climb(table.column("leaf").to_pylist(), levels, fanout)
        return table.slice(0, 1).select(["block", "g"]).append_column("root", pa.array([root]))

    return run


def _block_proofs(fanout: int, block_levels: int):
    def run(leaves: pa.Table, upper: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("pos")
        levels = min(block_levels, _levels(leaves.column("members")[0].as_py(), fanout))
        beside, _ = _climb(leaves.column("leaf").to_pylist(), levels, fanout)
        above = [(s["left"], s["right"]) for s in upper.column("proof")[0].as_py()]
        n, width = leaves.num_rows, [fanout**i for i in range(levels)]
        steps = [s for i in range(n) for s in [*(beside[k][i // width[k]] for k in range(levels)), *above]]
        flat = pa.StructArray.from_arrays([pa.array([s[0] for s in steps], pa.string()), pa.array([s[1] for s in steps], pa.string())], fields=list(_STEP))
        each = levels + len(above)
        proof = pa.ListArray.from_arrays(pa.array(range(0, n * each + 1, each) if each else [0] * (n + 1), pa.int32()), flat)
        roots = [pa.array([upper.column(c)[0].as_py()] * n, pa.string()) for c in ("subroot", "root")]
        return pa.Table.from_arrays([leaves.column("row"), leaves.column("leaf"), *roots, proof], names=["row", "leaf", "subroot", "root", "proof"])

    return run


def _in_order(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """``df`` as a table in ranges of ``by``, with the range (part) and the place in it (seq)."""
    ranges = df.repartitionByRange(*by).sortWithinPartitions(*by)
    part = F.spark_partition_id().cast("long")
    return shared_table(ranges.select("*", part.alias("part"), (F.monotonically_increasing_id() - F.shiftleft(part, 33)).alias("seq")), name)


def _groups(counted: DataFrame, fanout: int, block: int) -> DataFrame:
    """A row for each group: members, blocks, its number, the first of its blocks among all."""
    sizes = counted.groupBy("g").agg(F.sum("n").alias("members")).withColumn("blocks", F.expr(f"(members + {block - 1}) div {block}"))
    table = _in_order(sizes, ["g"], "groups")
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    totals = table.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("blocks").alias("b"))
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range, no more than there are shuffle partitions
    offsets = totals.select("part", F.coalesce(F.sum("n").over(parts), F.lit(0)).alias("n0"), F.coalesce(F.sum("b").over(parts), F.lit(0)).alias("b0"))
    own = table.select("*", F.coalesce(F.sum("blocks").over(before), F.lit(0)).alias("b1")).join(offsets, "part")
    return own.select("g", "members", "blocks", (F.col("n0") + F.col("seq")).alias("number"), (F.col("b0") + F.col("b1")).alias("first"))


def _bounds_inside(fanout: int, r: int) -> Column:
    """In round r: where the sibling nodes begin among all blocks, and where the last one ends; null if the group has one node."""
    size, run = fanout**r, fanout ** (r + 1)
    start = F.expr(f"(block - first) div {run} * {run}")
    begins = F.transform(F.expr(f"sequence(0L, {fanout - 1}L)"), lambda d: start + d * size)
    inside = F.filter(begins, lambda x: x < F.col("blocks"))
    bounds = F.transform(F.array_append(inside, F.least(start + run, F.col("blocks"))), lambda x: x + F.col("first"))
    return F.when(F.col("blocks") > size, bounds)


def _bounds_above(groups: DataFrame, fanout: int, rounds: int) -> DataFrame:
    """``groups`` with the same of each round among the groups."""
    for t in range(rounds):
        run = F.expr(f"number div {fanout ** (t + 1)}")
        begins = F.array_sort(F.collect_list(F.when(F.col("number") % fanout**t == 0, F.col("first"))))
        ends = groups.groupBy(run.alias("run")).agg(F.array_append(begins, F.max(F.col("first") + F.col("blocks"))).alias(f"above{t}"))
        groups = groups.withColumn("run", run).join(ends, "run").drop("run")
    return groups


def _swap(state: DataFrame, bounds: Column) -> DataFrame:
    """A round: every block gets the roots of the sibling nodes and hashes the parent."""
    kept = [c for c in state.columns if c not in ("block", "root", "proof")]
    state = state.withColumn("bounds", bounds)
    node = F.size(F.filter("bounds", lambda x: x <= F.col("block"))) - 1
    state = state.withColumn("node", F.when(F.col("bounds").isNotNull(), node))
    # blocks of node e that this block serves: those whose place is its own, modulo its node's size
    sent = F.expr("""flatten(transform(sequence(0, size(bounds) - 2), e -> case
        when e = node or bounds[e] + block - bounds[node] >= bounds[e + 1] then cast(array() as array<bigint>)
        else sequence(bounds[e] + block - bounds[node], bounds[e + 1] - 1, bounds[node + 1] - bounds[node]) end))""")
    own = F.array(F.col("block"))
    to = F.explode(F.when(F.col("bounds").isNull(), own).otherwise(F.concat(own, sent))).alias("to")
    messages = state.select(to, "block", "root", "node", F.struct("proof", *kept).alias("own"))
    got = messages.groupBy("to").agg(
        F.array_sort(F.collect_list(F.struct("node", "root"))).alias("nodes"),  # fanout of them at most
        F.first(F.when(F.col("to") == F.col("block"), F.struct("node", "root", "own")), ignorenulls=True).alias("me"),
    )
    side = lambda keep: F.array_join(F.transform(F.filter("nodes", keep), lambda x: x["root"]), "")
    step = F.struct(side(lambda x: x["node"] < F.col("me.node")).alias("left"), side(lambda x: x["node"] > F.col("me.node")).alias("right"))
    still = F.col("me.node").isNull()
    root = F.when(still, F.col("me.root")).otherwise(F.sha2(side(lambda x: F.lit(True)), 256))
    proof = F.when(still, F.col("me.own.proof")).otherwise(F.array_append("me.own.proof", step))
    return got.select(F.col("to").alias("block"), root.alias("root"), proof.alias("proof"), *[F.col(f"me.own.{c}").alias(c) for c in kept])


def prove(leaves: DataFrame, leaf_col: str, group_col: str, order_col: str, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> tuple[DataFrame, tuple[str, str, str]]:
    """The rows of ``leaves`` with three more columns, and their names: subroot, root, proof (:data:`PROOF`)."""
    names = tuple(fresh_name(leaves.columns, n) for n in ("subroot", "root", "proof"))
    block = fanout**block_levels
    group = F.when(F.col(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    rows = leaves.select(F.struct(*[F.col(f"`{c}`") for c in leaves.columns]).alias("row"), group.alias("g"), F.col(order_col).alias("key"), F.col(leaf_col).alias("leaf"), F.monotonically_increasing_id().alias("tie"))
    table = _in_order(rows, ["g", "key", "leaf", "tie"], "leaves").drop("key", "tie")
    counted = shared_table(table.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq0")), "counted")
    groups = shared_table(_groups(counted, fanout, block), "groups")
    most, n_groups = groups.agg(F.max("blocks"), F.count(F.lit(1))).first()
    earlier = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("g", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("seq0")).alias("shift")).join(groups.select("g", "members", "first"), "g")
    placed = table.join(offsets, ["g", "part"]).withColumn("pos", F.col("seq") + F.col("shift")).withColumn("block", F.expr(f"first + pos div {block}")).select("block", "g", "pos", "members", "leaf", "row")

    roots = placed.select("block", "g", "pos", "members", "leaf").groupBy("block").applyInArrow(_block_roots(fanout, block_levels), "block long, g string, root string")
    above = _levels(n_groups, fanout)
    state = roots.join(_bounds_above(groups.drop("members"), fanout, above), "g").drop("g", "number").withColumn("proof", F.expr(f"cast(array() as {PROOF})"))
    for r in range(_levels(most or 0, fanout)):
        state = _swap(state, _bounds_inside(fanout, r))
    state = state.withColumn("subroot", F.col("root"))
    for t in range(above):
        state = _swap(state, F.col(f"above{t}"))
    upper = shared_table(state.select("block", "subroot", "root", "proof"), "upper")

    out = T.StructType([placed.schema["row"], T.StructField("leaf", T.StringType()), T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType()), T.StructField("proof", T._parse_datatype_string(PROOF))])
    proved = placed.groupBy("block").cogroup(upper.groupBy("block")).applyInArrow(_block_proofs(fanout, block_levels), out)
    return proved.select(*[F.col(f"row.`{c}`").alias(c) for c in leaves.columns], *[F.col(c).alias(n) for c, n in zip(("subroot", "root", "proof"), names, strict=True)]), names
