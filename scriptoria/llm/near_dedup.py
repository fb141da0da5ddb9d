"""MinHash near-dedup by min-max hashing.

A document's set holds its distinct shingles of ``width`` words. Each of ``hashes`` permutations is evaluated once and
gives two signature values, its minimum and its maximum over the set. A band joins ``rows`` values of different
permutations, minima with minima and maxima with maxima; documents that share a band are candidates. With 132
permutations and 6 values a band there are 22 + 22 bands, and a pair of similarity 0.8 shares none with a chance below
two in a million. Links are confirmed on the full sets of words.

No bucket is expanded into pairs. Documents with equal sets are one class, and the class's smallest id stands for it.
A bucket's pivot is the member that meets most others over all bands; each member is compared once with every pivot
of its buckets, which also gives the two's differences. What stays apart from its pivot p
can only link to a bucket mate y by sharing differences: with D(x) the symmetric difference of x and p, similarity t
asks |D(x) & D(y)| >= (|D(x)| + |D(y)| - (|x| + |y|)(1 - t) / (1 + t)) / 2, which is at least one, and more the farther x
lies from p. So such members are joined with their bucket mates on the first elements of their differences (elements
that p lacks, then elements of p), as far as that bound and their places allow, and confirmed. That is a lossless prefix
filter: no link between components is missed inside a bucket.

Defined results: null or blank texts have an empty set and are linked with nothing; texts of fewer words than
``width`` have one shingle, the whole sequence; repeated rows share their class; rows of one id are one document: their
texts share a component, and if that id is the smallest of several sets, the set with the smallest digest is compared
for it; a row with a null id belongs to no class but its own; an id column that holds no whole numbers is an error; an
empty table gives an empty result; other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from .common import arrow_batches, bloom_buckets, bloom_filter, bloom_passes, fresh_name, integer_id, shared_table, ship_by_value

ship_by_value(__name__)

HASHES, ROWS = 132, 6
#: Shingles that are hashed at once, so that a permutation's values stay in the processor's cache.
CHUNK = 1 << 17


def word_list(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # of bytes: A-Z alone, and space and \x09-\x0D


def shingle_set(text: bytes | None, width: int) -> frozenset:
    words = word_list(text)
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*[words[i:] for i in range(width)], strict=False))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def hashed_set(text: bytes | None, width: int, hashes: dict) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a document's shingles."""
    words = word_list(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    span = min(width, len(words))
    total = np.zeros(len(words) - span + 1, np.uint64)
    for i in range(span):
        total = _mixed(total * np.uint64(0xD1342543DE82EF95) + h[i : i + len(total)] + np.uint64(span))
    return np.unique(total)


def bands_of(sets: list[np.ndarray], hashes: int, rows: int, seed: int) -> np.ndarray:
    """A row of band keys for each non-empty set."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 2**63, hashes, np.uint64) * np.uint64(2) + np.uint64(1)
    masks = rng.integers(0, 2**63, hashes, np.uint64) * np.uint64(2)
    lengths = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    x = np.concatenate(sets)
    low, high = np.empty((hashes, len(sets)), np.uint64), np.empty((hashes, len(sets)), np.uint64)
    for j in range(hashes):
        y = (x ^ masks[j]) * factors[j]
        low[j] = np.minimum.reduceat(y, starts)
        high[j] = np.maximum.reduceat(y, starts)
    keys = []
    for part, values in enumerate((low, high)):
        for b in range(hashes // rows):
            key = np.full(len(sets), np.uint64(2 * b + part + 1))
            for r in range(rows):
                key = _mixed(key * np.uint64(0xD1342543DE82EF95) + values[b * rows + r])
            keys.append(key)
    return np.stack(keys, axis=1)


def _sketcher(width: int, hashes: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()
        for whole in batches:
            texts = whole.column(1).cast(pa.binary()).to_pylist()
            sets: list[np.ndarray] = []
            at = size = 0
            for i, text in enumerate(texts):
                sets.append(hashed_set(text, width, words))
                size += len(sets[-1])
                if size >= CHUNK or i == len(texts) - 1:
                    full = [k for k, s in enumerate(sets) if len(s)]
                    keys: list = [[] for _ in sets]
                    if full:
                        for k, row in zip(full, bands_of([sets[k] for k in full], hashes, rows, seed).view(np.int64), strict=True):
                            keys[k] = row
                    digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                    yield pa.RecordBatch.from_arrays([whole.column(0).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "digest", "bands"])
                    sets, at, size = [], i + 1, 0

    return run


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, hashes: int = HASHES, rows: int = ROWS, seed: int = 7) -> DataFrame:
    """(id, n, digest, bands): set size, digest of the set, and its band keys."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(_sketcher(width, hashes, rows, seed), schema)


#: Members that are compared with one copy of their pivot's text.
PER_COPY = 256


def _comparer(width: int, percent: int, differences: bool):
    """Rows (u, v, lead, text) sorted so that u's own row (lead) comes before those of the v compared with it; holds two sets at a time."""

    def hashed(shingles: frozenset) -> list[int]:
        return sorted(xxhash.xxh3_64_intdigest(b" ".join(s)) - (1 << 63) for s in shingles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, p = None, frozenset()
        for batch in batches:
            us, vs, sizes, linked, tokens = [], [], [], [], []
            texts = batch.column(3).cast(pa.binary())
            for i, (u, v, lead) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                x = shingle_set(texts[i].as_py(), width)
                if lead:
                    pivot, p = u, x
                    continue
                if pivot != u:
                    raise RuntimeError(f"no text of {u}")
                both = len(p & x)
                us.append(u)
                vs.append(v)
                sizes.append((len(p), len(x)))
                linked.append(100 * both >= percent * (len(p) + len(x) - both))
                if differences:
                    tokens.append(hashed(x - p) + hashed(p - x))
            columns = [pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.array([a for a, _ in sizes], pa.int64()), pa.array([b for _, b in sizes], pa.int64()), pa.array(linked, pa.bool_())]
            if differences:
                columns.append(pa.array(tokens, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=COMPARED[: len(columns)])

    return run


COMPARED = ["u", "v", "u_n", "v_n", "linked", "tokens"]


def compared(pairs: DataFrame, texts: DataFrame, width: int, percent: int, differences: bool = False) -> DataFrame:
    """The distinct pairs (u, v) with their sizes and whether their full sets reach the threshold; ``differences`` adds the hashes of v without u, then of u without v.

    Every text moves to the pairs it is in, next to its partner's: u with many v is dealt over copies of u, each with about
    ``PER_COPY`` of them.
    """
    copies = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / PER_COPY).cast("long").alias("copies"))
    members = pairs.join(copies.hint("merge"), "u").select(F.col("v").alias("id"), "u", "v", F.pmod(F.xxhash64("v"), "copies").alias("copy"), F.lit(False).alias("lead"))
    leads = copies.select(F.col("u").alias("id"), "u", F.lit(None).cast("long").alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.lit(True).alias("lead"))
    roles = shared_table(members.unionByName(leads), "roles")
    rows = texts.join(roles.hint("merge"), "id").select("u", "v", "lead", "text", "copy")
    dealt = rows.repartition("u", "copy").sortWithinPartitions("u", "copy", F.desc("lead"), "v").select("u", "v", "lead", "text")
    schema = "u long, v long, u_n long, v_n long, linked boolean" + (", tokens array<long>" if differences else "")
    return dealt.mapInArrow(_comparer(width, percent, differences), schema)


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold."""
    return compared(pairs, texts, width, percent).where("linked").select("u", "v")


def _chooser(words, width: int):
    """Rows (id, text, buckets...) whose id passes the filter, with the digest of their set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            kept = batch.filter(bloom_passes(words.value, batch, 2))
            digests = [xxhash.xxh3_128_digest(hashed_set(t, width, hashes).tobytes()) for t in kept.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([kept.column(0), pa.array(digests, pa.binary()), kept.column(1)], names=["id", "digest", "text"])

    return run


def _texts_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, text) of the nodes ``wanted`` (id, digest): a Bloom filter lets map tasks drop most other texts before the exact join."""
    words = docs.sparkSession.sparkContext.broadcast(bloom_filter(wanted.select("id")))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *bloom_buckets(F.col(id_col).cast("long")))
    likely = rows.mapInArrow(_chooser(words, width), "id long, digest binary, text string")
    return likely.join(wanted.hint("merge"), ["id", "digest"], "left_semi").dropDuplicates(["id"]).select("id", "text")


def _joined_labels(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(id, component) after more links: only the components that a new link joins are worked on."""
    if labels is None:
        return shared_table(components(links), "labels")
    of = lambda end: labels.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
    ends = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select("u", "v", F.coalesce("cu", "u").alias("cu"), F.coalesce("cv", "v").alias("cv"))
    ends = shared_table(ends, "ends")
    merged = shared_table(components(ends.where("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v"))), "merged").select(F.col("id").alias("component"), F.col("component").alias("whole"))
    fresh = ends.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("cu").alias("component")), F.struct(F.col("v").alias("id"), F.col("cv").alias("component")))).alias("e")).select("e.*").distinct()
    every = labels.unionByName(fresh.join(labels.select("id"), "id", "left_anti"))
    return shared_table(every.join(merged, "component", "left").select("id", F.coalesce("whole", "component").alias("component")), "labels")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``pairs`` (id, pivot, ...) with the components of both, id_component and pivot_component."""
    of = lambda end: labels.select(F.col("id").alias(end), F.col("component").alias(f"{end}_component"))
    out = pairs.join(of("id"), "id", "left").join(of("pivot"), "pivot", "left")
    return out.withColumns({f"{end}_component": F.coalesce(f"{end}_component", end) for end in ("id", "pivot")})


def _difference_pairs(members: DataFrame, differences: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (u, v) across components among the ``members`` (pivot, id, id_component, pivot_component) of a pivot."""
    own = differences.select(F.col("u").alias("pivot"), F.col("v").alias("id"), F.col("u_n").alias("pivot_n"), F.col("v_n").alias("n"), "tokens")
    sets = own.join(members.hint("merge"), ["pivot", "id"]).withColumn("d", F.size("tokens").cast("long"))
    over, under = 100 + percent, 100 - percent
    # twice the excess of |D| over what a link to the pivot allows, in units of 1 / (100 + percent)
    excess = F.col("d") * over - (F.col("n") + F.col("pivot_n")) * under
    least_open = F.greatest(F.lit(1), F.ceil(excess / F.lit(200.0) - 1e-9))
    least_any = F.greatest(F.lit(1), F.ceil(F.col("d") * percent / F.lit(float(over)) - 1e-9))

    def prefix(rows: DataFrame, least: Column, tag: str) -> DataFrame:
        firsts = F.slice("tokens", 1, F.greatest(F.lit(0), F.col("d") - least + 1).cast("int"))
        return rows.select("pivot", F.col("id").alias(f"id_{tag}"), F.col("n").alias(f"n_{tag}"), F.col("d").alias(f"d_{tag}"), F.col("id_component").alias(f"c_{tag}"), F.posexplode(firsts).alias(f"pos_{tag}", "token"))

    x = prefix(sets.where("id_component <> pivot_component"), least_open, "x")
    y = prefix(sets, least_any, "y")
    need = F.greatest(F.lit(1), F.ceil(((F.col("d_x") + F.col("d_y")) * over - (F.col("n_x") + F.col("n_y")) * under) / F.lit(2.0 * over) - 1e-9))
    fits = (F.col("c_x") != F.col("c_y")) & (F.col("pos_x") <= F.col("d_x") - need) & (F.col("pos_y") <= F.col("d_y") - need)
    return x.join(y, ["pivot", "token"]).where(fits).select(F.least("id_x", "id_y").alias("u"), F.greatest("id_x", "id_y").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, hashes: int = HASHES, rows: int = ROWS) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept."""
    integer_id(docs, id_col)
    with arrow_batches(docs.sparkSession, 1000):
        sketch, known = _sketch_and_components(docs, id_col, text_col, width, percent, hashes, rows)
    out = sketch.select("id", "n", "digest").join(known, "digest", "left")
    component = F.coalesce(F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("component")), F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def _sketch_and_components(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, hashes: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """The sketches, and (digest, component) of every class."""
    sketch = shared_table(sketches(docs, id_col, text_col, width, hashes, rows), "sketches")
    classes = shared_table(sketch.where("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    # a node of the graph is a class's smallest id; if that id has several texts, the set with the smallest digest stands for it
    nodes = shared_table(classes.groupBy(F.col("rep").alias("id")).agg(F.min("digest").alias("digest")), "nodes")
    heads = sketch.join(nodes.hint("merge"), ["id", "digest"], "left_semi").dropDuplicates(["id"])
    members = heads.select("id", F.explode("bands").alias("band"))
    buckets = shared_table(members.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    inside = shared_table(members.join(buckets.hint("merge"), "band"), "inside")
    # a bucket's pivot meets most others over all bands
    meets = shared_table(inside.groupBy("id").agg(F.sum("size").alias("meets")), "meets")
    best = F.max(F.struct("meets", (-F.col("id")).alias("neg"))).alias("p")
    ranked = inside.join(meets.hint("merge"), "id")
    pivots = shared_table(ranked.groupBy("band").agg(best).select("band", (-F.col("p.neg")).alias("pivot")), "pivots")
    pairs = shared_table(inside.join(pivots.hint("merge"), "band").where("id <> pivot").select("id", "pivot").distinct(), "pairs")
    wanted = shared_table(nodes.join(meets.hint("merge"), "id", "left_semi"), "wanted")
    texts = shared_table(_texts_of(docs, wanted, id_col, text_col, width), "texts")
    # every member against the pivots of its buckets
    differences = shared_table(compared(pairs.select(F.col("pivot").alias("u"), F.col("id").alias("v")), texts, width, percent, differences=True), "differences")
    labels = _joined_labels(None, differences.where("linked").select("u", "v"))
    # what stays apart from a pivot whose bucket holds others: one try with the best of those, then by differences
    for turn in range(2):
        at = shared_table(_apart(pairs, labels), "at")
        open_pivots = at.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id_component") != F.col("pivot_component")).alias("n_open")).where("n_open > 0 and n > 1").select("pivot")
        left = shared_table(at.join(open_pivots, "pivot", "left_semi").select("pivot", "id", "id_component", "pivot_component"), "left")
        if left.isEmpty():
            break
        if turn == 0:
            far = left.where("id_component <> pivot_component").join(meets, "id")
            second = far.groupBy("pivot").agg(F.max_by(F.struct("id", "id_component"), F.struct("meets", (-F.col("id")).alias("neg"))).alias("s"))
            second = shared_table(second.select("pivot", F.col("s.id").alias("second"), F.col("s.id_component").alias("second_component")), "second")
            tries = far.join(second, "pivot").where("id_component <> second_component").select(F.col("second").alias("u"), F.col("id").alias("v")).distinct()
        else:
            tries = _difference_pairs(left, differences, percent)
        tries = shared_table(tries, "tries")
        if not tries.isEmpty():
            labels = _joined_labels(labels, shared_table(confirmed(tries, texts, width, percent), "late_links"))
    known = classes.join(labels.hint("merge"), classes["rep"] == labels["id"], "left").select("digest", F.coalesce("component", "rep").alias("component"))
    return sketch, shared_table(known, "known")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest, with their columns."""
    gone = near_duplicates(docs, id_col, text_col, **params).where("not kept").select(F.col(id_col).alias(fresh_name(docs.columns, "gone_id"))).distinct()
    return docs.join(gone, docs[id_col] == gone[gone.columns[0]], "left_anti")
