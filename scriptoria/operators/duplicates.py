"""Near-duplicates by matching-block ratio, and groups of exact copies.

Two texts are near-duplicates if twice the characters in their matching blocks, found from the later path's text
against the earlier one's, are at least ``threshold`` of both lengths. Equal texts are one class and are compared
once. Three ways lead to candidates:

- ``sketches`` loses nothing. With D = (1 - threshold) * (n + m) characters at most outside the matching blocks, the counts of
  single characters differ by D at most in all, and those of runs of k characters by (2k - 1) * D: a character outside
  spoils k runs of its own text and k - 1 of the other. Counts in fewer slots differ by no more. Texts are dealt by length
  into blocks of bounded size; each pair of blocks whose lengths can reach the threshold meets in one task, which compares
  counts of characters for all pairs and counts of runs for those that pass. Copies are first joined by a few runs of
  each text that are the same in most of its near copies; only pairs of different groups are compared.
- ``segments`` loses nothing either. Of n characters of the longer text and m of the other, d = (1 - threshold) * (n + m) at
  most lie outside the matching blocks. The longer one is cut into segments of s characters, more than d of them; a
  character outside the blocks, or a place where something was put in, spoils one segment at most, so of any d + 1
  segments one stands in the other text as it is, and no further than d from its place. The d + 1 segments that are
  rarest among all texts are looked up; the other side offers every run of s characters. That is a row for each
  character, of which those that are no one's segment go at once.
- ``bands`` is the cheaper variant: texts that share a band of a min-hash signature, over their words or over their runs of
  five characters. It finds nearly all, by chance.

In each bucket of either kind a few leaders, one after the other, are measured against the members that are still in no
leader's group; then the pairs whose two texts still lie in different groups are measured. So no link between groups is
lost, and copies of one text make as many pairs as they are. A pair is measured only if enough segments of one text
stand in the other, near their places, for several lengths of segments; both bounds are exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import shared_table
from .components import components

#: (bands, values a band) over words and over runs of GRAM characters; leaders of a bucket before all its pairs.
WORD_BANDS, GRAM_BANDS, GRAM, LEADERS = (50, 4), (60, 5), 5, 3
#: The longest segment, and the lengths whose bound a pair must pass before it is measured.
LONGEST, BOUND_LENGTHS = 32, (3, 5, 9)
#: Of ``sketches``: slots of characters, length of runs and their slots, texts, characters and squared lengths of a block, runs of a text for the first joins and their length.
CHAR_SLOTS, RUN, RUN_SLOTS, BLOCK_TEXTS, BLOCK_CHARS, BLOCK_SQUARES, FEW, FEW_SIZE = 64, 6, 1 << 18, 4000, 8_000_000, 3e10, 6, 16
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def exact_groups(corpus: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """doc_id, canonical (smallest path of equal texts), group_size; only groups of two and more."""
    rows = corpus.select("doc_id", "source_path", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest"))
    groups = rows.groupBy("digest").agg(F.min("source_path").alias("canonical"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    return rows.join(groups, "digest").select("doc_id", "source_path", "canonical", "group_size")


def _hashed(parts: set[str]) -> np.ndarray:
    codes = np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) for w in parts), np.uint64, len(parts))
    return (codes ^ (codes >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)


def _bands(found: np.ndarray, bands: int, rows: int, seed: int) -> list[int]:
    factors = np.random.default_rng(seed).integers(1, 2**63, bands * rows, np.uint64)
    least = np.array([((found ^ (f >> np.uint64(1))) * (f | np.uint64(1))).min() for f in factors])
    keys = np.full(bands, np.uint64(seed))
    for r in range(rows):
        keys = keys * np.uint64(0xD1342543DE82EF95) + least[r::rows]
    return (keys ^ np.arange(bands, dtype=np.uint64)).view(np.int64).tolist()


def signature(text: str) -> list[int]:
    """Band keys over the words and over the runs of characters: an edit inside a long word leaves most runs as they are."""
    runs = {text[i : i + GRAM] for i in range(max(1, len(text) - GRAM + 1))}
    return _bands(_hashed(set(text.split())), *WORD_BANDS, seed=11) + _bands(_hashed(runs), *GRAM_BANDS, seed=13)


def _signatures(texts: pd.Series) -> pd.Series:
    return texts.map(signature)


def outside(n: int, m: int, threshold: float) -> int:
    """How many of n + m characters may lie outside the matching blocks."""
    return int((1 - threshold) * (n + m) + 1e-9)


def segment_length(n: int, threshold: float) -> int:
    """The longest segment of which a text of n characters has more than it may lose against one that is not longer."""
    return max((s for s in range(1, min(LONGEST, n) + 1) if n // s > outside(n, n, threshold)), default=1)


def segment_lengths(low: int, high: int, threshold: float) -> list[int]:
    """Those of all texts of ``low`` to ``high`` characters; from some length on they are the same."""
    share = 2 * (1 - threshold)
    last = max(s for s in range(1, LONGEST + 1) if s * share < 1)
    same_from = int(1 / (1 / last - share)) + last + 1
    found = {segment_length(n, threshold) for n in range(low, min(high, same_from) + 1)}
    return sorted(found | ({last} if high > same_from else set()))


def runs(text: str, size: int) -> np.ndarray:
    """A number for each run of ``size`` characters, the same wherever the run stands."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(codes) < size:
        return np.zeros(0, np.int64)
    power = np.full(len(codes), np.uint64(_BASE))
    power[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * np.cumprod(power))])
    power = np.full(len(codes) - size + 1, np.uint64(_INVERSE))
    power[0] = 1
    found = (sums[size:] - sums[:-size]) * np.cumprod(power)
    return ((found ^ (found >> np.uint64(29))) * np.uint64(0xD1342543DE82EF95) + np.uint64(size)).view(np.int64)


def _segments(threshold: float, own_only: bool, rows: int = 1 << 16):
    """id, n, gram, pos, need: a text's runs; need is how many of its own segments are looked up (0: no segment of its own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(text)
                own, need = segment_length(n, threshold), outside(n, n, threshold) + 1
                for size in [own] if own_only else segment_lengths(n, int(n * (2 - threshold) / threshold + 1e-9), threshold):
                    grams = runs(text, size)
                    at = np.arange(len(grams))
                    mine = (at % size == 0) & (size == own)
                    if own_only:
                        grams, at, mine = grams[mine], at[mine], mine[mine]
                    for k in range(0, len(grams), rows):
                        part = slice(k, k + rows)
                        m = len(grams[part])
                        yield pa.RecordBatch.from_arrays([pa.array([id_] * m, pa.int64()), pa.array([n] * m, pa.int64()), pa.array(grams[part]), pa.array(at[part], pa.int64()), pa.array(np.where(mine[part], need, 0), pa.int64())], names=["id", "n", "gram", "pos", "need"])

    return run


def may_reach(a: str, b: str, threshold: float) -> bool:
    """False only if the two cannot reach the threshold: too many segments of the longer stand nowhere near in the other."""
    if len(a) < len(b):
        a, b = b, a
    spare = outside(len(a), len(b), threshold)
    for size in BOUND_LENGTHS:
        missing = 0
        for at in range(0, len(a) - size + 1, size):
            if b.find(a[at : at + size], max(0, at - spare), at + size + spare) < 0:
                missing += 1
                if missing > spare:
                    return False
    return True


def ratio_reaches(later: str, earlier: str, threshold: float) -> bool:
    """Whether the ratio is at least the threshold; matching blocks are looked for until too few characters can be left."""
    match = SequenceMatcher(None, later, earlier)
    if match.real_quick_ratio() < threshold or match.quick_ratio() < threshold:
        return False
    total, most = len(later) + len(earlier), min(len(later), len(earlier))
    open_parts = [(0, len(later), 0, len(earlier))]
    while open_parts:
        a, b, c, d = open_parts.pop()
        i, j, size = match.find_longest_match(a, b, c, d)
        parts = [(a, i, c, j), (i + size, b, j + size, d)] if size else []
        most += size + sum(min(x - w, z - y) for w, x, y, z in parts) - min(b - a, d - c)
        if 2.0 * most / total < threshold:
            return False
        open_parts += [p for p in parts if p[0] < p[1] and p[2] < p[3]]
    return True


def _measured(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = [may_reach(x, y, threshold) and ratio_reaches(x, y, threshold) for x, y in zip(b["later"], b["earlier"], strict=True)]
            yield b.loc[keep, ["u", "v"]]

    return run


def _dealt(rows: DataFrame, *keys: str, a_core: int = 3) -> DataFrame:
    """``rows`` dealt to all cores: few small rows that stand for much work would else be put into one task."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), a_core * spark.sparkContext.defaultParallelism), *keys)


def _reach(n: Column, m: Column, threshold: float) -> Column:
    """Two lengths can reach the threshold."""
    return F.least(n, m) >= threshold / (2 - threshold) * F.greatest(n, m)


def _bucket_links(members: DataFrame, classes: DataFrame, threshold: float, rest_of: Callable[[DataFrame], DataFrame], linked: bool = False) -> DataFrame:
    """Links (u, v) that join all near-duplicates among the ``members`` (path, n, band) of a bucket; ``classes`` has (path, t).

    ``rest_of`` gives, of members with their groups, the pairs (u, v) of different groups that are left to be measured;
    or, if ``linked``, the links among them.
    """
    later, earlier = classes.select(F.col("path").alias("u"), F.col("t").alias("later")), classes.select(F.col("path").alias("v"), F.col("t").alias("earlier"))
    measured: DataFrame | None = None
    links: DataFrame | None = None

    def grow(pairs: DataFrame) -> bool:
        """Measure the pairs (u, v) that have not been; whether any is linked."""
        nonlocal measured, links
        fresh = pairs.distinct() if measured is None else pairs.distinct().join(measured, ["u", "v"], "left_anti")
        fresh = shared_table(fresh, "pairs")
        found = shared_table(fresh.join(later, "u").join(earlier, "v").select("u", "v", "later", "earlier").transform(_dealt, "u", "v").mapInPandas(_measured(threshold), "u string, v string"), "links")
        measured = fresh if measured is None else measured.unionByName(fresh)
        links = found if links is None else links.unionByName(found)
        return not found.isEmpty()

    def grouped() -> DataFrame:
        groups = shared_table(components(links), "groups").select(F.col("id").alias("path"), "component")
        return shared_table(members.join(groups, "path", "left").withColumn("group", F.coalesce("component", "path")).drop("component"), "grouped")

    ordered = [F.greatest("path", "leader").alias("u"), F.least("path", "leader").alias("v")]
    near = _reach(F.col("n"), F.col("leader_n"), threshold)
    now, led = members.withColumn("group", F.col("path")), None
    for _ in range(LEADERS):
        rest = now
        if led is not None:  # the groups of the leaders so far, as they are now
            old = led.join(now.select("band", F.col("path").alias("leader"), "group"), ["band", "leader"]).select("band", "group").distinct()
            rest = now.join(old, ["band", "group"], "left_anti")
        leaders = shared_table(rest.groupBy("band").agg(F.min(F.struct("path", "n")).alias("l")).select("band", F.col("l.path").alias("leader"), F.col("l.n").alias("leader_n")), "leaders")
        if leaders.isEmpty():
            break
        led = leaders.select("band", "leader") if led is None else led.unionByName(leaders.select("band", "leader"))
        pairs = rest.join(leaders, "band").where((F.col("path") != F.col("leader")) & near)
        if grow(pairs.select(*ordered)) or now is members:
            now = grouped()
    if linked:
        rest = shared_table(rest_of(now), "links")
        return rest if links is None else links.unionByName(rest)
    grow(rest_of(now))
    return links


def _in_open_bands(members: DataFrame) -> DataFrame:
    """Of members with their groups, those in buckets of several groups."""
    open_bands = members.groupBy("band").agg(F.min("group").alias("a"), F.max("group").alias("b")).where("a <> b").select("band")
    return shared_table(members.join(open_bands, "band", "left_semi"), "left")


def _by_bands(classes: DataFrame, threshold: float) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Members of the buckets of more than one text, and all pairs of a bucket across groups."""
    keys = classes.select("path", F.length("t").alias("n"), F.pandas_udf(_signatures, "array<long>")("t").alias("keys"))
    bands = shared_table(keys.select("path", "n", F.explode("keys").alias("band")), "bands")
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("band")

    def rest_of(now: DataFrame) -> DataFrame:
        left = _in_open_bands(now)
        other = left.select("band", F.col("path").alias("v"), F.col("n").alias("m"), F.col("group").alias("other"))
        across = (F.col("path") > F.col("v")) & (F.col("group") != F.col("other")) & _reach(F.col("n"), F.col("m"), threshold)
        return left.join(other, "band").where(across).select(F.col("path").alias("u"), "v")

    return bands.join(shared, "band"), rest_of


def _by_segments(classes: DataFrame, threshold: float) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Members of the buckets of the rarest segments, and the pairs whose segment stands near its place in the other text."""
    texts = shared_table(classes.select("path", "t", F.monotonically_increasing_id().alias("id")), "texts")
    schema = "id long, n long, gram long, pos long, need long"
    every = lambda own: texts.select("id", "t").mapInArrow(_segments(threshold, own), schema)
    held = shared_table(every(False).join(every(True).select("gram").distinct(), "gram", "left_semi"), "held")
    counts = shared_table(held.groupBy("gram").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "counts")
    rarest = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("f", F.lit(1)), "gram", "pos"))  # segments of one text
    own = held.where("need > 0").join(counts, "gram", "left").withColumn("place", rarest)
    wanted = shared_table(own.where("place <= need and f > 1").select("gram", "id", "n", "pos"), "wanted")
    offered = shared_table(held.join(wanted.select("gram").distinct(), "gram", "left_semi").select("gram", "id", "n", "pos"), "offered")
    names = texts.select("id", "path")
    members = offered.select("gram", "id", "n").distinct().join(names, "id").select("path", "n", F.col("gram").alias("band"))

    def rest_of(now: DataFrame) -> DataFrame:
        left = _in_open_bands(now)
        groups = left.select("path", "group").distinct().join(names, "path").select("id", "path", "group")
        side = lambda rows, path, group, n, pos: rows.join(groups, "id").select("gram", F.col("path").alias(path), F.col("group").alias(group), F.col("n").alias(n), F.col("pos").alias(pos))
        a, b = side(wanted, "p", "g", "n", "at"), side(offered, "q", "h", "m", "place")
        near = (F.col("n") >= F.col("m")) & _reach(F.col("n"), F.col("m"), threshold) & (F.abs(F.col("at") - F.col("place")) <= (1 - threshold) * (F.col("n") + F.col("m")) + 1e-9)
        pairs = a.join(b, "gram").where((F.col("g") != F.col("h")) & near)
        return pairs.select(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v"))

    return members, rest_of


def _few_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, n, band: the smallest of the numbers of a text's runs, which most of its near copies share."""
    for batch in batches:
        for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            few = np.unique(runs(text, min(FEW_SIZE, len(text))))[:FEW]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(few), pa.string()), pa.array([len(text)] * len(few), pa.int64()), pa.array(few)], names=["path", "n", "band"])


def character_counts(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.bincount(codes % CHAR_SLOTS, minlength=CHAR_SLOTS).astype(np.int32)


def run_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The slots of a text's runs of RUN characters, and how many are in each."""
    slots = (runs(text, RUN).view(np.uint64) >> np.uint64(20)).astype(np.int64) % RUN_SLOTS
    found, counts = np.unique(slots, return_counts=True)
    return found.astype(np.int32), counts.astype(np.int32)


def _unit_links(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """u, v: links that join the near-duplicates of different groups between the two sides of a unit, or within its only one."""

    def spare(n: int, m: np.ndarray) -> np.ndarray:
        return ((1 - threshold) * (n + m) + 1e-9).astype(np.int64)

    def run(unit: pa.Table) -> pa.Table:
        unit = unit.sort_by("n")
        paths, texts = unit.column("path").to_pylist(), unit.column("t")
        n, side = unit.column("n").to_numpy(), unit.column("side").to_numpy()
        group = unit.column("group").combine_chunks().dictionary_encode().indices.to_numpy().copy()
        counts = np.array([character_counts(x.as_py()) for x in texts]).reshape(-1, CHAR_SLOTS)
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = unit.column("s")[0] == unit.column("u")[0] and unit.column("a")[0] == unit.column("b")[0]
        second = first if alone else second
        n_two, counts_two = n[second], counts[second]
        ratio = (2 - threshold) / threshold * (1 + 1e-9)
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        table, us, vs = np.zeros(RUN_SLOTS, np.int32), [], []

        def slots(i: int) -> tuple[np.ndarray, np.ndarray]:
            if i not in found:
                found[i] = run_counts(texts[i].as_py())
            return found[i]

        for k, i in enumerate(first):
            low = k + 1 if alone else np.searchsorted(n_two, n[i] / ratio)
            near = slice(low, np.searchsorted(n_two, n[i] * ratio, "right"))
            most = spare(n[i], n_two[near])
            passed = (group[second[near]] != group[i]) & (np.abs(counts_two[near] - counts[i]).sum(1) <= most)
            if not passed.any():
                continue
            own, held = slots(i)
            table[own] = held
            for j, d in zip(second[near][passed], most[passed], strict=True):
                other, many = slots(j)
                apart = held.sum() + many.sum() - 2 * np.minimum(table[other], many).sum()
                if apart > (2 * RUN - 1) * d or group[i] == group[j]:
                    continue
                (u, later), (v, earlier) = sorted(((paths[x], texts[x].as_py()) for x in (i, j)), reverse=True)
                if may_reach(later, earlier, threshold) and ratio_reaches(later, earlier, threshold):
                    us.append(u)
                    vs.append(v)
                    group[group == group[j]] = group[i]  # one group from now on
            table[own] = 0
        return pa.table({"u": pa.array(us, pa.string()), "v": pa.array(vs, pa.string())})

    return run


def _by_sketches(classes: DataFrame, threshold: float) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Members of the buckets of a few runs, and the links of different groups among texts whose counts of characters and of runs are close enough."""
    bands = shared_table(classes.select("path", "t").mapInArrow(_few_runs, "path string, n long, band long"), "bands")
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("band")
    # lengths that can reach the threshold are in the same step or in neighbouring ones, there within half a step of the border
    half = math.log((2 - threshold) / threshold * (1 + 1e-6))
    step_of = lambda by: F.floor((F.log(F.col("n")) + by) / (2 * half))

    def rest_of(now: DataFrame) -> DataFrame:
        groups = now.select("path", "group").distinct()
        rows = classes.select("path", "t", F.length("t").cast("long").alias("n")).join(groups, "path", "left")
        rows = rows.select("path", "t", "n", F.coalesce("group", "path").alias("group"), step_of(0.0).alias("step"), step_of(-half).alias("low"), step_of(half).alias("high"))
        sizes = shared_table(rows.groupBy("step").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_TEXTS, F.sum("n") / BLOCK_CHARS, F.sum(F.col("n").cast("double") * F.col("n")) / BLOCK_SQUARES)).cast("int").alias("blocks")), "steps")
        beside = lambda name, by: sizes.select((F.col("step") + by).alias("step"), F.col("blocks").alias(name))
        around = sizes.join(beside("below", 1), "step", "left").join(beside("above", -1), "step", "left")
        rows = rows.join(F.broadcast(around), "step").withColumn("block", F.pmod(F.xxhash64("path"), "blocks").cast("int"))
        unit = lambda s, a, u, b, side: F.struct(s.alias("s"), a.alias("a"), u.alias("u"), b.alias("b"), side.alias("side"))
        own, at, each = F.col("step"), F.col("block"), lambda blocks: F.sequence(F.lit(0), F.coalesce(blocks, F.lit(1)) - 1)
        inside = F.transform(each(F.col("blocks")), lambda b: unit(own, F.least(b, at), own, F.greatest(b, at), F.when(at > b, 1).otherwise(0)))
        above = F.when(F.col("above").isNotNull() & (F.col("high") > own), F.transform(each(F.col("above")), lambda b: unit(own, at, own + 1, b, F.lit(0))))
        below = F.when(F.col("below").isNotNull() & (F.col("low") < own), F.transform(each(F.col("below")), lambda b: unit(own - 1, b, own, at, F.lit(1))))
        none = F.array().cast("array<struct<s:bigint,a:int,u:bigint,b:int,side:int>>")
        units = rows.select("path", "t", "n", "group", F.inline(F.concat(inside, F.coalesce(above, none), F.coalesce(below, none))))
        return _dealt(units, "s", "a", "u", "b", a_core=16).groupBy("s", "a", "u", "b").applyInArrow(_unit_links(threshold), "u string, v string")

    return bands.join(shared, "band"), rest_of


def near_duplicate_groups(corpus: DataFrame, text_col: str = "raw_text", threshold: float = 0.96, sample_chars: int | None = None, preferred: DataFrame | None = None, candidates: str = "sketches") -> DataFrame:
    """doc_id, source_path, duplicate_of (the group's canonical path); only documents that are not canonical.

    ``sample_chars`` limits the comparison to the start of each text, as small installations want it; the default
    compares whole texts. ``preferred`` (source_path, canonical) holds earlier choices: the path of the group with
    most votes is canonical, of equal votes the smallest; without votes the smallest path. ``candidates`` is ``sketches`` or
    ``segments`` (no link is lost; thresholds over a half) or ``bands``.
    """
    ways = {"sketches": _by_sketches, "segments": _by_segments, "bands": _by_bands}
    if candidates not in ways or (candidates != "bands" and not 0.5 < threshold <= 1):
        raise ValueError(f"no candidates {candidates!r} for a threshold of {threshold}")
    text = F.col(text_col) if sample_chars is None else F.substring(F.col(text_col), 1, sample_chars)
    rows = corpus.select("doc_id", "source_path", text.alias("t")).where(F.length(F.trim(F.translate("t", "\n\t\r\f", "    "))) > 0)
    rows = rows.withColumn("digest", F.sha2("t", 256))
    paths = shared_table(rows.select("doc_id", "source_path", "digest"), "paths")
    heads = paths.groupBy("digest").agg(F.min("source_path").alias("path"))
    first = heads.select("path", F.col("digest").alias("own"))
    classes = shared_table(rows.withColumnRenamed("source_path", "path").transform(_dealt, "path").join(first, "path").where("digest = own").select("path", "t").dropDuplicates(["path"]), "classes")
    members, rest_of = ways[candidates](classes, threshold)
    links = _bucket_links(shared_table(members, "members"), classes, threshold, rest_of, linked=candidates == "sketches")
    joined = shared_table(components(links), "joined")
    named = heads.join(joined, heads["path"] == joined["id"], "left").select("digest", F.coalesce("component", "path").alias("component"))
    grouped = shared_table(paths.join(named, "digest"), "grouped")
    canonical = grouped.groupBy("component").agg(F.min("source_path").alias("canonical"), F.count(F.lit(1)).alias("size")).where("size > 1")
    if preferred is not None:
        chosen = grouped.join(preferred.select("source_path", F.col("canonical").alias("wish")), "source_path")
        inside = chosen.join(grouped.select(F.col("source_path").alias("wish"), F.col("component").alias("wish_component")), "wish").where("component = wish_component")
        votes = inside.groupBy("component", "wish").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.min(F.struct((-F.col("n")).alias("n"), "wish")).alias("v"))
        canonical = canonical.join(votes, "component", "left").select("component", F.coalesce("v.wish", "canonical").alias("canonical"), "size")
    return grouped.join(canonical, "component").where("source_path <> canonical").select("doc_id", "source_path", F.col("canonical").alias("duplicate_of"))


def promoted(groups: DataFrame, chosen: DataFrame) -> DataFrame:
    """source_path, duplicate_of after ``chosen`` paths (source_path) became canonical in their groups.

    ``groups`` has (source_path, duplicate_of) of what is not canonical. The former canonical is now a duplicate, and all
    others of the group double the chosen one; of several chosen in one group the smallest path is taken.
    """
    picked = groups.join(chosen.select("source_path"), "source_path", "left_semi").groupBy("duplicate_of").agg(F.min("source_path").alias("fresh"))
    members = groups.select("source_path", "duplicate_of").unionByName(groups.select(F.col("duplicate_of").alias("source_path"), "duplicate_of").distinct())
    rows = members.join(picked, "duplicate_of", "left").withColumn("canonical", F.coalesce("fresh", "duplicate_of"))
    return rows.where("source_path <> canonical").select("source_path", F.col("canonical").alias("duplicate_of"))


def _steps(a: list[str], b: list[str]) -> Iterator[tuple[str, int, int, int, int]]:
    """(op, from, to, from, to) over two lists of lines by their matching blocks; a replacement takes lines away and puts others in."""
    for op, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            yield op, i, j, k, m
        else:
            if j > i:
                yield "delete", i, j, k, k
            if m > k:
                yield "insert", j, j, k, m


def _aligned(older: pd.Series, newer: pd.Series) -> pd.DataFrame:
    out = []
    for a, b in zip(older, newer, strict=True):
        n = {"equal": 0, "delete": 0, "insert": 0}
        for op, i, j, k, m in _steps(*(list(x) if x is not None else [] for x in (a, b))):
            n[op] += max(j - i, m - k)
        out.append((n["equal"], n["delete"], n["insert"]))
    return pd.DataFrame(out, columns=["n_equal", "n_only_first", "n_only_second"])


def line_diff(first: Column, second: Column) -> Column:
    """struct<n_equal,n_only_first,n_only_second>: two arrays of lines side by side, aligned by their matching blocks."""
    return F.pandas_udf(_aligned, "n_equal long, n_only_first long, n_only_second long")(first, second)


def _line_rows(rows_at_once: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["id", "seq", "op", "first_no", "second_no", "line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a, b = (batch.column(c)[r].as_py() or [] for c in (1, 2))
                seq = 0
                for op, i, j, k, m in _steps(a, b):
                    lines, at = (b, k) if op == "insert" else (a, i)
                    for start in range(0, max(j - i, m - k), rows_at_once):
                        n = min(rows_at_once, max(j - i, m - k) - start)
                        place = lambda begin, has: pa.array(np.arange(begin + start, begin + start + n), pa.int64()) if has else pa.nulls(n, pa.int64())  # noqa: B023, E731
                        own = lines[at + start : at + start + n]
                        columns = [pa.repeat(batch.column(0)[r], n), pa.array(np.arange(seq, seq + n), pa.int64()), pa.array([op] * n), place(i, op != "insert"), place(k, op != "delete"), pa.array(own, pa.string())]
                        yield pa.RecordBatch.from_arrays(columns, names=names)
                        seq += n

    return run


def aligned_lines(pairs: DataFrame, id_col: str, first: Column, second: Column, rows_at_once: int = 10_000) -> DataFrame:
    """id_col, seq, op, first_no, second_no, line: two arrays of lines of each row side by side, a row a line.

    ``op`` is equal, delete (of the first alone) or insert (of the second alone); places count from 0 and are null where a
    side lacks the line. The rows without inserts are the first side, those without deletes the second. A task holds one
    pair and at most ``rows_at_once`` lines of its result. Null arrays have no lines; pairs without lines give no row;
    repeated ids give the rows of each.
    """
    kind = pairs.schema[id_col].dataType.simpleString()
    rows = pairs.select(F.col(id_col).alias("id"), first.alias("first"), second.alias("second"))
    out = rows.mapInArrow(_line_rows(rows_at_once), f"id {kind}, seq long, op string, first_no long, second_no long, line string")
    return out.withColumnRenamed("id", id_col)


def rebuilt(aligned: DataFrame, id_col: str, second: bool = False) -> DataFrame:
    """id_col, n_lines, text: one side put together again from the rows of :func:`aligned_lines`; ids without rows are not there."""
    place = "second_no" if second else "first_no"
    lines = F.transform(F.array_sort(F.collect_list(F.struct(place, "line"))), lambda x: x["line"])  # the lines of one text
    return aligned.where(F.col(place).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n_lines"), F.array_join(lines, "\n").alias("text"))
