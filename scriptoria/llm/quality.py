"""Quality classifier: an interpolated modified Kneser-Ney model of characters, trained on trusted text.

N-grams are runs of ``order`` characters (runs of white space are one space) with marks before and after a document.
A Bloom filter of fixed size over the trusted ids lets map tasks drop most other texts; what it lets pass is counted in
the tasks and added up by Spark. Ids that pass without being trusted come out of an exact join of ids, and the counts
of their documents are taken off again. Lower orders count distinct left neighbours. Every
order has three discounts, from its counts of counts, and each context gives the mass it saves to the next lower
order. All of this is joins and sums over (language, n-gram) tables, one model for each language.

Scoring is sharded. A task packs its documents into shards of about ``shard_chars`` characters; each shard asks for its
distinct n-grams once (the input is read twice, so it must be a table, or written as one: rows in another order are an error); the distinct n-grams of all shards are joined with the model, order by order; each shard gets
its answers back together with its packed documents and adds up their logarithms. A document's perplexity is per
character. Short texts score higher and scatter more, so it is adjusted to the length n: over all trusted documents
of a language its logarithm is fitted as a line in 1/(n + 1) (the marks cost about the same in every text), and the
distance from that line as a line in 1/sqrt(n + 1). A document is accepted if its distance, in units of the one
expected at its length, lies between two quantiles of the language's trusted documents: above the upper one text is
unlike the language, below the lower one it repeats itself. The rule is the same for every number of documents.

Defined results: null or blank text, and text of a language without trusted text, have null perplexity and are not
accepted; null language is a language of its own; repeated rows are scored each; labels without a document do
nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom_buckets, bloom_filter, bloom_passes, integer_id, shared_table, ship_by_value

ship_by_value(__name__)

ORDER, QUANTILE, LEAST = 4, 0.99, 0.001
BEGIN, END = "\x02", "\x03"
#: White space besides the space itself.
WHITE = [chr(i) for i in range(0x20)]


def prepared(text: str | None) -> str:
    """Each run of white space as one space: few of its characters occur, and a search for one is far cheaper than a pattern."""
    text = text or ""
    for c in WHITE:
        if c in text:
            text = text.replace(c, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return text.strip()


def gram_codes(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(characters of all texts, where each n-gram starts, its code, its text); equal n-grams have equal codes.

    A code packs places in the alphabet of these texts; where too many different characters leave no room for all of
    ``order``, codes are numbered anew before each further character.
    """
    c = np.frombuffer("".join(BEGIN * (order - 1) + t + END for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    there = np.zeros(0x110000, bool)
    there[c] = True
    place = np.zeros(0x110000, np.uint64)
    place[there] = np.arange(np.count_nonzero(there), dtype=np.uint64)
    ids = place[c]
    bits = max(1, (int(np.count_nonzero(there)) - 1).bit_length())
    codes, used = ids[: len(ids) - order + 1].copy(), bits
    for j in range(1, order):
        if used + bits > 64:
            codes = np.unique(codes, return_inverse=True)[1].astype(np.uint64)
            used = len(codes).bit_length()
        codes = (codes << np.uint64(bits)) | ids[j : j + len(codes)]
        used += bits
    lengths = np.array([len(t) + order for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), lengths)[order - 1 :]
    real = np.flatnonzero(c[order - 1 :] != ord(BEGIN))
    return c, real, codes[real], doc[real]


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different code stands first, by code, and for every code which of them it is; by hashing, so only the different ones are sorted."""
    at = pa.array(codes).dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(np.diff(np.maximum.accumulate(at), prepend=np.int32(-1)))
    order = np.argsort(codes[first])
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return first[order], place[at]


def spelled(c: np.ndarray, starts: np.ndarray, order: int) -> pa.Array:
    """The n-grams that start there, as strings of exactly ``order`` characters."""
    chars = np.stack([c[starts + j] for j in range(order)], axis=1)
    return pa.array(np.ascontiguousarray(chars, np.uint32).view(f"<U{order}").ravel())


def _blocks(texts: Iterable[tuple], size: int) -> Iterator[list[tuple]]:
    held, n = [], 0
    for row in texts:
        held.append(row)
        n += len(row[-1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _likely(words):
    """Rows (id, lang, text, buckets...) that pass the filter, their text packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(bloom_passes(words.value, batch, 3))
            packs = [zstandard.compress(prepared(t).encode("utf-8", "surrogatepass"), 3) for t in kept.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(packs, pa.binary())], names=["id", "lang", "pack"])

    return run


def _passing(words):
    """The ids of the rows (id, buckets...) that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.filter(bloom_passes(words.value, batch, 1)).column(0)], names=["id"])

    return run


def _counted(of_lang: dict[str, list[tuple]], order: int, sign: int, block: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """(lang, g, c) of prepared texts by language, in blocks."""
    for lang, rows in of_lang.items():
        for held in _blocks(rows, block):
            c, starts, codes, _ = gram_codes([r[0] for r in held], order)
            at, which = distinct(codes)
            counts = np.bincount(which, minlength=len(at))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), spelled(c, starts[at], order), pa.array(sign * counts, pa.int64())], names=["lang", "g", "c"])


def _counter(words, order: int):
    """Counts of the rows (id, lang, text, buckets...) that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(bloom_passes(words.value, batch, 3))
            by_lang: dict = {}
            for lang, text in zip(kept.column(1).to_pylist(), kept.column(2).to_pylist(), strict=True):
                if clean := prepared(text):
                    by_lang.setdefault(lang, []).append((clean,))
            yield from _counted(by_lang, order, 1)

    return run


def _uncounter(order: int):
    """The counts of packed texts, to be taken off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict = {}
            for pack, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if clean := zstandard.decompress(pack).decode("utf-8", "surrogatepass"):
                    by_lang.setdefault(lang, []).append((clean,))
            yield from _counted(by_lang, order, -1)

    return run


def trusted_packs(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, lang_col: str, order: int = ORDER) -> DataFrame:
    """(lang, g, c): n-gram counts of the trusted documents, packed by task: rows of one n-gram are to be added up.

    Every document that passes the filter of the ``trusted`` ids is counted where it is read; those of them that are not
    trusted are taken off again. So no trusted text is shuffled: the exact join meets ids, and only texts that pass
    without being trusted are sent to it.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast
    known = trusted.select(F.col(id_col).cast("long").alias("id"))
    words = broadcast(bloom_filter(known))
    key = F.col(id_col).cast("long")
    there = docs.where(F.col(id_col).isNotNull())
    passing = there.select(key.alias("id"), *bloom_buckets(key)).mapInArrow(_passing(words), "id long")
    wrong = shared_table(passing.distinct().join(known.hint("merge"), "id", "left_anti"), "wrong")
    rows = there.where(F.col(text_col).isNotNull()).select(key.alias("id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.col(text_col).alias("text"), *bloom_buckets(key))
    counts = "lang string, g string, c long"
    every = rows.mapInArrow(_counter(words, order), counts)
    if wrong.isEmpty():
        return every
    likely = rows.mapInArrow(_likely(broadcast(bloom_filter(wrong))), "id long, lang string, pack binary")
    off = likely.join(wrong.hint("merge"), "id", "left_semi").select("pack", "lang").mapInArrow(_uncounter(order), counts)
    return every.unionByName(off)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney, kept between 0.05 (each context saves some mass) and the count that they lower."""
    if not n1 or not n2:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), float(i + 1)) for i, d in enumerate(raw))


def train(counted: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """For each order 1..order: (lang, g, p) of seen n-grams and (lang, ctx, gamma) of seen contexts, from the rows of :func:`trusted_packs`."""
    spark = counted.sparkSession
    counted = counted.groupBy("lang", "g").agg(F.sum("c").alias("c")).where("c > 0")
    counts = {order: shared_table(counted, "top")}
    for k in range(order - 1, 0, -1):
        counts[k] = shared_table(counts[k + 1].groupBy("lang", F.expr(f"right(g, {k})").alias("g")).agg(F.count(F.lit(1)).alias("c")), f"order{k}")
    model: list[tuple[DataFrame, DataFrame]] = []
    for k in range(1, order + 1):
        of = counts[k].groupBy("lang").agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5)], F.count(F.lit(1)).alias("types")).collect()  # one row a language
        cuts = spark.createDataFrame([(r["lang"], *discounts(r["n1"], r["n2"], r["n3"], r["n4"]), r["types"] + 1) for r in of], "cut_lang string, d1 double, d2 double, d3 double, base long")
        own = counts[k].withColumn("ctx", F.expr(f"left(g, {k - 1})")).join(F.broadcast(cuts), F.col("lang") == F.col("cut_lang"))
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        sums = own.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), (F.sum(cut) / F.sum("c")).alias("gamma"), F.max("base").alias("base"))
        contexts = shared_table(sums, f"contexts{k}")
        joined = own.drop("base").join(contexts, ["lang", "ctx"])
        first = F.greatest(F.col("c") - cut, F.lit(0.0)) / F.col("total")
        if k == 1:
            seen = joined.select("lang", "g", (first + F.col("gamma") / F.col("base")).alias("p"))
            gammas = contexts.select("lang", "ctx", (F.col("gamma") / F.col("base")).alias("gamma"))  # what an unseen character gets
        else:
            lower = model[-1][0].select("lang", F.col("g").alias("low"), F.col("p").alias("q"))
            seen = joined.withColumn("low", F.expr(f"right(g, {k - 1})")).join(lower, ["lang", "low"]).select("lang", "g", (first + F.col("gamma") * F.col("q")).alias("p"))
            gammas = contexts.select("lang", "ctx", "gamma")
        model.append((shared_table(seen, f"seen{k}"), shared_table(gammas, f"gammas{k}")))
    return model


def _by_lang(rows: list[tuple]) -> dict[str, list[tuple[int, str]]]:
    out: dict[str, list[tuple[int, str]]] = {}
    for i, (_, lang, text) in enumerate(rows):
        if text:
            out.setdefault(lang, []).append((i, text))
    return out


def _shards(batches: Iterator[pa.RecordBatch], shard_chars: int) -> Iterator[tuple[int, list[tuple]]]:
    """(shard, rows of (id, lang, text)) of about so many characters: the same shards each time that a table is read."""
    part = TaskContext.get().partitionId()
    rows = ((i, lang, prepared(t)) for batch in batches for i, lang, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
    for seq, held in enumerate(_blocks(rows, shard_chars)):
        yield (part << 32) | seq, held


def _packer(shard_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, held in _shards(batches, shard_chars):
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([zstandard.compress(pickle.dumps(held), 5)], pa.binary())], names=["shard", "pack"])

    return run


def _asker(order: int, shard_chars: int):
    """The distinct n-grams of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _shards(batches, shard_chars):
            for lang, texts in _by_lang(rows).items():
                parts = []
                for held in _blocks(texts, 1 << 20):
                    c, starts, codes, _ = gram_codes([t for _, t in held], order)
                    parts.append(spelled(c, starts[distinct(codes)[0]], order))
                grams = pa.chunked_array(parts).unique().sort() if len(parts) > 1 else parts[0]
                for chunk in grams.chunks if isinstance(grams, pa.ChunkedArray) else [grams]:
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * len(chunk), pa.int64()), pa.array([lang] * len(chunk), pa.string()), chunk], names=["shard", "lang", "g"])

    return run


def _scorer(order: int):
    def run(packs: pa.Table, answers: pa.Table) -> pa.Table:
        ids, langs, lengths, sums = [], [], [], []
        answers = answers.combine_chunks()
        for pack in packs.column("pack").to_pylist():
            rows = pickle.loads(zstandard.decompress(pack))
            total: list = [None] * len(rows)
            for lang, texts in _by_lang(rows).items():
                own = answers.filter(pc.equal(answers.column("lang"), lang))
                if not own.num_rows:
                    continue
                grams, logs = own.column("g").combine_chunks(), own.column("logp").to_numpy()
                for held in _blocks(texts, 1 << 20):
                    c, starts, codes, doc = gram_codes([t for _, t in held], order)
                    first, at = distinct(codes)
                    found = pc.index_in(spelled(c, starts[first], order), value_set=grams)
                    if found.null_count:
                        raise RuntimeError("an n-gram was never asked for")
                    values = np.bincount(doc, logs[found.to_numpy()][at], len(held))
                    for (i, _), v in zip(held, values.tolist(), strict=True):
                        total[i] = v
            for (doc_id, lang, text), v in zip(rows, total, strict=True):
                ids.append(doc_id)
                langs.append(lang)
                lengths.append(len(text))
                sums.append(v)
        return pa.table({"id": pa.array(ids, pa.int64()), "lang": pa.array(langs, pa.string()), "n_chars": pa.array(lengths, pa.int64()), "logp": pa.array(sums, pa.float64())})

    return run


def answers_of(asked: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(lang, g, logp) for distinct (lang, g): seen n-grams as they are, others by their contexts' weights."""
    order = len(model)
    now = None
    for k in range(1, order + 1):
        seen, gammas = model[k - 1]
        mine = asked if k == order else asked.select("lang", F.expr(f"right(g, {k})").alias("g")).distinct()
        mine = mine.withColumn("ctx", F.expr(f"left(g, {k - 1})")).join(seen, ["lang", "g"], "left").join(gammas, ["lang", "ctx"], "left")
        if k == 1:
            now = mine.select("lang", "g", F.coalesce("p", "gamma").alias("p"))
        else:
            low = now.select("lang", F.col("g").alias("low"), F.col("p").alias("q"))
            now = mine.withColumn("low", F.expr(f"right(g, {k - 1})")).join(low, ["lang", "low"]).select("lang", "g", F.coalesce("p", F.coalesce("gamma", F.lit(1.0)) * F.col("q")).alias("p"))
        now = shared_table(now, f"answers{k}")
    return now.where("p is not null").select("lang", "g", F.log("p").cast("float").alias("logp"))


def perplexities(docs: DataFrame, model: list[tuple[DataFrame, DataFrame]], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", shard_chars: int = 16 << 20) -> DataFrame:
    """(id, lang, n_chars, perplexity) of each row; n_chars counts the prepared text."""
    order = len(model)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.col(text_col).alias("text"))
    packs = rows.mapInArrow(_packer(shard_chars), "shard long, pack binary")
    asked = shared_table(rows.mapInArrow(_asker(order, shard_chars), "shard long, lang string, g string"), "asked")
    answers = answers_of(shared_table(asked.select("lang", "g").distinct(), "wanted"), model)
    replies = asked.join(answers, ["lang", "g"]).select("shard", "lang", "g", "logp")
    scored = packs.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(_scorer(order), "id long, lang string, n_chars long, logp double")
    return scored.select("id", "lang", "n_chars", F.exp(-F.col("logp") / (F.col("n_chars") + 1)).alias("perplexity"))


def verdicts(scored: DataFrame, trusted: DataFrame, quantile: float, least: float) -> DataFrame:
    """``scored`` (id, lang, n_chars, perplexity) with threshold, floor and accepted; ``trusted`` has the one column id."""
    y, x, root = F.log("perplexity"), 1 / (F.col("n_chars") + 1), 1 / F.sqrt(F.col("n_chars") + 1)
    known = scored.where("perplexity is not null").join(trusted, "id", "left_semi")
    slope = F.coalesce(F.regr_slope(y, x), F.lit(0.0))
    levels = shared_table(known.groupBy("lang").agg(slope.alias("slope"), (F.avg(y) - slope * F.avg(x)).alias("level")), "levels")
    off = y - F.col("level") - F.col("slope") * x
    spread = F.greatest(F.coalesce(F.regr_slope(F.abs(off), root), F.lit(0.0)), F.lit(0.0))
    # a tenth of the mean at least, so that the spread stays positive at every length
    base = F.greatest(F.avg(F.abs(off)) - spread * F.avg(root), F.avg(F.abs(off)) / 10, F.lit(1e-9))
    spreads = known.join(levels, "lang").groupBy("lang", "level", "slope").agg(spread.alias("spread"), base.alias("base"))
    fitted = shared_table(spreads, "spreads")
    unit = F.col("base") + F.col("spread") * root
    cuts = shared_table(known.join(fitted, "lang").groupBy("lang", "level", "slope", "spread", "base").agg(F.percentile_approx(off / unit, [least, quantile], 10000).alias("cut")), "cuts")
    # the documents at the quantiles are accepted in spite of rounding
    at = lambda i: F.exp(F.col("level") + F.col("slope") * x + F.get("cut", F.lit(i)) * unit)
    out = scored.join(cuts, "lang", "left").withColumn("threshold", at(1) * (1 + 1e-9)).withColumn("floor", at(0) * (1 - 1e-9))
    return out.select("id", "lang", "n_chars", "perplexity", "threshold", "floor", F.coalesce(F.col("perplexity").between(F.col("floor"), F.col("threshold")), F.lit(False)).alias("accepted"))


def classify(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, quantile: float = QUANTILE, least: float = LEAST) -> DataFrame:
    """One row per input row: id, lang, n_chars, perplexity, threshold, floor, accepted. ``trusted_ids`` has the one column ``id_col``."""
    integer_id(docs, id_col)
    trusted = trusted_ids.select(F.col(id_col)).where(F.col(id_col).isNotNull()).distinct()
    model = train(trusted_packs(docs, trusted, id_col, text_col, lang_col, order), order)
    scored = shared_table(perplexities(docs, model, id_col, text_col, lang_col), "perplexities")
    out = verdicts(scored, trusted.select(F.col(id_col).cast("long").alias("id")), quantile, least)
    return out.select(F.col("id").alias(id_col), F.nullif(F.col("lang"), F.lit("")).alias("lang"), "n_chars", "perplexity", "threshold", "floor", "accepted")
