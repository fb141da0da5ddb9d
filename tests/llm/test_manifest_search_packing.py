"""Merkle manifest, ranked search and packing: against SQL (test_llm), brute force and round trips, with the odd cases of each."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from scriptoria.llm import lexical, merkle, packing, queries

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "   \n\t ", "en", "s", 6), (4, "one", None, "s", 3), (4, "one", None, "s", 3), (5, "one  two", "en", None, 8), (None, "three", "en", "s", 5), (6, "12 34 !!", "en", "s", 8)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, blank and one-word texts, a repeated row, clashing names of other columns."""
    out = spark.createDataFrame(ODD, DOC)
    for name in ("Root", "PROOF", "row", "g", "pos", "block", "key", "length", "bin", "rank", "Score"):
        out = out.withColumn(name, F.lit(1))
    return out


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


# 11 Merkle manifest


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes, fanout):
    """All levels, and the siblings (left, right) of each leaf."""
    beside = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = i // fanout * fanout
            beside[leaf].append((nodes[run:i], nodes[i + 1 : run + fanout]))
        nodes = [H(nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], beside


@pytest.mark.parametrize("fanout, block_levels, sizes", [(8, 0, [1, 9, 70, 2]), (8, 1, [600, 1, 64, 65, 8]), (2, 1, [33, 1, 5, 16, 7, 2, 3, 40, 1, 1, 1]), (3, 2, [100]), (8, 4, [1])])
def test_butterfly_like_one_tree(spark, fanout, block_levels, sizes):
    """Blocks of a few leaves, so that most levels are exchanged; ragged ends, groups of all sizes, a null group."""
    rows = [(str(g) if g else None, i, H([f"{g}/{i}"])) for g, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    leaves = spark.createDataFrame(rows, "lang string, doc_id long, leaf string").repartition(5)
    found, (subroot, root, proof) = merkle.prove(leaves, "leaf", "lang", "doc_id", fanout, block_levels)
    got = found.withColumn("folded", merkle.fold(F.col("leaf"), F.col(proof))).collect()
    assert len(got) == len(rows)
    trees = {}
    for g in {r[0] for r in rows}:
        trees[g] = climb([H([f"{g or 0}/{i}"]) for i in range(sizes[int(g or 0)])], fanout)
    order = sorted(trees, key=lambda g: ("" if g is None else f"={g}").encode())
    want_root, above = climb([trees[g][0] for g in order], fanout)
    for r in got:
        own, beside = trees[r["lang"]]
        want = [("".join(a), "".join(b)) for a, b in beside[r["doc_id"]] + above[order.index(r["lang"])]]
        assert r[subroot] == own and r[root] == want_root == r["folded"] and [tuple(s) for s in r[proof]] == want


def test_manifest_odd_rows(spark, odd, none):
    def roots(docs):
        leaves = docs.withColumn("leaf", merkle.record_hash([F.col(c) for c in merkle.FIELDS]))
        found, names = merkle.prove(leaves, "leaf", "lang", "doc_id")
        assert len({c.lower() for c in found.columns}) == len(found.columns)
        return [r[names[1]] for r in found.collect()]

    assert len(roots(odd)) == len(ODD) and len(set(roots(odd))) == 1
    assert roots(odd)[0] == roots(odd.orderBy(F.desc("n_chars")))[0]  # the order of arrival does not matter
    assert roots(none) == []
    said = spark.createDataFrame([(1, None, "é", "", 7)], DOC).select(merkle.record_hash([F.col(c) for c in merkle.FIELDS])).first()[0]
    assert said == hashlib.sha256("1:10:2:é1:7-".encode()).hexdigest()


def test_manifest_finds_every_tampered_row(spark, sf_dir):
    got = queries.op11_merkle_manifest(spark, sf_dir).join(queries.table(spark, sf_dir, "documents"), "doc_id").collect()
    for r in got:
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and re.search("[A-Z]", r["text"] or "")
        assert r["verified"] == (not changed)


# 12 ranked search


def ranked(docs, items, k):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(d, Counter(words(t))) for d, t in docs]
    live = [sum(b.values()) for _, b in bags if b]
    n, total = len(live), sum(live)
    holders = Counter(w for _, b in bags for w in b)
    out = {}
    for item, text in items:
        scores = []
        for d, b in bags:
            m = 10 + 90 * sum(b.values()) * n // total if b else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * holders[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 8 * m)) for w in set(words(text)) if w in b)
            if s > 0:
                scores.append((-s, math.inf if d is None else d))
        out[item] = [(-s, d) for s, d in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("shard_bytes", [300, 20_000, 8 << 20])
def test_search_like_brute_force(spark, monkeypatch, shard_bytes):
    """Common and rare words, equal texts (ties), shards of a few documents and one of all, several blocks of queries, windows passed over."""
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "ñandú", "straße"]
    text = lambda n: " ".join(rnd.choice(vocabulary[: int(3 + 300 * rnd.random() ** 3)]) for _ in range(n)).title()
    docs = [(i, text(rnd.choice([1, 5, 40, 200]))) for i in range(1500)]
    docs += [(2000 + i, docs[7][1]) for i in range(30)] + [(3000, None), (3001, ""), (3002, " .,!"), (None, docs[7][1]), (3003, "x" * 100_000)]
    items = [(i, text(rnd.choice([1, 6, 30]))) for i in range(12)] + [(50, "no such word"), (51, None), (52, ""), (53, docs[7][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = lexical.build(frame, shard_bytes=shard_bytes)
    assert index.select(F.sum(F.size("doc_ids"))).first()[0] == len(docs)
    got = defaultdict(list)
    for r in lexical.search(index, spark.createDataFrame(items, "item_id int, text string"), block_bytes=500).orderBy("item_id", "rank").collect():
        got[r["item_id"]].append((r["score"], math.inf if r["doc_id"] is None else r["doc_id"]))
        assert r["rank"] == len(got[r["item_id"]])
    want = ranked(docs, items, 10)
    assert dict(got) == {i: w for i, w in want.items() if w}


def test_search_odd_rows(spark, odd, none):
    items = spark.createDataFrame([("a", "one"), ("a", "one"), ("b", None)], "item_id string, text string")
    got = lexical.search(lexical.build(odd), items).collect()
    assert sorted((r["item_id"], r["rank"], r["doc_id"]) for r in got) == sorted([("a", 1, 4), ("a", 2, 4), ("a", 3, 5)] * 2)
    assert lexical.search(lexical.build(none), items).count() == 0
    assert lexical.search(lexical.build(odd), items.limit(0)).count() == 0


def test_search_passes_windows_over(spark):
    """Windows that cannot reach the best are not read: of 40 windows with the common word alone, few are."""
    import numpy as np
    import pyarrow as pa

    n = 40 * lexical.WINDOW
    texts = pa.array([b"common " * 3 + (b"rare" if i < 20 else b"")for i in range(n)], pa.large_binary())
    batch = lexical._shard([pa.array(range(n), pa.int64())], [texts])
    row = {c: batch.column(c)[0].values for c in ("doc_ids", "lengths", "terms", "ends", "docs", "counts")}
    shard = lexical.Shard(row, pa.array([b"common", b"rare"], pa.binary()), np.array([1, 9000]), n, 3 * n + 20)
    read = []
    best = lexical.Best(10)
    add = lexical.Best.add
    lexical.Best.add = lambda self, s, i: (read.append(len(s)), add(self, s, i))
    try:
        shard.search([0, 1], best)
    finally:
        lexical.Best.add = add
    assert best.ids.tolist() == list(range(10)) and len(read) == 1


# 13 packing


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.VOCABULARY)


def checked(spark, docs, rows, length=packing.LENGTH):
    """Pieces against the tokenizer itself; sequences hold them without gap or overlap. The number of sequences."""
    t = tokenizer()
    left = Counter()
    for d, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        first = (len(ids) - 1) % length + 1
        cuts = [0, *range(first, len(ids) + 1, length)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            left[d, k, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == left
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length
    return len(sequences)


def fewest(sizes, capacity):
    """A lower bound: pieces over half a sequence need one each, and those that fit beside none of them need their sum."""
    least = -(-sum(sizes) // capacity)
    for k in range(1, capacity // 2 + 1):
        alone, half, rest = (sum(1 for s in sizes if s > capacity - k), [s for s in sizes if capacity // 2 < s <= capacity - k], sum(s for s in sizes if k <= s <= capacity // 2))
        least = max(least, alone + len(half) + max(0, -(-(rest - len(half) * capacity + sum(half)) // capacity)))
    return least


def test_packing_of_the_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    rows = queries.op13_best_fit_packing(spark, sf_dir).collect()
    least = fewest([r["length"] for r in rows], packing.LENGTH)
    assert least <= checked(spark, docs, rows) <= least + 1


ROUGH = ["a b", " a", "a ", "a  b", "a\n\n b", "a\n b\t\tc", "it's. 'tis' 'S we'll,x", "x.  y  z", "é ñ a,é", "<|endoftext|> a <|endoftext|>", "12 a12,b 1.2\x1c x", "\x85 a", "  ", "a(b)c\"d\"e f:g;h", "日本 語,a 日", "a\r\n\r\nb . c", "😀 a😀 ,b"]


def test_encoder_keeps_words_in_flat_arrays(monkeypatch):
    """One array of ids for all words it knows, and the same ids after it forgot them."""
    import pyarrow as pa

    with open(packing.VOCABULARY, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    texts = [["one two", ""], ["two three é\n\nthree", "one"], [""], []]
    encoded = lambda part: tuple(x.tolist() for x in encoder.encode(pa.array([t.encode() for t in part], pa.large_binary())))
    first = [encoded(part) for part in texts]
    assert len(encoder.bounds) == len(encoder.number) + 1 and encoder.bounds[-1] == len(encoder.ids)
    monkeypatch.setattr(packing, "KEPT_WORDS", 0)
    assert first == [encoded(part) for part in texts]


def test_encoder_cuts_only_between_pretokens():
    import pyarrow as pa

    rnd = random.Random(3)
    texts = ROUGH + ["".join(rnd.choice([*ROUGH, " ", "\n", "word", "'", "s", ".", " "]) for _ in range(rnd.randrange(30))) for _ in range(400)] + ["", "x" * 5000, " " * 3000]
    with open(packing.VOCABULARY, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    ids, ends = encoder.encode(pa.array([t.encode() for t in texts], pa.large_binary()))
    t, at = tokenizer(), 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        assert ids[at:end].tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
        at = end


def test_encoder_cuts_at_letters_beyond_ascii_and_at_breaks():
    """Accented words, words before marks and lines are pieces of their own: a tokenizer sees few different ones."""
    import pyarrow as pa

    with open(packing.VOCABULARY, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    t, rnd = tokenizer(), random.Random(5)
    words = ["éa", "Éb", "ñ", "дом", "word"]
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", ". ", ".\n", "%%% "]) for _ in range(60)) for _ in range(60)]
    ids, ends = encoder.encode(pa.array([x.encode() for x in texts], pa.large_binary()))
    assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(encoder.number) <= 2 * len(words) + 6
    odd = ["a× b÷.", "×. ÷ ×", "\u00a0 é \u2003é\u3000 x", "é\n\u00a0é", "α. Αβ, γ", "д. ҂, д", "<|endoftext|>é.<|endoftext|>%", "é's 'é", "\x1c.\n\x1d a\t\té", "\r\n é\v\fé", "…. “é”, —é", "ʼn. 한국 , ㌀ 中.", "e\u0301. e\u0301", "\x7f. \x7fa\n\x00 a", "٣. ½ ²,", "a  \n \n\n", "b", "c\n  ", "d"]
    odd += ["".join(rnd.choice([*odd, " ", "\n", ".", "é", "%"]) for _ in range(rnd.randrange(20))) for _ in range(1500)]
    ids, ends = encoder.encode(pa.array([x.encode() for x in odd], pa.large_binary()))
    assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] == [t.encode(x, add_special_tokens=False).ids for x in odd]


def test_packing_odd_rows(spark, odd, none):
    long_ = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(7, "a b. " * 3000)], "doc_id long, text string"))
    pieces = packing.cut(long_)
    rows = pieces.select("key", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")).join(packing.pack(pieces), "key").collect()
    checked(spark, [(r["doc_id"], r["text"]) for r in long_.collect()], rows)
    assert packing.pack(packing.cut(none)).count() == 0


@pytest.mark.parametrize("sizes, fewest", [
    ([6, 4, 4, 3, 3], 2),  # best fit takes three: 6+4, 4+3+3 needs no swap; the order of the sum does
    ([5, 5, 4, 4, 4, 3, 3, 2], 3),
    ([7, 6, 4, 3], 2),
    ([8, 8, 1, 1, 1, 1], 2),
    ([6, 6, 6], 3),
])
def test_packing_small_cases(sizes, fewest):
    got = packing.improve(packing.best_fit([[i] for i in range(len(sizes))], sizes, 10), sizes, 10)
    assert sorted(i for b in got for i in b) == list(range(len(sizes))) and len(got) == fewest


def test_swaps_empty_sequences():
    """Sequences that best fit would not make: swaps of one for one, two for one and moves alone bring them together."""
    one = packing.improve([[0, 1], [2, 3], [4]], [6, 3, 5, 4, 2], 10)  # 9, 9, 2
    assert len(one) == 2 and all(sum([6, 3, 5, 4, 2][i] for i in b) == 10 for b in one)
    two = packing.improve([[0, 1], [2, 3, 4]], [6, 3, 2, 2, 1], 10)  # 3 for 2 + 2
    assert max(sum([6, 3, 2, 2, 1][i] for i in b) for b in two) == 10
    rnd = random.Random(5)
    for spread in (lambda: rnd.randint(1, 1024), lambda: rnd.randint(200, 700), lambda: rnd.choice([341, 342, 512, 600])):
        sizes = [spread() for _ in range(3000)]
        first = packing.best_fit([[i] for i in range(3000)], sizes, 1024)
        last = packing.improve(first, sizes, 1024)
        squares = lambda bins: sum(sum(sizes[i] for i in b) ** 2 for b in bins)
        assert sorted(i for b in last for i in b) == list(range(3000)) and all(sum(sizes[i] for i in b) <= 1024 for b in last)
        assert fewest(sizes, 1024) <= len(last) <= min(len(first), 1.05 * fewest(sizes, 1024)) and squares(last) >= squares(first)


@pytest.mark.parametrize("group", [50, 16384])
def test_packing_in_rounds(spark, group):
    """Many small groups come close to one large one; a third of all pieces has one length."""
    rnd = random.Random(2)
    sizes = [300 if i % 3 == 0 else rnd.randint(1, 1024) for i in range(4000)]
    pieces = spark.createDataFrame(list(enumerate(sizes)), "key long, length long").repartition(4)
    rows = packing.pack(pieces, group=group).join(pieces, "key").collect()
    assert len(rows) == 4000
    fill = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 1024 and fewest(sizes, 1024) <= len(fill) <= (1.06 if group == 50 else 1.035) * fewest(sizes, 1024)
