"""Rules from a table against trying every rule on every path; aligned lines against the texts they come from."""

import fnmatch
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from scriptoria.operators import duplicates, normalize, rulesets
from scriptoria.sources import tables


def fits(path, pattern):
    return fnmatch.fnmatchcase(path, pattern) or (pattern.startswith("**/") and fnmatch.fnmatchcase(path, pattern[3:]))


def by_force(path, rules, default):
    return min(((pos, label) for pos, pattern, label in rules if path is not None and None not in (pos, pattern, label) and fits(path, pattern)), default=(None, default))


@pytest.mark.parametrize("seed", range(3))
def test_patterns_like_the_shell(spark, seed):
    rng = random.Random(seed)
    piece = lambda: rng.choice(["*", "**/", "?", "[ab]", "[!a]", "[a-c]", "[c-a]", "[]x]", "[!]]", "[", "]", "[^a]", "[&&b]", "[a-]", "[[]", ".", "+", "$", " ", "a", "b", "/", "ab/c", "é", "𝒳", "\\"])
    patterns = ["".join(piece() for _ in range(rng.randint(0, 5))) for _ in range(400)]
    paths = ["".join(rng.choice("aabbc/.[]^&-+$ é𝒳\\") for _ in range(rng.randint(0, 6))) for _ in range(120)] + ["ab/c", "xab/c", "/ab/c.a"]
    for p in patterns:
        regex = re.compile(rf"(?s:{rulesets.shell_regex(p)})\Z")
        for path in paths:
            assert bool(regex.match(path)) == fnmatch.fnmatchcase(path, p), (p, path)
            assert not fnmatch.fnmatchcase(path, p) or all(w in path for w in rulesets.anchors(p)), (p, path)
    rules = [(rng.randint(0, 300), p, f"l{i}") for i, p in enumerate(patterns) if rng.random() < 0.5]
    got = rulesets.first_fitting(spark.createDataFrame([(p,) for p in paths], "source_path string"), spark.createDataFrame(rules, "pos int, pattern string, label string"), "none").collect()
    assert {r["source_path"]: (r["rule_pos"], r["rule_label"]) for r in got} == {p: by_force(p, rules, "none") for p in paths}


def test_odd_rules_and_paths(spark):
    rows = spark.createDataFrame([("a/b.txt", 1), (None, 2), ("", 3), ("a/b.txt", 4), ("x" * 5_000 + "/end", 5), ("two\nlines", 6)], "source_path string, rule_label int")
    rules = [(5, "*", "any"), (3, "**/b.*", "b"), (3, "a/b*", "a"), (None, "*", "no"), (1, None, "no"), (1, "*", None), (4, "*xxxx/end", "long"), (4, "two?lines", "lines"), (2, "nowhere*a/b", "no")]
    table = spark.createDataFrame(rules, "pos int, pattern string, label string")
    got = {r["rule_label"]: r["label"] for r in rulesets.with_rule(rows, table, "none", label_col="label").collect()}
    assert got == {1: "a", 2: "none", 3: "any", 4: "a", 5: "long", 6: "lines"}
    assert {r["rule_label"] for r in rulesets.first_fitting(rows, table.limit(0), "none").collect()} == {"none"}
    assert rulesets.first_fitting(rows.limit(0), table, "none").count() == 0


def test_many_rules_that_share_their_beginning(spark):
    """Ten thousand rules under one folder: a path meets those that share its own number, not all of them."""
    rules = spark.range(10_000).select(F.col("id").alias("pos"), F.format_string("/manuals/brand/part_%06d*", "id").alias("pattern"), F.col("id").cast("string").alias("label"))
    rows = spark.range(3_000).select(F.format_string("/manuals/brand/part_%06d.md", F.col("id") * 7).alias("source_path"))
    got = rulesets.first_fitting(rows, rules, "none").collect()
    number = {r["source_path"]: int(r["source_path"][-9:-3]) for r in got}
    assert len(got) == 3_000 and all(r["rule_label"] == (str(number[r["source_path"]]) if number[r["source_path"]] < 10_000 else "none") for r in got)


def test_rules_are_met_by_whole_runs_and_never_broadcast(spark):
    """A rule of seven literal characters meets its own path, not all that share four; no side of a join is sent whole."""
    assert rulesets.anchors("*_012345[.]*") == ["_012345"]
    assert "_012345." in rulesets.anchors("/manuals/brand-[!3]*/*_012345.??")
    rules = spark.range(500).select(F.col("id").alias("pos"), F.format_string("*_%06d[.]*", "id").alias("pattern"), F.col("id").cast("string").alias("label"))
    found = rulesets.first_fitting(spark.range(500).select(F.format_string("/m/part_%06d.md", "id").alias("source_path")), rules, "none")
    assert {(int(r["source_path"][8:14]), r["rule_label"]) for r in found.collect()} == {(i, str(i)) for i in range(500)}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_aligned_lines_give_both_sides(spark, sf_dir):
    """On all documents, raw and clean; the counts are those of the short form."""
    rows = normalize.with_knowledge_text(tables.documents(spark, sf_dir)).select("doc_id", "raw_text", "clean_text").cache()
    a, b = F.split("raw_text", "\n"), F.split("clean_text", "\n")
    aligned = duplicates.aligned_lines(rows, "doc_id", a, b, rows_at_once=7).cache()
    for second, name in ((False, "raw_text"), (True, "clean_text")):
        back = {r["doc_id"]: r["text"] for r in duplicates.rebuilt(aligned, "doc_id", second).collect()}
        assert back == {r["doc_id"]: r[name] for r in rows.collect() if r[name] is not None}
    short = {r["doc_id"]: tuple(r["d"]) for r in rows.select("doc_id", duplicates.line_diff(a, b).alias("d")).collect()}
    ops = [F.count_if(F.col("op") == o).alias(o) for o in ("equal", "delete", "insert")]
    long = {r["doc_id"]: tuple(r)[1:] for r in aligned.groupBy("doc_id").agg(*ops).collect()}
    assert {k: v for k, v in short.items() if v != (0, 0, 0)} == long
    seqs = aligned.groupBy("doc_id").agg(F.countDistinct("seq").alias("n"), F.count(F.lit(1)).alias("m"), F.max("seq").alias("top"))
    assert seqs.where("n <> m or top <> n - 1").count() == 0


def test_aligned_lines_of_random_lists(spark):
    rng = random.Random(5)
    pairs = [(i, [rng.choice("abc") for _ in range(rng.randint(0, 30))], [rng.choice("abc") for _ in range(rng.randint(0, 30))]) for i in range(60)] + [(60, None, ["x"]), (61, None, None), (62, ["", ""], [""]), (63, ["l"] * 500, ["l"] * 400)]
    table = spark.createDataFrame(pairs, "k int, p array<string>, q array<string>")
    got: dict = {}
    for r in duplicates.aligned_lines(table, "k", F.col("p"), F.col("q"), rows_at_once=3).orderBy("k", "seq").collect():
        got.setdefault(r["k"], []).append(r)
    for k, a, b in pairs:
        a, b, own = a or [], b or [], got.get(k, [])
        assert [r["line"] for r in own if r["op"] != "insert"] == a and [r["first_no"] for r in own if r["op"] != "insert"] == list(range(len(a)))
        assert [r["line"] for r in own if r["op"] != "delete"] == b and [r["second_no"] for r in own if r["op"] != "delete"] == list(range(len(b)))
        equal = sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert sum(r["op"] == "equal" for r in own) == equal


def test_few_whole_texts_a_batch(spark, sf_dir, monkeypatch):
    """A worker that lines texts up gets few of them at a time, and the session's own setting is left as it was."""
    from scriptoria.plans import queries

    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, write = spark.conf.get(key), queries.shared_table
    monkeypatch.setattr(queries, "shared_table", lambda df, name: seen.append(int(spark.conf.get(key))) or write(df, name))
    assert queries.line_diffs(spark, sf_dir).count() == tables.documents(spark, sf_dir).count()
    queries.line_rebuilds(spark, sf_dir)
    assert len(seen) == 2 and max(seen) <= 64 and spark.conf.get(key) == before


def test_quick_patterns_find_the_same(spark):
    """Words beside each other, signs, letters beyond the first plane and line ends: the quick form says what the pattern says."""
    import random
    import re

    from scriptoria.functions import rules
    from scriptoria.functions.quick import quick
    from scriptoria.operators import detect

    patterns = list(dict.fromkeys(p for p in [*vars(rules).values(), *vars(detect).values()] if isinstance(p, str) and quick(p) != p))
    assert len(patterns) > 20 and all("(?<!" in quick(p) for p in patterns)
    assert quick(rules.HEADING) == rules.HEADING
    pick = random.Random(5)
    words = sorted({w for p in patterns for w in re.findall(r"[A-Za-z]+(?: [a-z]+)*|20|[0-9]", p)}) + ["a", "b", "C"]
    glue = [" ", "", "_", "\n", "é", "\U00010410", "\U0001d7d8", "1", "-", ".", "́", ":", " # ", "\t", "%", "\r\n", " ", "/", "@"]
    texts = ["".join(pick.choice(glue) + pick.choice([str.lower, str.upper, str.title])(pick.choice(words)) + pick.choice(glue) for _ in range(pick.randint(1, 5))) for _ in range(4000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    other = [F.sum((F.col("t").rlike(p) != F.col("t").rlike(quick(p))).cast("int")).alias(p) for p in patterns]
    other.append(F.sum((F.col("t").rlike(rules.SPACED_LETTERS) != F.expr(rules.spaced_letters("t"))).cast("int")).alias("spaced letters"))
    assert {k: v for k, v in rows.agg(*other).first().asDict().items() if v} == {}


def test_records_of_a_text_skip_the_chunk_features(spark, sf_dir):
    """Parts and measured values read a chunk's text alone: its admin lines are not looked for, and a cheap mark is tried first."""
    from scriptoria.plans.queries import QUERIES

    for name in ("parts", "specs"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "copyright" not in plan and "Filter" in plan


def test_slugs_in_one_pass_and_marked_patterns(spark):
    """A slug takes two replacements, not six, and is what the rule says; marks drop no match of their patterns."""
    import random
    import re

    from scriptoria.functions import rules, text
    from scriptoria.functions.dialect import ANSI, SPARK
    from scriptoria.functions.quick import quick

    assert text.slug("x", 12).count("regexp_replace") <= 2 < text.slug("x", 12, ANSI).count("regexp_replace")
    rng = random.Random(6)
    signs = ["a", "B", "7", " ", "_", "-", "--", "/", "\\", ".", ":", "www.", "WwW.", "http://", "\n", "\t", "\u00e9", "\u00bd", "\u4e2d", "'"]
    texts = ["", "-", "a-", "-a", *("".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(600))]

    def slug(x, most):
        x = re.sub(r"[ \t\n\r\f_]+", "-", re.sub(r"[^a-z0-9_ \t\n\r\f-]", " ", x.lower()))
        x = re.sub("-$", "", re.sub("^-|-$", "", re.sub("-+", "-", x))[:most])
        return x or "unknown"

    patterns = [(rules.PATH_MARKS, rules.PATH_LIKE), (rules.PATH_MARKS, r"https?://|www\.|[A-Za-z]:\\"), (rules.SLASHES, rf"\.\\|\\\\|//|/{text.W}+/")]
    both = [f"{SPARK.has_marked('x', marks, p)} = rlike(x, {SPARK.text(quick(p))}) as same{i}" for i, (marks, p) in enumerate(patterns)]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for r in df.selectExpr("x", f"{text.folded('x')} as plain", f"{text.slug('x', 6)} as s", f"{text.slug('x', 90)} as t", *both).collect():
        assert (r["s"], r["t"]) == (slug(r["plain"], 6), slug(r["plain"], 90)), r["x"]
        assert r["same0"] and r["same1"] and r["same2"], r["x"]


def test_procedures_drop_chunks_before_their_features(spark, sf_dir):
    """Chunks without the mark of a step change nothing, and are dropped."""
    from scriptoria.operators import detect, segment
    from scriptoria.plans import queries
    from scriptoria.sources import tables

    rows = [(1, "1. Turn it on.\n2) Remove it.\n\n 3.\tCheck the bolt\n\nno step here 4.5\n\n5 . none\n\n12)  Verify the gate\n\nx")]
    corpus = spark.createDataFrame(rows, "doc_id long, raw_text string").selectExpr("doc_id", "'p' as source_path", "'p.md' as source_filename", "'t' as title", "raw_text")
    whole, marked = segment.knowledge_chunks(corpus), segment.knowledge_chunks(corpus, mark=detect.STEP_MARK)
    assert sorted(r[0] for r in marked.select("chunk_index").collect()) == [0, 1, 4] and whole.count() == 6
    assert sorted(map(str, detect.procedures(whole).collect())) == sorted(map(str, detect.procedures(marked).collect()))
    every = segment.knowledge_chunks(tables.manuals(spark, sf_dir))
    assert sorted(map(str, detect.procedures(every).collect())) == sorted(map(str, queries._procedures(spark, sf_dir).collect()))
