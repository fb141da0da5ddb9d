"""Committed tables, table functions, the data source, keyed scan state and progress, against plain Python."""

import re
import threading
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scriptoria.functions import tables as table_functions
from scriptoria.operators import segment
from scriptoria.plans.commits import CommittedTable
from scriptoria.sources import extract
from scriptoria.sources.datasource import BatchReader, CorpusFiles
from scriptoria.streaming import keyed, progress

KV = "k string, v int"


def got(df):
    return sorted((r["k"], r["v"]) for r in df.collect())


def test_two_writers_lose_nothing(spark, tmp_path):
    """Both add rows and add up a counter at once; a number that is taken is tried again."""
    path = f"file://{tmp_path}/t"
    CommittedTable(spark, path, KV).update(lambda old: spark.createDataFrame([("n", 0)], KV))

    def work(name):
        table = CommittedTable(spark, path, KV)
        for i in range(3):
            table.append(spark.createDataFrame([(f"{name}{i}", 1)], KV))
            table.update(lambda old: old.withColumn("v", F.when(F.col("k") == "n", F.col("v") + 1).otherwise(F.col("v"))))

    threads = [threading.Thread(target=work, args=(n,)) for n in "ab"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    table = CommittedTable(spark, path, KV)
    assert got(table.read()) == sorted([("n", 6)] + [(f"{n}{i}", 1) for n in "ab" for i in range(3)])
    assert table.versions() == list(range(1, 14))


def test_put_only_if_absent(spark, tmp_path):
    table = CommittedTable(spark, f"file://{tmp_path}/t", KV)
    table.append(spark.createDataFrame([("a", 1)], KV))
    assert not table._put(1, '{"parts": []}') and got(table.read()) == [("a", 1)]
    (tmp_path / "t" / "data-torn").mkdir()  # a writer that died before its commit
    assert got(table.read()) == [("a", 1)] and table.vacuum() == 1
    with pytest.raises(ValueError, match="no version 7"):
        table.as_of(7)


def test_versions_changes_and_compaction(spark, tmp_path):
    table = CommittedTable(spark, f"file://{tmp_path}/t", KV, compact_at=4)
    assert got(table.read()) == [] and table.version() == 0
    for i in range(9):
        table.append(spark.createDataFrame([(f"k{i}", i)], KV))
    assert [table.as_of(n).count() for n in range(10)] == list(range(10)) and len(table._parts(9)) <= 4
    table.update(lambda old: old.where("k <> 'k0'").withColumn("v", F.when(F.col("k") == "k1", F.lit(None).cast("int")).otherwise(F.col("v"))))
    feed = sorted((r["k"], r["v"], r["change"]) for r in table.changes(5, 10, "k").collect() if r["k"] != "k1")
    assert feed == [("k0", 0, "removed"), *[(f"k{i}", i, "added") for i in range(5, 9)]]
    assert [(r["k"], r["v"]) for r in table.changes(9, 10, "k").where("change = 'changed'").collect()] == [("k1", None)]
    assert table.changes(10, 10, "k").count() == 0 and table.changes(0, 3, "k").where("change = 'added'").count() == 3
    table.vacuum(keep=1)
    assert table.versions() == [10] and table.read().count() == 8


def test_merge_leaves_other_buckets_alone(spark, tmp_path):
    """After one changed row all files but one bucket's are the same, and the table is as if made anew."""
    table = CommittedTable(spark, f"file://{tmp_path}/t", KV)
    none = spark.createDataFrame([], "k string")
    table.merge(spark.createDataFrame([(f"k{i}", i) for i in range(500)], KV), none, "k", 16)
    before = set(table._parts(1))
    table.merge(spark.createDataFrame([("k7", 70)], KV), none, "k", 16)
    assert len(before) == 16 and len(before & set(table._parts(2))) == 15
    table.merge(spark.createDataFrame([("new", 1)], KV), spark.createDataFrame([("k3",), ("never",)], "k string"), "k", 16)
    want = {f"k{i}": i for i in range(500)} | {"k7": 70, "new": 1}
    del want["k3"]
    assert got(table.read()) == sorted(want.items())
    assert sorted(r["change"] for r in table.changes(1, 3, "k").collect()) == ["added", "changed", "removed"]
    assert table.merge(spark.createDataFrame([], KV), none, "k", 16) == 3


def test_table_functions(spark):
    table_functions.register(spark)
    docs = [(1, "Hi there. You two!  3 more? no. end\nNext"), (2, None), (3, "  "), (4, "One.\tTwo. \n 3")]
    frame = spark.createDataFrame(docs, "doc_id long, raw_text string")
    frame.createOrReplaceTempView("fixture_docs")
    found = spark.sql("select doc_id, sentence_idx, sentence from corpus_sentences(TABLE(fixture_docs))").collect()
    own = segment.sentences(frame).select("doc_id", F.col("sentence_idx").cast("int"), "sentence").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, own)) and len(found) > 5
    rows = [(d, i, t) for d, ts in {1: ["# A\nx", "y", "## B c", "z"], 2: ["none", None]}.items() for i, t in enumerate(ts)]
    spark.createDataFrame(rows[::-1], "doc_id long, para_idx int, text string").repartition(3).createOrReplaceTempView("fixture_paragraphs")
    headed = spark.sql("select * from corpus_headings(TABLE(fixture_paragraphs), '^#+ ')").collect()
    assert sorted(map(tuple, headed)) == [(1, 0, "A"), (1, 1, "A"), (1, 2, "B c"), (1, 3, "B c"), (2, 0, ""), (2, 1, "")]
    sizes = [("a", i, n) for i, n in enumerate([40, 70, 30, 500, 1, None, 99])] + [("b", 0, 5), (None, 0, 7)]
    spark.createDataFrame(sizes[::-1], "`group` string, place int, n_words int").createOrReplaceTempView("fixture_sizes")
    pages = {(r["group"], r["place"]): r["page"] for r in spark.sql("select * from corpus_pages(TABLE(fixture_sizes), 100)").collect()}
    assert [pages["a", i] for i in range(7)] == [1, 2, 2, 3, 4, 4, 4] and pages["b", 0] == pages[None, 0] == 1
    with pytest.raises(Exception, match="lacks doc_id, raw_text"):
        spark.sql("select * from corpus_sentences(TABLE(fixture_sizes))").collect()
    with pytest.raises(Exception, match="positive whole number"):
        spark.sql("select * from corpus_pages(TABLE(fixture_sizes), 0)").collect()


def at(hours):
    return datetime(2024, 1, 1) + timedelta(hours=hours)


def streamed(spark, tmp_path, files, **how):
    """The changes that a stream of these files (one a batch) gives, and its progress."""
    schema = "source_path string, checksum string, modified timestamp"
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are taken by their time
    before = {k: spark.conf.get(k) for k in keyed.PROVIDER}
    listener = progress.Progress()
    spark.streams.addListener(listener)
    try:
        for k, v in keyed.PROVIDER.items():
            spark.conf.set(k, v)
        sights = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").observe("sights", F.count(F.lit(1)).alias("n"))
        keyed.changes_stream(sights, **how).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        for _ in range(50):
            if listener.events and listener.events[-1]["kind"] == "ended":
                break
            time.sleep(0.1)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.streams.removeListener(listener)
    return spark.read.parquet(f"{tmp_path}/out"), listener


def test_keyed_state_of_late_and_repeated_sights(spark, tmp_path):
    files = [[("a", "1", at(1)), ("b", "1", at(1)), (None, "x", at(1)), ("n", None, at(1))], [("a", "2", at(5)), ("a", "0", at(0)), ("b", "1", at(2))], [("a", "1", at(3)), ("c", "9", at(6)), ("c", "9", at(6)), ("a", "3", at(9)), ("a", "2", at(8))]]
    changes, listener = streamed(spark, tmp_path, files)
    assert sorted((r["source_path"], r["checksum"], r["modified"], r["change"]) for r in changes.collect()) == [("a", "1", at(1), "added"), ("a", "2", at(5), "changed"), ("a", "3", at(9), "changed"), ("b", "1", at(1), "added"), ("c", "9", at(6), "added"), ("n", "", at(1), "added")]
    last = {}
    for path, checksum, seen in (row for rows in files for row in rows if row[0]):
        last[path] = max(last.get(path, (seen, "")), (seen, checksum or ""))
    assert {r["source_path"]: r["checksum"] for r in keyed.current(changes).collect()} == {p: c for p, (_, c) in last.items()}
    assert listener.total("sights") == 12 and listener.events[0]["kind"] == "started" and listener.events[-1]["error"] is None
    assert [e["rows_read"] for e in listener.events if e["kind"] == "progress" and e["rows_read"]] == [4, 3, 5]


def test_keyed_state_retires_what_is_not_seen(spark, tmp_path):
    files = [[("a", "1", at(1)), ("b", "1", at(1))], [("b", "1", at(40))], [("b", "1", at(80))], [("b", "1", at(82))], [("a", "1", at(83))]]
    changes, _ = streamed(spark, tmp_path, files, retire_after=timedelta(hours=50))
    found = sorted((r["source_path"], r["change"], r["modified"]) for r in changes.collect())
    assert ("a", "removed", at(1)) in found and found.count(("b", "added", at(1))) == 1 and not any(p == "b" and c == "removed" for p, c, _ in found)
    assert sorted(r["source_path"] for r in keyed.current(changes).collect()) == ["a", "b"]  # a came again


def test_stages_of_a_batch_job(spark):
    stages = progress.Stages()
    docs = stages.watch("documents", spark.createDataFrame([(1, "One. Two."), (2, "Three.")], "doc_id long, raw_text string"), chars=F.sum(F.length("raw_text")))
    out = stages.watch("sentences", segment.sentences(docs))
    with pytest.raises(ValueError, match="watched already"):
        stages.watch("documents", docs)
    assert out.count() == 3
    assert stages.counts() == {"documents": {"n": 2, "chars": 15}, "sentences": {"n": 3}}
    assert re.match("stage", stages.table(spark).columns[0]) and stages.table(spark).count() == 2


def corpus_files(folder):
    (folder / "a" / ".hidden").mkdir(parents=True)
    (folder / "b_debug").mkdir()
    files = {"a/one.txt": b"one two three " * 20, "a/two.html": b"<title>T</title><p>" + b"word " * 40 + b"</p><script>x</script>", "three.csv": b"a,b\n1,2", "a/bad.json": b'{"a": 1,,}', "a/x.exe": b"x", "a/empty.txt": b"", "a/.hidden/no.txt": b"no", "b_debug/no.txt": b"no", "a/no.bak": b"no", "a/latin.txt": b"caf\xe9 " * 30}
    for name, body in files.items():
        (folder / name).write_bytes(body)


@pytest.mark.parametrize("supported_only", [True, False])
def test_data_source_like_the_extractors(spark, tmp_path, supported_only):
    corpus_files(tmp_path)
    spark.dataSource.register(CorpusFiles)
    rows = spark.read.format("corpus_files").option("supportedOnly", str(supported_only)).option("partitionBytes", "100").load(f"file://{tmp_path}")
    assert rows.rdd.getNumPartitions() > 2
    own = extract.extracted(extract.listing(spark, f"file://{tmp_path}", supported_only))
    columns = [c for c in own.columns if c != "modificationTime"]
    found, want = (sorted(df.select(columns).collect(), key=lambda r: r["path"]) for df in (extract.graded(rows), own))
    assert found == want and len(found) == (5 if supported_only else 6)
    with pytest.raises(ValueError, match="mounted"):
        BatchReader({"path": "s3://x/y"})


def test_data_source_pushes_filters_into_the_listing(spark, tmp_path):
    corpus_files(tmp_path)
    spark.dataSource.register(CorpusFiles)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = spark.read.format("corpus_files").option("partitionBytes", "1").option("pushFilters", "true").load(str(tmp_path))
        some = rows.where("document_type in ('txt', 'csv') and length > 10 and relative_path like 'a/%' and method = 'plain'")
        assert sorted(r["relative_path"] for r in some.collect()) == ["a/latin.txt", "a/one.txt"]
        assert some.rdd.getNumPartitions() == 2  # only those files are opened
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_data_source_as_a_stream(spark, tmp_path):
    """Files that come later are a batch of their own, also after a restart; nothing is read twice."""
    corpus_files(tmp_path / "in")
    spark.dataSource.register(CorpusFiles)

    def run():
        stream = spark.readStream.format("corpus_files").load(str(tmp_path / "in")).select("relative_path", "text")
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        return sorted(r["relative_path"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == ["a/bad.json", "a/latin.txt", "a/one.txt", "a/two.html", "three.csv"]
    time.sleep(0.05)
    (tmp_path / "in" / "a" / "late.md").write_text("# late")
    assert run() == ["a/bad.json", "a/late.md", "a/latin.txt", "a/one.txt", "a/two.html", "three.csv"] == run()


def test_revisions_read_the_texts_once_and_in_all_tasks(spark, sf_dir, monkeypatch):
    """The sights are made once, not for each of the four folders by two tasks, and no frame is built for a key."""
    import inspect

    from scriptoria.plans import queries
    from scriptoria.streaming import keyed

    made, own = [], queries._sights
    monkeypatch.setattr(queries, "_sights", lambda *a: made.append(a) or own(*a))
    found = queries.stream_revisions(spark, sf_dir).groupBy().sum("n_docs").first()[0]
    assert len(made) == 1 and found == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert "pandas" not in inspect.getsource(keyed.Known)


def test_pages_become_files_without_a_process_for_each(spark, sf_dir, tmp_path):
    """Tasks write the folders themselves; repeated and missing keys keep all their lines, and a second run replaces the first."""
    from scriptoria.sources.datasource import written_folders

    rows = spark.createDataFrame([(1, "a"), (2, "é\nb"), (2, "c"), (None, "d")], "page_id long, html string")
    for _ in range(2):
        rows.repartition("page_id").sortWithinPartitions("page_id", "html").foreachPartition(written_folders(str(tmp_path), "page_id"))
    found = {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file()}
    assert found == {"page_id=1/part.txt": "a\n", "page_id=2/part.txt": "c\né\nb\n", "page_id=__HIVE_DEFAULT_PARTITION__/part.txt": "d\n"}
