"""Delimited text by columns against the standard library's reader; what stands around measured values."""

import csv
import io
import random
import re

from scriptoria.operators import delimited, detect
from scriptoria.sources import extract


def by_reader(t, kind):
    csv.field_size_limit(10**9)
    return "\n".join(" | ".join(c.strip() for c in row) for row in csv.reader(io.StringIO(t, newline=""), delimiter=delimited.DELIMITERS[kind]))


CASES = ["", "a", "a,b\n", "a,b", "a,", ",", "\n", "\n\n", "a\n\nb", "a\r\nb\rc\n", "\r\r\n", '"a,b",c', '"a\nb",c\n', '"a""b"', '""', '""""', '"""', '"a"b"c",d', 'a"b,c"d', '"open, to\nthe end', '"open\n', '"a""', ' "a" , b ', "a\tb,c\td", '"a\tb"\tc', "\x0c a \x85,　b \n", "é,ü\r\n日本,\U0001f600", '"a"\r', "x,,,\n,,y", '"a,']


def test_cells_like_the_standard_reader(spark):
    rng = random.Random(11)
    texts = CASES + ["".join(rng.choice('ab,"\t\n\r ') for _ in range(rng.randint(0, 40))) for _ in range(600)]
    rows = [(i, kind, t) for i, t in enumerate(texts) for kind in ("csv", "tsv")] + [(-1, "csv", None), (-2, None, "a,b")]
    table = spark.createDataFrame(rows, "k int, kind string, raw string")
    got = {(r["k"], r["kind"]): r["out"] for r in delimited.with_cell_text(table, "raw", "kind", "out").collect()}
    assert got.pop((-1, "csv")) is None and got.pop((-2, None)) == "a | b"
    wrong = {(k, kind): (texts[k], got[k, kind]) for k, kind in got if got[k, kind] != by_reader(texts[k], kind)}
    assert not wrong


def test_long_cells_and_many_rows(spark):
    texts = ["x" * 1_000_000 + ",b", '"' + 'a""' * 300_000 + '",b', "a,b\n" * 100_000, '"' + "a,\n" * 300_000, " " * 1_000_000 + "a", "," * 200_000]
    table = spark.createDataFrame([(i, "csv", t) for i, t in enumerate(texts)], "k int, kind string, raw string")
    got = {r["k"]: r["out"] for r in delimited.with_cell_text(table, "raw", "kind", "out").collect()}
    assert [got[i] for i in range(len(texts))] == [by_reader(t, "csv") for t in texts]


def test_files_without_python(spark, tmp_path):
    files = {"a.csv": 'name,note\r\nbolt,"M8, ""zinc"""\r\n' * 20, "b.tsv": "name\tnote, long\n" * 20, "c.csv": ""}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body.encode())
    (tmp_path / "d.csv").write_bytes("café,b\n".encode("cp1252") * 20)
    got = {r["path"].rpartition("/")[2]: r for r in extract.extracted(extract.listing(spark, f"file://{tmp_path}")).collect()}
    for name in got:
        want = extract.extract((tmp_path / name).read_bytes(), name[-3:])
        r = got[name]
        assert (r["text"], r["status"], r["method"], r["warnings"], r["pages"]) == (want.text, want.status, want.method, want.warnings, want.pages or ([want.text] if want.text else [])), name
    assert got["a.csv"]["text"].startswith('name | note\nbolt | M8, "zinc"\n') and got["d.csv"]["warnings"] == ["decoded as cp1252"]
    table = spark.createDataFrame([("csv", "a,b")], "kind string, raw string")
    plan = delimited.with_cell_text(table, "raw", "kind", "out")._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "Arrow" not in plan


def test_context_of_measured_values(spark):
    text = "Intro. " * 40 + "\nTorque: 11.5 Nm for M8\nVoltage = -12 V, Width: 3 mm\n" + "tail " * 60 + "\nDepth: 4"
    got = detect.spec_records(spark.createDataFrame([(1, 0, text), (2, 0, None), (3, 0, "")], "doc_id int, chunk_index int, text string")).orderBy("item").collect()
    assert [(r["doc_id"], r["value"], r["unit"]) for r in got] == [(1, "11.5", "Nm"), (1, "-12", "V"), (1, "3", "mm"), (1, "4", "")]
    for r in got:
        start = next(m.start() for m in re.finditer(re.escape(r["parameter"]), text))
        assert r["context"] == text[max(0, start - 120) : start + 120].strip()
