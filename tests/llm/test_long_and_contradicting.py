"""Long texts of awkward shapes, very many findings in one text, labels that contradict each other."""

import re
import time

import pytest
from pyspark.sql import functions as F

from scriptoria.llm import pii, secrets, token_counts
from scriptoria.llm.common import regex_spans


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 17, 1000, 100_000])
def test_spans_of_many_findings(spark, n):
    """Spans are right at every number of findings, and a hundred thousand in one text take seconds, not hours."""
    text = "é" + " ".join(f"{i:x}" * 2 + "é" * (i % 3) for i in range(n)) + " end"
    frame = spark.createDataFrame([(text,), (None,), ("",)], "t string").coalesce(1)
    began = time.time()
    got = frame.select(F.transform(regex_spans(F.col("t"), "[0-9a-f]+"), lambda s: F.struct(s["start"], s["end"], s["piece"])).alias("s")).collect()
    assert time.time() - began < 60
    assert [tuple(x) for x in got[0]["s"]] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text)]
    assert not got[1]["s"] and got[2]["s"] == []


@pytest.mark.parametrize("shape", ["x@b" + ".b" * 500_000, "a." * 500_000 + "@b.c", "1-" * 100_000, "1 " * 100_000, "+49 12" + " 12" * 100_000, "DE12" + " 1234" * 100_000, "1." * 500_000, "password=" * 100_000])
def test_masking_and_scanning_of_long_shapes(spark, shape):
    docs = spark.createDataFrame([(1, shape), (2, "mail a@b.cd")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs, "key").collect()}
    assert got[2] != "mail a@b.cd" and got[1]
    assert secrets.scan_secrets(docs, ["doc_id"])[0].count() == 2


def test_rollup_of_contradicting_and_repeated_labels(spark, tmp_path):
    """A document that is toxic by one label and poor by another goes with what the totals hold of it; nothing falls below zero."""
    docs = spark.createDataFrame([(1, "a  b   c", "en", "s"), (2, "a  b", "en", "s"), (3, "d  e", "en", "t"), (4, None, None, None), (1, "f", "en", "s")], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (2, 0, 0), (2, 0, 0), (2, 1, 0), (3, None, 1), (3, 0, None), (4, None, None), (9, 0, 1)], "doc_id long, quality int, toxic int")
    totals = token_counts.corpus_rollup(docs, labels, f"file://{tmp_path}/r").totals().collect()
    assert {(r["source"], r["n_docs"]) for r in totals} == {("s", 1), (None, 1)}
    counted = {r["tokenizer"]: r["n_tokens"] for r in totals if r["source"] == "s"}
    for name, path in token_counts.VOCABULARIES.items():
        assert counted[name] == len(token_counts._encoder(open(path, "rb").read()).encode_ordinary("a b"))
