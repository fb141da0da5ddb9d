"""The corpus pipeline: language ID, exact dedup, near-dedup, decontamination, mixing, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptoria.llm import decontaminate, exact_dedup, langid, mixing, near_dedup
from scriptoria.llm.common import shared_table

#: A text whose characters no learned language uses scores below this; texts of a learned language score above 0.3.
LEAST_LANGUAGE_SCORE = 0.1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; those without a letter, or of letters that no language here uses, go.

    Null and blank texts go; rows without a language teach nothing but stay if their text is known; repeated rows fare
    alike; an empty table stays empty; other columns are kept.
    """
    return langid.keep_identified(docs, least_score=LEAST_LANGUAGE_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id.

    Null counts as the empty text; of rows of one id and one text one stays; a row without an id stays only if no other
    has its text; an empty table stays empty; other columns are kept.
    """
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five words, similarity 0.8), the document with the smallest id.

    Null and blank texts are linked with nothing and stay; rows of one id fare alike; rows without an id stay; an empty
    table stays empty; other columns are kept.
    """
    return near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in benchmark windows.

    Null and blank texts have no words and stay; repeated rows fare alike; without test items all stay; an empty table
    stays empty; other columns are kept.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with how often it is read and where; each source is read once at least and four times at most.

    Null text has no tokens, a null source is one source; repeated rows, rows of one id and rows without an id each get
    a place of their own; an empty table stays empty; other columns are kept, whatever their names.
    """
    return mixing.with_places(docs, cover=True)[0]


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontamination),
    ("mixing", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; every stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language profiles and connected components over similar sets are no SQL; tests hold the pipeline to a brute-force version.
ORACLE_SQL = None
