"""Tables of a corpus as JSON and CSV folders: documents, chunks, records by kind, quality metrics and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import detect, profile, segment

RECORDS = {
    "definitions": detect.definition_records,
    "requirements": detect.requirement_records,
    "warnings": detect.warning_records,
    "parts": detect.part_records,
    "specs": detect.spec_records,
    "procedure_steps": detect.step_records,
    "tables": detect.table_records,
}


def flattened(rows: DataFrame) -> DataFrame:
    """``rows`` with one text or number a column: lists of texts joined by a bar, anything else nested as JSON."""

    def flat(field: T.StructField):
        kind = field.dataType
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            return F.array_join(field.name, " | ").alias(field.name)
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(field.name).alias(field.name)
        return F.col(field.name)

    return rows.select(*[flat(f) for f in rows.schema.fields])


def one_table(parts: dict[str, DataFrame], kind: str = "kind") -> DataFrame:
    """Tables of different columns as one, with the columns of all; ``kind`` names the table."""
    out = None
    for name, rows in parts.items():
        named = rows.withColumn(kind, F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def tables_of(corpus: DataFrame, text_col: str = "raw_text") -> dict[str, DataFrame]:
    """What is written, by name."""
    chunks = segment.chunk_flags(segment.knowledge_chunks(corpus, text_col))
    profiled = profile.profiles(corpus, text_col)
    found = {"documents": profiled.drop(text_col), "chunks": chunks.drop("line_list")}
    found |= {f"extracted_{kind}": of(chunks) for kind, of in RECORDS.items()}
    found["quality_metrics"] = profiled.select("doc_id", *profile.measures("x", "y"), "quality_score")
    found["quality_flags"] = profiled.select("doc_id", F.explode("quality_flags").alias("flag"))
    return found


def write(corpus: DataFrame, folder: str, text_col: str = "raw_text") -> list[str]:
    """Write each table as JSON lines under ``folder``, documents also as CSV; the executors write, and a run replaces the one before."""
    names = []
    for name, rows in tables_of(corpus, text_col).items():
        rows.write.mode("overwrite").json(f"{folder}/{name}.jsonl")
        names.append(f"{name}.jsonl")
    flattened(tables_of(corpus, text_col)["documents"]).write.mode("overwrite").option("header", True).csv(f"{folder}/documents.csv")
    return [*names, "documents.csv"]
