"""Text from files: a registry of extractors by document type, run over ``binaryFile`` rows or columns.

A file that can't be read becomes a row with a status, never a failed task. Statuses: success, partial (read with
losses), metadata_only (no reader for it is installed), failed, unsupported. Extractors are plain functions
``(content, strategy) -> Extracted`` and can be added with :func:`register`; the built-in ones use the standard library.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.delimited import DELIMITERS, with_cell_text
from ..operators.markup import with_visible_text

#: Fixed values.
TYPES = {"txt": "txt", "md": "md", "csv": "csv", "tsv": "tsv", "html": "html", "htm": "html", "xml": "xml", "json": "json", "pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx", "png": "png", "jpg": "jpg", "jpeg": "jpeg", "tif": "tif", "tiff": "tiff", "bmp": "bmp", "webp": "webp"} | dict.fromkeys("yaml yml ini log rst toml rtf cfg conf".split(), "txt")
IMAGES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")
IGNORED_DIRS = ("__pycache__", "node_modules", "venv", "site-packages")
MOST_BYTES, PREVIEW_CHARS, LOW_TEXT_WORDS = 32 * 1024 * 1024, 900, 25
SCHEMA = "title string, text string, pages array<string>, method string, status string, chain array<string>, warnings array<string>, failure string"


@dataclass
class Extracted:
    text: str = ""
    title: str | None = None
    pages: list[str] | None = None
    method: str = "unknown"
    status: str = "success"
    chain: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    failure: str | None = None


Extractor = Callable[[bytes, str], Extracted]
REGISTRY: dict[str, Extractor] = {}


def register(*types: str) -> Callable[[Extractor], Extractor]:
    def add(f: Extractor) -> Extractor:
        REGISTRY.update(dict.fromkeys(types, f))
        return f

    return add


def decoded(content: bytes) -> tuple[str, list[str]]:
    """UTF-8 if it is that, else Windows-1252, else Latin-1, with a warning."""
    for encoding in ("utf-8", "cp1252", "latin-1"):
        try:
            return content.decode(encoding), [] if encoding == "utf-8" else [f"decoded as {encoding}"]
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin-1 reads all bytes")


@register("txt", "md")
def plain(content: bytes, strategy: str) -> Extracted:
    text, warnings = decoded(content)
    return Extracted(text, method="plain", warnings=warnings)


def _cells(kind: str) -> Extractor:
    """As :func:`scriptoria.operators.delimited.with_cell_text` reads them; for bytes that are not UTF-8."""

    def read(content: bytes, strategy: str) -> Extracted:
        text, warnings = decoded(content)
        csv.field_size_limit(len(text) + 1)
        rows = csv.reader(io.StringIO(text, newline=""), delimiter=DELIMITERS[kind])
        return Extracted("\n".join(" | ".join(c.strip() for c in row) for row in rows), method="cells", warnings=warnings)

    return read


for _kind in DELIMITERS:
    register(_kind)(_cells(_kind))


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.title, self.parts, self.hidden, self.in_title = "", [], 0, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style", "noscript", "template")
        self.in_title |= tag == "title"

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style", "noscript", "template") and self.hidden > 0
        self.in_title &= tag != "title"

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.hidden and data.strip():
            self.parts.append(data.strip())


@register("html")
def markup(content: bytes, strategy: str) -> Extracted:
    text, warnings = decoded(content)
    if strategy == "raw":
        return Extracted(text, method="raw", warnings=warnings)
    page = _Visible()
    page.feed(text)
    page.close()
    return Extracted("\n".join(page.parts), title=" ".join(page.title.split()) or None, method="html", warnings=warnings)


@register("xml")
def tree(content: bytes, strategy: str) -> Extracted:
    """The joined text of every element, so nested text stands once for each ancestor."""
    text, warnings = decoded(content)
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        return Extracted(text, method="raw", status="partial", warnings=[*warnings, f"malformed: {e}"])
    joined = (" ".join("".join(e.itertext()).split()) for e in root.iter())
    return Extracted("\n".join(j for j in joined if j), method="xml", warnings=warnings)


@register("json")
def pretty(content: bytes, strategy: str) -> Extracted:
    text, warnings = decoded(content)
    try:
        return Extracted(json.dumps(json.loads(text), indent=2, ensure_ascii=False), method="json", warnings=warnings)
    except ValueError as e:
        return Extracted(text, method="raw", status="partial", warnings=[*warnings, f"malformed: {e}"])


def _parts(content: bytes, pattern: str) -> list[tuple[int, ElementTree.Element]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(pattern, n)))
        return [(i, ElementTree.fromstring(z.read(n))) for i, n in names]


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _runs(e: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in e.iter() if _local(t) == "t")


@register("docx")
def word_file(content: bytes, strategy: str) -> Extracted:
    """Paragraphs outside tables; the title is the file's property."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
        core = ElementTree.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else []
    in_tables = {id(p) for t in body.iter() if _local(t) == "tbl" for p in t.iter()}
    paragraphs = [p for p in (_runs(e).strip() for e in body.iter() if _local(e) == "p" and id(e) not in in_tables) if p]
    title = next((e.text.strip() for e in core if _local(e) == "title" and (e.text or "").strip()), None)
    return Extracted("\n".join(paragraphs), title=title, method="docx")


@register("pptx")
def slides(content: bytes, strategy: str) -> Extracted:
    pages = ["\n".join(p for p in (_runs(e).strip() for e in slide.iter() if _local(e) == "p") if p) for _, slide in _parts(content, r"ppt/slides/slide(\d+)\.xml")]
    return Extracted("\n\n".join(p for p in pages if p), pages=pages, method="pptx")


@register("xlsx")
def sheets(content: bytes, strategy: str) -> Extracted:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = [_runs(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []

    def value(c: ElementTree.Element) -> str:
        if c.get("t") == "inlineStr":
            return _runs(c)
        v = next((e.text or "" for e in c if _local(e) == "v"), "")
        return shared[int(v)] if c.get("t") == "s" and v else v

    pages = []
    for _, sheet in _parts(content, r"xl/worksheets/sheet(\d+)\.xml"):
        rows = ([v for v in (value(c).strip() for c in r) if v] for r in sheet.iter() if _local(r) == "row")
        pages.append("\n".join(" | ".join(r) for r in rows if r))
    return Extracted("\n\n".join(p for p in pages if p), pages=pages, method="xlsx")


@register("pdf")
def pdf(content: bytes, strategy: str) -> Extracted:
    """The first engine that gives text; a strategy ``<engine>_only`` tries that one alone."""
    chain, warnings = [], []
    for engine in ("pymupdf", "pdfplumber", "pypdf"):
        if strategy in ("pymupdf_only", "pdfplumber_only", "pypdf_only") and strategy != f"{engine}_only":
            continue
        chain.append(engine)
        try:
            pages = _pdf_pages(engine, content)
        except ImportError:
            warnings.append(f"{engine} is not installed")
            continue
        except Exception as e:  # a broken file: the next engine may read it
            warnings.append(f"{engine}: {e}")
            continue
        if any(p.strip() for p in pages):
            return Extracted("\n\n".join(pages), pages=pages, method=engine, chain=chain, warnings=warnings)
    return Extracted(method="none", status="metadata_only", chain=chain, warnings=warnings, failure="no PDF engine gave text")


def _pdf_pages(engine: str, content: bytes) -> list[str]:
    if engine == "pymupdf":
        import fitz

        return [p.get_text() for p in fitz.open(stream=content, filetype="pdf")]
    if engine == "pdfplumber":
        import pdfplumber

        with pdfplumber.open(io.BytesIO(content)) as f:
            return [p.extract_text() or "" for p in f.pages]
    import pypdf

    return [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages]


@register(*IMAGES)
def image(content: bytes, strategy: str) -> Extracted:
    try:
        import pytesseract
        from PIL import Image
    except ImportError as e:
        return Extracted(method="none", status="metadata_only", failure=str(e))
    return Extracted(pytesseract.image_to_string(Image.open(io.BytesIO(content))), method="ocr")


def extract(content: bytes | None, doc_type: str | None, strategy: str = "default") -> Extracted:
    if doc_type not in REGISTRY:
        return Extracted(method="none", status="unsupported", failure=f"no extractor for {doc_type}")
    if content is None:
        return Extracted(method="none", status="metadata_only", failure="larger than the limit")
    try:
        found = REGISTRY[doc_type](content, strategy)
    except Exception as e:
        return Extracted(method="none", status="failed", failure=f"{type(e).__name__}: {e}")
    if found.status == "success" and len(re.findall(r"\w+", found.text)) < LOW_TEXT_WORDS:
        found.status = "partial"
        found.warnings = [*found.warnings, "low text"]
    return found


def _extracting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [extract(c, t, s) for c, t, s in zip(b["content"], b["document_type"], b["strategy"], strict=True)]
        rest = b.drop(columns=["content"]).reset_index(drop=True)
        columns = pd.DataFrame({"title": [e.title for e in found], "text": [e.text for e in found], "pages": [e.pages or ([e.text] if e.text else []) for e in found], "method": [e.method for e in found], "status": [e.status for e in found], "chain": [e.chain or [e.method] for e in found], "warnings": [e.warnings for e in found], "failure": [e.failure for e in found]})
        yield pd.concat([rest, columns], axis=1)


def ignored_name(name: str) -> bool:
    """A folder or file that no listing shows."""
    low = name.lower()
    return name.startswith(".") or name in IGNORED_DIRS or low.endswith(("_gpt_knowledge", "_debug", ".tmp", ".bak"))


def listing(spark: SparkSession, path: str | list[str], supported_only: bool = True) -> DataFrame:
    """Files below one or more folders, each once, with type, corpus and relative path; content is read only if it is asked for."""
    roots = [path] if isinstance(path, str) else list(dict.fromkeys(path))
    one = _below(spark, roots[0])
    for root in roots[1:]:
        one = one.unionByName(_below(spark, root))
    rows = one if len(roots) == 1 else one.join(one.groupBy("path").agg(F.min("root").alias("root")), ["path", "root"])  # a file below two roots belongs to the first by name
    rows = rows.drop("root")
    return rows.where("document_type is not null") if supported_only else rows


def _below(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    types = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    base = re.sub(r"^[a-z]+:/+", "/", path.rstrip("/") + "/")
    relative = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    rows = files.withColumn("relative_", relative).withColumns({"relative_path": F.expr(f"substring(relative_, {len(base) + 1})"), "document_type": F.try_element_at(types, suffix), "root": F.lit(base)}).drop("relative_")
    parts = F.split("relative_path", "/")
    ignored = F.exists(parts, lambda p: p.startswith(".") | p.isin(*IGNORED_DIRS) | F.lower(p).rlike("_gpt_knowledge$|_debug$") | p.rlike(r"(?i)\.(?:tmp|bak)$"))
    return rows.where(~ignored).withColumn("corpus", F.when(F.size(parts) > 1, parts[0]).otherwise(""))


#: Types whose text is made of columns, if the bytes are UTF-8: only other bytes and formats go through Python.
PLAIN = ("txt", "md", "html", *DELIMITERS)


def _plain(rows: DataFrame) -> DataFrame:
    """Text files, HTML and delimited text in UTF-8, with the columns of ``SCHEMA``."""
    html = (F.col("document_type") == "html") & (F.col("strategy") != "raw")
    read = with_visible_text(rows.withColumn("_raw", F.decode("content", "UTF-8")).withColumn("_html", F.when(html, F.col("_raw"))), "_html", "_page_title", "_page_text")
    table = F.col("document_type").isin(*DELIMITERS)
    read = with_cell_text(read.withColumn("_delimited", F.when(table, F.col("_raw"))), "_delimited", "document_type", "_table_text")
    body = F.when(html, F.col("_page_text")).when(table, F.col("_table_text")).otherwise(F.col("_raw"))
    method = F.when(html, "html").when(table, "cells").when(F.col("document_type") == "html", "raw").otherwise("plain")
    low = F.regexp_count(body, F.lit(text.WORD)) < LOW_TEXT_WORDS
    none = F.lit(None).cast("string")
    columns = {
        "title": F.when(html, F.col("_page_title")), "text": body, "pages": F.when(body != "", F.array(body)).otherwise(F.expr("cast(array() as array<string>)")), "method": method,
        "status": F.when(low, "partial").otherwise("success"), "chain": F.array(method), "warnings": F.when(low, F.array(F.lit("low text"))).otherwise(F.expr("cast(array() as array<string>)")), "failure": none,
    }
    return read.withColumns(columns).drop("_raw", "_html", "_page_title", "_page_text", "_delimited", "_table_text", "content")


def extracted(files: DataFrame, strategy: Column | str = "default", most_bytes: int = MOST_BYTES) -> DataFrame:
    """A listing's files with their text, status, quality and preview; files over ``most_bytes`` are not read."""
    content = F.when(F.col("length") <= most_bytes, F.col("content"))
    rows = files.select("path", "relative_path", "corpus", "modificationTime", "length", F.coalesce("document_type", F.lit("")).alias("document_type"), F.sha2(content, 256).alias("checksum"), (strategy if isinstance(strategy, Column) else F.lit(strategy)).alias("strategy"), content.alias("content"))
    kept = ", ".join(f"{c} {t}" for c, t in rows.drop("content").dtypes)
    plain = F.col("document_type").isin(*PLAIN) & F.coalesce(F.is_valid_utf8(F.col("content").cast("string")), F.lit(False))
    return graded(rows.where(~plain).mapInPandas(_extracting, f"{kept}, {SCHEMA}").unionByName(_plain(rows.where(plain))))


def graded(out: DataFrame) -> DataFrame:
    """Extracted rows with a title for each, quality and preview."""
    status = F.when(F.col("status") == "partial", 0.6).when(F.col("status") == "metadata_only", 0.25).when(F.col("status") == "unsupported", 0.1).when(F.col("status") == "failed", 0.0).otherwise(1.0)
    low = F.array_contains("warnings", "low text")
    before = F.when(low & (F.col("status") == "partial") & (F.size("warnings") == 1), 1.0).otherwise(status)
    quality = before - F.when(F.col("method") == "ocr", 0.1).otherwise(0.0) - F.least(F.lit(0.25), 0.05 * (F.size("warnings") - F.when(low, 1).otherwise(0))) - F.when(low, 0.15).otherwise(0.0) - F.when(F.col("failure").isNotNull(), 0.2).otherwise(0.0)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    preview = F.substring(F.coalesce(F.nullif("text", F.lit("")), F.col("failure"), F.array_join("warnings", "\n"), F.lit("")), 1, PREVIEW_CHARS)
    return out.withColumns({"title": F.coalesce("title", stem), "quality": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality)), 3), "preview": preview})
