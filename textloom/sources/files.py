"""Files, inline texts and evaluation sets as DataFrames of units."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: File types that can be read.
TYPES = ("pdf", "docx", "doc", "txt", "md", "markdown", "csv")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


#: Charsets in the order in which they are tried, where a new part of a text file begins, and the least characters of a PDF page.
CHARSETS = ("utf-8", "utf-8-sig", "gbk", "gb18030", "latin-1")
HEADING = re.compile(r"\n(?=#{1,6}\s)")
LEAST_PAGE = 10


def decode_text(raw: bytes) -> str:
    for charset in CHARSETS[:-1]:
        try:
            return raw.decode(charset)
        except UnicodeDecodeError:
            continue
    return raw.decode(CHARSETS[-1])


def _cells(row) -> list[str]:
    """A table row's cleaned texts; equal neighbours (merged cells) once."""
    texts = [T.cleaned("\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in cell.iter(f"{_W}p"))) for cell in row.iter(f"{_W}tc")]
    return [t for i, t in enumerate(texts) if not i or t != texts[i - 1]]


def docx_text(raw: bytes) -> str:
    """Cleaned paragraphs, then each table under its number, row by row as `header：cell` pairs; a lone row is its own header."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    parts = [t for p in body.findall(f"{_W}p") if (t := T.cleaned("".join(t.text or "" for t in p.iter(f"{_W}t"))))]
    for n, table in enumerate(body.findall(f"{_W}tbl"), 1):
        rows = [cells for r in table.findall(f"{_W}tr") if any(cells := _cells(r))]
        if not rows:
            continue
        parts.append(f"\n【表格 {n}】")
        names = dict(enumerate(rows[0]))
        lines = ["；".join(f"{names.get(i, f'列{i + 1}')}：{c}" for i, c in enumerate(row) if c) for row in (rows[1:] or rows)]
        parts += [*filter(None, lines), *(lines if len(rows) == 1 else ())]
    return T.cleaned("\n\n".join(parts))


def pdf_pages(raw: bytes) -> list[tuple[int, str]]:
    """(page from 1, cleaned text) of the pages that can be read and have text enough."""
    from pypdf import PdfReader

    found = []
    for n, page in enumerate(PdfReader(io.BytesIO(raw)).pages, 1):
        try:
            text = T.cleaned(page.extract_text())
        except Exception:  # one bad page is no bad file
            continue
        if len(text) >= LEAST_PAGE:
            found.append((n, text))
    return found


def kind_of(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""


def _parse(path: str, raw: bytes) -> tuple[list[tuple[int, str]], str | None]:
    """(page, cleaned text) of one file, or what was wrong with it."""
    kind = kind_of(path)
    try:
        if kind not in TYPES:
            return [], "unsupported type"
        if kind == "pdf":
            try:
                units = pdf_pages(raw)
            except ImportError:
                return [], "pypdf is not installed"
        elif kind in ("docx", "doc"):
            if raw[:2] != b"PK":
                return [], "legacy .doc"
            units = [(1, docx_text(raw))]
        else:
            units = [(n, t.strip()) for n, t in enumerate(HEADING.split(T.cleaned(decode_text(raw))), 1) if t.strip()]
        return ([], "empty document") if not any(t for _, t in units) else (units, None)
    except Exception as e:  # one bad file is a row of its own, not the end of the job
        return [], f"{type(e).__name__}: {e}"


def units(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """doc_id, page, text, source, source_type, file_hash, error: all files below `path`.

    Bad files have one row with `error`.  doc_id is the hash of the cleaned
    units, so files of equal content share it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                found, error = _parse(name, bytes(raw))
                rows += [(name, page, text, error) for page, text in found or [(1, "")]]
            yield pd.DataFrame(rows, columns=["path", "page", "text", "error"])

    parsed = files.select("path", "content").mapInPandas(run, "path string, page int, text string, error string")
    whole = parsed.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda r: r["text"]), "\n").alias("whole"))
    hashes = files.select("path", T.content_hash(F.col("content")).alias("file_hash"))
    name = F.element_at(F.split("path", "/"), -1)
    return parsed.join(whole, "path").join(hashes, "path").select(F.when(F.col("error").isNull(), T.content_hash(F.col("whole"))).alias("doc_id"), "page", "text", name.alias("source"), F.lower(F.element_at(F.split(name, r"\."), -1)).alias("source_type"), "file_hash", "error")


def inline(texts: DataFrame) -> DataFrame:
    """Units of pasted texts(text, source); empty ones go."""
    rows = texts.select(T.normalize(F.col("text")).alias("text"), "source").where(F.col("text") != "")
    return rows.select(T.content_hash(F.col("text")).alias("doc_id"), F.lit(1).alias("page"), "text", "source", F.lit("text").alias("source_type"), T.content_hash(F.col("text")).alias("file_hash"), F.lit(None).cast("string").alias("error"))


def eval_set(spark: SparkSession, path: str) -> DataFrame:
    """question, gold_sources, gold_keywords, expect_refusal from a JSON file with `cases`."""
    schema = "cases array<struct<question: string, gold_source: string, gold_sources: array<string>, gold_keywords: array<string>, expect_refusal: boolean>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("cases").alias("query_id", "c")).select("query_id", "c.*")
    gold = F.when(F.size("gold_sources") > 0, F.col("gold_sources")).when(F.col("gold_source") != "", F.array("gold_source")).otherwise(F.array().cast("array<string>"))
    return rows.select("query_id", "question", gold.alias("gold_sources"), F.coalesce("gold_keywords", F.array().cast("array<string>")).alias("gold_keywords"), F.coalesce("expect_refusal", F.lit(False)).alias("expect_refusal"))
