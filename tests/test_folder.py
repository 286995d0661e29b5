"""The folder source in batches and streams, and the parsers."""

import io
import os
import re
import sys
import types
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.sources import files, folder

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def para(t):
    return f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"


def table(*rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


@pytest.fixture
def place(tmp_path):
    made = {"b.md": b"intro\n# one\ntext\n## two\nmore", "a.txt": "年假制度".encode("gbk"), "sub/c.docx": docx(para("Para  one") + table(("h1", "h2"), ("a", "b"))), "sub/empty.txt": b" \n", "sub/same.md": b"intro\r\n# one\r\ntext\r\n## two\r\nmore", "old.doc": b"\xd0\xcf", "skip.exe": b"x"}
    for name, raw in made.items():
        os.makedirs(tmp_path / "in" / os.path.dirname(name), exist_ok=True)
        (tmp_path / "in" / name).write_bytes(raw)
    return tmp_path / "in"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_batch(spark, place):
    folder.register(spark)
    got = spark.read.format("documents").load(str(place))
    assert [f.simpleString() for f in got.schema] == ["doc_id:string", "page:int", "text:string", "source:string", "source_type:string", "file_hash:string", "error:string"]
    held = {}
    for r in got.collect():
        held.setdefault(r.source, []).append(r)
    assert set(held) == {"b.md", "a.txt", "c.docx", "empty.txt", "same.md", "old.doc"}
    assert [(r.page, r.text) for r in held["b.md"]] == [(1, "intro"), (2, "# one\ntext"), (3, "## two\nmore")]
    assert held["b.md"][0].doc_id == held["same.md"][0].doc_id and held["b.md"][0].file_hash != held["same.md"][0].file_hash
    assert held["a.txt"][0].text == "年假制度" and held["empty.txt"][0].error == "empty document" and held["old.doc"][0].error == "legacy .doc"
    want = files.units(spark, str(place)).where("source <> 'skip.exe'").select(*got.columns)
    assert rows(got) == rows(want)
    assert got.where("source_type = 'docx'").first().text == "Para one\n\n【表格 1】\n\nh1:a;h2:b"


def test_options(spark, place):
    folder.register(spark)
    assert {r.source for r in spark.read.format("documents").option("recursive", "false").load(str(place)).collect()} == {"a.txt", "b.md", "old.doc"}
    reading = folder.BatchReader({"path": str(place), "partitionBytes": "40"})
    parts = [p.paths for p in reading.partitions()]
    assert len(parts) == 3 and [p for ps in parts for p in ps] == sorted(p for ps in parts for p in ps)
    assert spark.read.format("documents").option("partitionBytes", "40").load(str(place)).rdd.getNumPartitions() == len(parts)
    with pytest.raises(Exception, match="legacy .doc|empty document"):
        spark.read.format("documents").option("onError", "raise").load(str(place)).collect()
    assert spark.read.format("documents").option("onError", "raise").load(str(place / "b.md")).count() == 3
    assert spark.read.format("documents").load(str(place / "skip.exe")).first().error == "unsupported type"
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("documents").load(str(place / "nowhere")).collect()


def test_stream_gives_the_same_units(spark, place, tmp_path):
    folder.register(spark)

    def run():
        stream = spark.readStream.format("documents").load(str(place))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable()
        query.stop()
        return rows(spark.read.parquet(str(tmp_path / "out")))

    assert run() == rows(spark.read.format("documents").load(str(place)))
    (place / "later.txt").write_text("later")
    assert run() == rows(spark.read.format("documents").load(str(place)))


def test_docx_tables():
    raw = docx(para("  A ​ b") + para("") + table(("k", "v", "v", "w"), ("1", "", "", "4", "5"), ("", "")) + table(("only", "row")) + table(("", "")))
    assert files.docx_text(raw) == "A b\n\n【表格 1】\n\nk:1;w:4;列4:5\n\n【表格 2】\n\nonly:only;row:row\n\nonly:only;row:row"


def test_pdf_pages(monkeypatch):
    class Page:
        def __init__(self, text):
            self.text = text

        def extract_text(self):
            if self.text == "bad":
                raise ValueError("broken page")
            return self.text

    pages = [Page("long enough text"), Page("short"), Page("bad"), Page(None), Page("spaced      text"), Page("a  b      c  d")]
    monkeypatch.setitem(sys.modules, "pypdf", types.SimpleNamespace(PdfReader=lambda raw: types.SimpleNamespace(pages=pages)))
    assert files._parse("x/y.PDF", b"%PDF") == ([(1, "long enough text"), (5, "spaced text")], None)
    pages[:] = [Page("tiny")]
    assert files._parse("y.pdf", b"%PDF") == ([], "empty document")


def test_cleaning_in_python_is_that_of_the_column(spark, sf_dir):
    odd = ["ａｂ　　ｃ", "x​y", "a-\nb", "a\r\nb\rc", "line\n*\nnext", "  a 　\n\n\n\n b\t\tc ", "é\n—\nz", "", None, "\x07bell"]
    texts = spark.createDataFrame([(t,) for t in odd], "text string").union(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text"))
    for r in texts.select("text", T.normalize(F.col("text")).alias("n")).collect():
        assert T.cleaned(r.text) == r.n


def test_cleaning_by_plain_steps(spark, sf_dir):
    """T1 over a whole table, step by step without patterns where that is possible."""

    def plain(text):
        text = "".join(c for c in unicodedata.normalize("NFKC", text or "") if not (0x200B <= ord(c) <= 0x200F or 0x202A <= ord(c) <= 0x202E or c in "﻿­"))
        text = "".join(c for c in text if c in "\t\n\r" or not (ord(c) < 32 or ord(c) == 127))
        text = "\n".join("\n".join(text.split("\r\n")).split("\r"))
        out = []
        for i, c in enumerate(text):
            cut = c == "-" and i and text[i - 1].isascii() and text[i - 1].isalpha() and text[i + 1 : i + 2] == "\n" and "a" <= text[i + 2 : i + 3] <= "z"
            after = c == "\n" and i > 1 and text[i - 1] == "-" and text[i - 2].isascii() and text[i - 2].isalpha() and "a" <= text[i + 1 : i + 2] <= "z"
            out.append("" if cut or after else c)
        lines = "".join(out).split("\n")
        held = ["" if line.strip() == line.rstrip() and len(line.rstrip()) == 1 and not (line[0] == "_" or line[0].isalnum()) else line for line in lines]
        text = re.sub("[ \t　]{2,}", " ", "\n".join(held))
        while "\n\n\n" in text:
            text = text.replace("\n\n\n", "\n\n")
        return "\n".join(line.strip() for line in text.split("\n")).strip()

    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(T.normalize(F.col("text")).alias("n"), "text").collect():
        assert r.n == plain(r.text)
