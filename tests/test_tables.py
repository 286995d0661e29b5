"""Table functions in SQL, and the splitter against a second one over whole tables."""

import re

import pytest

from textloom.functions import tables
from textloom.operators import chunking as C


def second_splitter(text, size, overlap, separators=C.SEPARATORS):
    """Splits at the first separator that occurs, keeping it at the front; merges pieces up to the size; splits pieces that are too long by the rest."""
    for n, sep in enumerate(separators):
        if sep == "" or sep in text:
            break
    rest = separators[n + 1 :]
    pieces = [p for p in (re.split(f"(?={re.escape(sep)})", text) if sep else list(text)) if p]
    if sep and len(sep) == 2 and sep[0] == sep[1]:  # overlapping places of one separator
        cut = text.split(sep)
        pieces = [p for p in [cut[0], *(sep + c for c in cut[1:])] if p]

    def merge(small):
        out, window = [], []
        for p in small:
            if window and sum(map(len, window)) + len(p) > size:
                out.append("".join(window).strip())
                while window and (sum(map(len, window)) > overlap or sum(map(len, window)) + len(p) > size):
                    window = window[1:]
            window = [*window, p]
        return [c for c in [*out, "".join(window).strip()] if c]

    out, good = [], []
    for p in pieces:
        if len(p) < size or not rest:
            good.append(p)
            continue
        out += merge(good) + second_splitter(p, size, overlap, rest)
        good = []
    return out + merge(good)


@pytest.mark.parametrize(("size", "overlap"), [(500, 80), (90, 25), (40, 0)])
def test_second_splitter_over_a_whole_table(spark, sf_dir, size, overlap):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 20000")
    got = {}
    for r in C.recursive_chunks(docs, size, overlap).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_index, r.text))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, text in texts.items():
        want = second_splitter(text, size, overlap) if text and text.strip() else []
        assert [t for _, t in sorted(got.get(i, []))] == want, i


def test_chunks_in_sql(spark, sf_dir):
    tables.register(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.createOrReplaceTempView("docs_of_sql")
    rows = spark.sql("SELECT doc_id, c.* FROM docs_of_sql, LATERAL split_chunks(text, 500, 80) c").collect()
    want = C.recursive_chunks(docs, 500, 80).collect()
    assert len(want) > 100 and sorted(map(tuple, rows)) == sorted(map(tuple, want))
    with pytest.raises(Exception, match="smaller"):
        spark.sql("SELECT * FROM split_chunks('a', 5, 5)").collect()


def test_parts_in_sql(spark):
    tables.register(spark)
    rows = spark.sql("SELECT t.id, p.* FROM VALUES (1, 'intro\\n# one\\ntext'), (2, NULL), (3, '  '), (4, '# only') t (id, text), LATERAL split_parts(text) p").collect()
    assert sorted(map(tuple, rows)) == [(1, 1, "intro"), (1, 2, "# one\ntext"), (4, 1, "# only")]
