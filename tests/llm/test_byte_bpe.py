"""Operator 13 against the library itself on whole texts."""

import base64
import hashlib
import random
import struct

import pytest
import tiktoken
from pyspark.sql import functions as F

from textloom.llm import byte_bpe

PATH, PATTERN = byte_bpe.default_ranks(), byte_bpe.default_pattern()


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(13)
    letters = "ab'sé 1\n\t 　,.漢字\U0001f600́\x1c\x85"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)]
    return [None, "", " ", "  a", "a  ", "it's  'll", "<|endoftext|>", "x" * 5000, "\n" * 40, "a  b", *made]


@pytest.mark.parametrize("part", [1, 7, 1 << 16])
def test_parts_keep_the_matches(library, monkeypatch, part):
    import regex

    monkeypatch.setattr(byte_bpe, "LONG_SPACE", 3)
    monkeypatch.setattr(byte_bpe, "_LONG_SPACE", regex.compile(r"\s{3,}"))
    bpe = byte_bpe.ByteBpe(PATH, PATTERN)
    for t in texts():
        parts = list(byte_bpe.safe_parts(t or "", part))
        assert "".join(p for p, _ in parts) == (t or "")
        assert [i for p, whole in parts for i in (bpe.library._encode_single_piece(p.encode()) if whole else bpe.library.encode_ordinary(p))] == library.encode_ordinary(t or "")


def test_very_long_white_space_and_words():
    bpe = byte_bpe.ByteBpe(PATH, PATTERN)
    for t in (" " * 2_000_000 + "x y", "a" + "\n" * 1_500_000, "word " * 200_000, "ab1" * 300_000):
        assert bpe.decode(bpe.encode(t)) == t.encode()
    assert bpe.encode(" " * 50_000 + "x").tolist() == bpe.library.encode_ordinary(" " * 50_000 + "x")


def test_query_over_whole_table(spark, sf_dir, library):
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.op13_byte_bpe(spark, sf_dir).collect()}
    assert got == want


def test_encode_and_decode_columns(spark):
    rows = [(i, t, "clash", [1]) for i, t in enumerate(texts())] + [(None, "a b", "c", None), (None, "a b", "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids array<int>")
    out = byte_bpe.decode(byte_bpe.encode(docs, PATH, PATTERN), PATH, PATTERN)
    assert [t for _, t in out.select("ids", "decoded").dtypes] == ["array<int>", "binary"]
    assert sorted((r.text or "", bytes(r.decoded).decode()) for r in out.collect()) == sorted((t or "", t or "") for _, t, _, _ in rows)
    assert byte_bpe.digests(docs.withColumn("n_tokens", F.lit("x")), PATH, PATTERN).count() == len(rows)
    assert byte_bpe.digests(docs.where("1 = 0"), PATH, PATTERN).count() == 0


def test_decode_odd_ids(spark):
    half = byte_bpe.ByteBpe(PATH, PATTERN).encode("漢")[:1].tolist()
    tokens = spark.createDataFrame([(1, None), (2, []), (3, [None, -5, 10**9, *half])], "k int, ids array<int>")
    got = {r.k: bytes(r.decoded) for r in byte_bpe.decode(tokens, PATH, PATTERN).collect()}
    assert got[1] == got[2] == b"" and "漢".encode().startswith(got[3]) and got[3]
