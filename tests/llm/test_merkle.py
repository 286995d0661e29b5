"""Operator 11 against plain Python."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from textloom.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        s = i // 16 * 16
        out.append((level[s:i], level[i + 1 : s + 16]))
        i //= 16
    return out


def brute(rows):
    """For each row, ordered by source, key and leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    by = {}
    for r in rows:
        by.setdefault("" if r["source"] is None else "=" + r["source"], []).append(r)
    keys = sorted(by, key=str.encode)
    trees = {}
    for k in keys:
        by[k].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[k] = tree([leaf(r) for r in by[k]])
    top = tree([trees[k][-1][0] for k in keys])
    out = []
    for at, k in enumerate(keys):
        for i, r in enumerate(by[k]):
            steps = path(trees[k], i) + path(top, at)
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None
            node = leaf(r | {"text": re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])} if tampered else r)
            for a, b in steps:
                node = h(*a, node, *b)
            out.append((r["doc_id"], leaf(r), trees[k][-1][0], top[-1][0], h(*(x for a, b in steps for x in a + b)), node, node == top[-1][0]))
    return out


def sort(rows):
    return sorted(map(tuple, rows), key=repr)


def run(docs):
    changed = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.proofs(merkle.manifest(docs, F.when(changed, merkle.leaf(F.translate("text", merkle.UPPER, merkle.LOWER)))))


def test_query_over_whole_table(spark, sf_dir):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = merkle.op11_merkle(spark, sf_dir)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sort(got.collect())
    assert got == sort(brute(rows)) and {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("counts", [[1], [1, 16, 17], [256, 257, 300], [3] * 20, [4097, 2]])
def test_sizes_around_full_runs(spark, counts):
    rows = [{"doc_id": i, "source": f"s{k}", "lang": "en", "n_chars": i, "text": f"Text {i}"} for k, n in enumerate(counts) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert sort(run(docs).collect()) == sort(brute(rows))


def test_odd_rows(spark):
    odd = [(1, None, None, None, None), (1, None, None, None, None), (None, "s", "en", 1, "No Key"), (None, "", "en", 2, ""), (2, "", "é", -3, "A" * 300_000), (3, "s", "-", 0, "-"), (4, "é", "", 1, "x"), (5, "Z", "", 1, "Ä")]
    docs = spark.createDataFrame([(*r, "x", "y", 3) for r in odd], "doc_id long, source string, lang string, n_chars long, text string, leaf string, key string, position int")
    assert sort(run(docs).collect()) == sort(brute([dict(zip(FIELDS, r, strict=True)) for r in odd]))
    assert run(docs.where("1 = 0")).count() == 0 and merkle.manifest(docs.where("1 = 0")).root is None


def test_log_positions(spark):
    docs = spark.range(700).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.col("id").cast("string").alias("text"))
    made = merkle.manifest(docs)
    log = merkle.nodes(made.rounds)
    held = {r.position: (r.level, r["index"], r.digest) for r in log.collect()}
    levels = tree([leaf({"doc_id": i, "source": "s", "lang": "en", "n_chars": 1, "text": str(i)}) for i in range(700)])
    assert sorted(held) == list(range(sum(map(len, levels))))  # gapless
    assert all(levels[level][i] == d for level, i, d in held.values())
    assert [held[p][2] for p in range(len(held))] == merkle.completed(levels[0], len(levels) - 1)
    for i in (0, 15, 16, 255, 256, 699):
        assert merkle.proof(log, "=s", i, 700) == path(levels, i)


def test_every_change_is_found(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("same").alias("text"))
    other = F.when(F.col("doc_id") % 2 == 0, merkle.leaf(F.lit("other")))
    assert all(r.verified == (r.doc_id % 2 == 1) for r in merkle.proofs(merkle.manifest(docs, other)).collect())
