"""Operator 12 against plain Python."""

import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from textloom.llm import importance, ranking

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def grams(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, bench):
    of = [(i, *grams(t)) for i, t in docs]
    s, t = collections.Counter(b for _, _, f in of for b in f), collections.Counter(b for x in bench for b in grams(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + 10000) / ((s[b] + 1) * (nt + 10000)))) for b in set(s)}
    out, able = {}, []
    for i, n, f in of:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out[i] = [len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        if n >= 20:
            able.append((-out[i][2], i))
    for k, (_, i) in enumerate(sorted(able)[: 5 * len(able) // 100]):
        out[i][3] = k + 1
    return out


@pytest.mark.parametrize("block", [1 << 18, 3])
def test_buckets_of_runs(monkeypatch, block):
    import pyarrow as pa

    monkeypatch.setattr(importance, "BLOCK_WORDS", block)
    texts = ["The mit LICENSE é1 the mit license", None, "", "one", "a-b", "É漢 x" * 3, "y" * 5000 + " z"]
    got = collections.defaultdict(list)
    importance.buckets(pa.array(texts), lambda at, found: [got[n].extend(found[n]) for n in range(3)])
    want = sorted(b for t in texts for b in grams(t)[1])
    assert sorted(b for n in range(3) for b in got[n] if b < 10000) == want


def test_query_over_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    bench = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = brute(docs, bench)
    got = importance.op12_importance(spark, sf_dir)
    assert got.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    assert {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in got.collect()} == want
    assert any(v[3] for v in want.values())


def test_odd_tables(spark):
    long = " ".join(f"w{i % 701}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n"), (None, "no key " * 20), (5, long), *((10 + i, "one two three " * 9) for i in range(60)), (70, "one two three " * 9), (70, "one two three " * 9)]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, rank int, weight string, n_words int")
    bench = spark.createDataFrame([(None,), ("two three one",)], "text string")
    got = importance.resample(docs, bench).collect()
    assert len(got) == len(rows) and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]
    want = brute(rows, [None, "two three one"])
    assert all([r.n_features, r.weight, r.score] == want[r.doc_id][:3] for r in got)
    assert {r.weight for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert importance.resample(docs.where("1 = 0"), bench).count() == 0
    assert importance.resample(docs, bench.where("1 = 0")).count() == len(rows)


def test_ranks_of_hot_groups_and_ties(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), (F.col("id") * 7919 % 1000).alias("v"), "id")
    got = ranking.ranked(rows, ["g"], [F.desc("v"), F.asc("id")]).toPandas()
    want = got.sort_values(["g", "v", "id"], ascending=[True, False, True]).groupby("g").cumcount()
    assert (got["position"] == want).all() and len(got) == 20_000
