"""The signed hash of n-grams against hashlib and a plain version of the vectors."""

import hashlib
import math
import re

from pyspark.sql import functions as F

from textloom.operators import search as S
from textloom.sources.tables import counted


def plain(text, dim=512):
    weights, vector = {}, [0.0] * dim
    for run in re.findall("[一-鿿]+|[A-Za-z0-9]+", text.lower()):
        cjk = "一" <= run[0] <= "鿿"
        parts = [(c, 1.0) for c in run] + ([(run, 2.0)] if not cjk and len(run) > 1 else [])
        if cjk:
            parts += [(run[i : i + 2], 2.0) for i in range(len(run) - 1)] + [(run[i : i + 3], 1.5) for i in range(len(run) - 2)]
        for gram, w in parts:
            weights[gram] = weights.get(gram, 0) + w
    for gram, w in weights.items():
        h = hashlib.blake2b(gram.encode(), digest_size=8).digest()
        vector[int.from_bytes(h[:4], "little") % dim] += (1 if h[4] & 1 else -1) * (1 + math.log(w))
    norm = math.sqrt(sum(x * x for x in vector))
    return {i: round(x / norm, 9) for i, x in enumerate(vector) if abs(x) > 1e-9}


def test_digest_is_that_of_hashlib(spark):
    rows = spark.range(1_000_000).select(F.concat(F.lit("漢g"), F.col("id") % 300_000).alias("gram"))
    wrong = rows.select("gram", F.hex(S.blake2b_64("gram")).alias("h")).distinct().collect()
    assert len(wrong) == 300_000 and all(r.h == hashlib.blake2b(r.gram.encode(), digest_size=8).hexdigest().upper() for r in wrong)


def test_vectors(spark, sf_dir):
    rows = [(-1, "年假制度 and the 3 Rules"), (-2, ""), (-3, None), (-4, "a")] + [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in S.hashed_vectors(docs, digest="blake2b").collect():
        got.setdefault(r.id, {})[r.bucket] = round(r.value, 9)
    assert got == {i: plain(t) for i, t in rows if t and plain(t)}


def test_counted_is_one_job(spark):
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup())
    out, n = counted(spark.range(1_234).where("id % 2 = 0"), "numbers")
    assert len(set(tracker.getJobIdsForGroup()) - before) == 1
    assert n == 617 == out.count()
    assert counted(spark.range(0), "none")[1] == 0
