"""Posting lists with bounds against plain BM25, and deltas against indexes made anew."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import postings as P
from textloom.operators import search as S


def docs_of(n, seed=5, begin=0):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4_000)]
    return [(begin + i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 20, 90])))) for i in range(n)]


def frame(spark, rows, key="doc_id"):
    return spark.createDataFrame(rows, f"{key} long, text string")


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(1)
    rows = [(q, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(4))) for q in range(25)]
    return frame(spark, [*rows, (90, ""), (91, None), (92, "unheard of"), (93, "w1 w1 w2")], "query_id")


def hits(df):
    return {(r.query_id, r.id, round(r.score, 7), r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("block", [128, 7])
def test_equal_to_plain_bm25(spark, tmp_path, monkeypatch, asked, block):
    monkeypatch.setattr(P, "BLOCK_DOCS", block)
    docs = frame(spark, [*docs_of(600), (10_000, None), (None, "w1 w2")])
    held = P.Postings(spark, str(tmp_path / "p"))
    held.add(docs)
    found = held.search(asked, 10)
    assert hits(found.hits) == hits(S.bm25(asked, S.index(docs.where("doc_id is not null")), 10))
    read = found.read.first()
    assert read.scored <= read.postings and (block == 128 or read.scored < 0.9 * read.postings)


def state(held):
    terms, n, mean = held.statistics()
    return {(r.token, r.df, round(r.idf, 9)) for r in terms.collect()}, n, round(mean, 9)


def test_any_order_of_adds_and_deletes(spark, tmp_path, asked):
    rng, held, now = random.Random(2), P.Postings(spark, str(tmp_path / "p")), {}
    assert held.delete(frame(spark, [(1, "")])) == 0
    for step in range(6):
        if step % 3 == 2:
            gone = rng.sample(sorted(now), 40)
            assert held.delete(frame(spark, [(i, "") for i in [*gone, 99_999]])) == len(gone)
            now = {i: t for i, t in now.items() if i not in gone}
        else:
            new = docs_of(120, seed=step, begin=60 * step)  # half of them replace others, some come back
            held.add(frame(spark, new))
            now |= dict(new)
    anew = S.index(frame(spark, sorted(now.items())))
    want = {(r.token, r.df, round(r.idf, 9)) for r in anew.terms.collect()}, len(now), round(anew.corpus.first().avgdl, 9)
    rows = lambda x: sorted((r.id, r.dl, sorted(zip(r.tokens, r.tfs, strict=True))) for r in x.collect())
    assert state(held) == want and rows(held.live().rows) == rows(anew.rows)
    assert hits(held.search(asked, 10).hits) == hits(S.bm25(asked, anew, 10)) == hits(S.bm25(asked, held.live(), 10))
    assert len(held.segments()) > 6
    held.compact()
    assert len(held.segments()) == 1 and state(held) == want and hits(held.search(asked, 10).hits) == hits(S.bm25(asked, anew, 10))


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    held = P.Postings(spark, str(tmp_path / "p"))
    held.add(frame(spark, [(1, "one two"), (2, "two")]))
    publish, pending = P.Postings.publish, [lambda: P.Postings(spark, str(tmp_path / "p")).add(frame(spark, [(3, "two three")]))]

    def late(self, *x):
        if pending and self is held:
            pending.pop()()
        return publish(self, *x)

    monkeypatch.setattr(P.Postings, "publish", late)
    held.add(frame(spark, [(3, "three"), (4, "four")]))
    assert {(r.id, *r.tokens) for r in held.live().rows.collect()} == {(1, "one", "two"), (2, "two"), (3, "three"), (4, "four")}
    assert state(held)[1] == 4


def test_string_ids_and_nothing(spark, tmp_path, asked):
    held = P.Postings(spark, str(tmp_path / "p"))
    assert held.search(asked, 3).hits.count() == 0
    held.add(frame(spark, docs_of(30)).withColumn("doc_id", F.concat(F.lit("d"), "doc_id")))
    assert held.search(asked, 3).hits.where("id like 'd%'").count() > 0
    held.delete(held.live().rows.select("id"), "id")
    assert held.search(asked, 3).hits.count() == 0 and state(held)[1] == 0
