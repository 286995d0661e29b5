"""The inverted-file index against a search through all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import ann
from textloom.operators import search as S


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 24))
    made = [(i, (centres[i % 30] + 0.4 * rng.normal(size=24)).tolist(), i % 3) for i in range(3_000)]
    odd = [(9_001, None, 0), (9_002, [0.0] * 24, 0), (9_003, [1.0], 0), (9_004, [float("nan")] * 24, 0), (9_005, [None] * 24, 0), (None, [1.0] * 24, 0), (9_006, made[0][1], 0)]
    return spark.createDataFrame(made + odd, "vec_id long, embedding array<double>, label int").repartition(5)


@pytest.fixture(scope="module")
def index(rows):
    return ann.build(rows, ann.fit(rows, length=24), carry=("label",))


def brute(rows, questions, k):
    of = lambda df: [(r.vec_id, np.array(r.embedding)) for r in df.collect() if r.vec_id is not None and r.embedding and len(r.embedding) == 24 and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)]
    held, out = of(rows), set()
    ids, m = np.array([i for i, _ in held]), np.stack([v / np.linalg.norm(v) for _, v in held])
    for i, v in of(questions):
        score = np.round(np.clip(m @ (v / np.linalg.norm(v)), 0, 1), 9)
        out |= {(i, int(ids[at]), n + 1) for n, at in enumerate(np.lexsort((ids, -score))[:k])}
    return out


def found(df):
    return {(r.query_id, r.id, r["rank"]) for r in df.collect()}


def test_exact_search_is_that_of_all_rows(index, rows):
    asked = rows.where("vec_id % 60 = 0 or vec_id > 9000 or vec_id is null")
    assert found(ann.search(index, asked, 10, exact=True)) == brute(rows, asked, 10)
    assert found(ann.search(index, asked, 10, exact=True, where=F.col("label") == 1)) == brute(rows.where("label = 1"), asked, 10)


def test_more_wanted_than_there_are(spark, index, rows):
    asked = rows.where("vec_id in (5, 6)")
    assert found(ann.search(index, asked, 4_000, exact=True)) == brute(rows, asked, 4_000)


def test_recall_grows_with_probes(index, rows):
    asked = rows.where("vec_id % 50 = 0")
    exact = ann.search(index, asked, 10, exact=True)
    shares = [ann.recall(ann.search(index, asked, 10, probes=p), exact).first().recall for p in (1, 4, 60)]
    assert shares == sorted(shares) and shares[1] >= 0.9 and shares[2] >= 0.97


def test_tuned_probes_reach_the_recall(index, rows):
    asked = rows.where("vec_id % 37 = 0")
    probes = ann.tune(index, 10)
    assert 1 <= probes <= len(index.model.centres)
    assert ann.recall(ann.search(index, asked, 10, probes=probes), S.knn(rows, asked, 10)).first().recall >= 0.9


def test_split_cells_and_crowds(monkeypatch, rows):
    monkeypatch.setattr(ann, "CELL_ROWS", 40)
    monkeypatch.setattr(ann, "ASKED", 3)
    index = ann.build(rows, ann.fit(rows, length=24, cells=7))
    assert index.cells.agg(F.max("parts")).first()[0] > 3
    assert index.rows.groupBy("cell", "part").count().agg(F.max("count")).first()[0] < 90
    asked = rows.where("vec_id % 100 = 0")
    assert found(ann.search(index, asked, 5, exact=True)) == brute(rows, asked, 5)


def test_reload_and_empty(spark, tmp_path, rows):
    index = ann.build(rows, ann.fit(rows, length=24, cells=5, subspaces=5), path=str(tmp_path / "i"))
    again = ann.load(spark, str(tmp_path / "i"))
    assert np.array_equal(again.model.centres, index.model.centres) and all(map(np.array_equal, again.model.books, index.model.books))
    asked = rows.where("vec_id = 7")
    assert found(ann.search(again, asked, 3, exact=True)) == brute(rows, asked, 3)
    assert ann.search(again, asked.where("1 = 0"), 3, exact=True).count() == 0
    nothing = ann.build(rows.where("1 = 0"), ann.fit(rows.where("1 = 0"), length=24))
    assert ann.search(nothing, asked, 3, exact=True).count() == 0


def test_string_keys_and_hits_of_knn(spark, rows):
    named = rows.where("vec_id < 500").withColumn("vec_id", F.concat(F.lit("k"), F.col("vec_id")))
    index = ann.build(named, ann.fit(named, length=24))
    got = found(ann.search(index, named.where("vec_id = 'k7'"), 3, exact=True))
    assert {i[1:] for _, i, _ in got} == {str(i) for _, i, _ in brute(rows.where("vec_id < 500"), rows.where("vec_id = 7"), 3)}


def test_knn_of_mixed_lengths_and_string_keys(spark, monkeypatch):
    """Hits don't depend on which questions share a block, and keys keep their type."""
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(f"k{i}", rng.normal(size=(3, 5, 8)[i % 3]).tolist()) for i in range(40)] + [("z", None), ("y", []), (None, [1.0] * 3), ("x", [0.0] * 3)], "vec_id string, embedding array<double>")
    whole = found(S.knn(rows, rows, 4))
    assert len({q for q, _, _ in whole}) == 40 and all(int(q[1:]) % 3 == int(i[1:]) % 3 for q, i, _ in whole)
    monkeypatch.setattr(S, "BLOCK", 7)
    assert found(S.knn(rows, rows, 4)) == whole
    small = rows.where("vec_id like 'k%'").limit(9).withColumn("vec_id", F.substring("vec_id", 2, 3).cast("int"))
    assert dict(S.knn(small, small, 2).dtypes)["id"] == "int" and S.knn(small, small, 2).count() == 18
