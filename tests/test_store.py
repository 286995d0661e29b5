"""Collections as logs of versions: writers that meet, writers that die, what a commit touches."""

import os

import pytest
from pyspark.sql import functions as F

from textloom.operators import collections as M
from textloom.sources import store


def rows(spark, *pairs, schema="chunk_id string, v int"):
    return spark.createDataFrame(list(pairs), schema)


def held(c, number=None):
    return sorted((tuple(r) for r in c.scan(number).collect()), key=lambda r: (r[0] is None, r))


@pytest.fixture
def c(spark, tmp_path):
    return store.Collection(spark, str(tmp_path), "c")


def test_upsert_delete_and_old_versions(spark, c):
    assert c.scan() is None and c.versions() == [] and c.delete(rows(spark, ("a", 1))) == 0
    c.upsert(rows(spark, ("a", 1), ("b", 1), (None, 1)))
    c.upsert(rows(spark, ("b", 2), (None, 2), ("d", 2), ("d", 2)))
    assert c.delete(rows(spark, ("a", 0), ("zz", 0))) == 1
    assert held(c, 1) == [("a", 1), ("b", 1), (None, 1)] and held(c) == [("b", 2), ("d", 2), (None, 2)]
    assert c.versions() == [1, 2, 3]
    assert c.delete(rows(spark, ("zz", 0))) == 0 and c.versions() == [1, 2, 3]


def test_only_touched_buckets_are_written(spark, c):
    c.upsert(spark.range(5_000).select(F.col("id").cast("string").alias("chunk_id"), F.lit("some text of a row").alias("v")), buckets=32)
    before = c.version()
    after = c.upsert(rows(spark, ("77", "new"), schema="chunk_id string, v string"), buckets=32)
    changed = [b for b in after.files if after.files[b] != before.files.get(b)]
    assert len(changed) == 1 and after.written < before.written / 8
    assert c.scan().count() == 5_000 and c.scan().where("v = 'new'").count() == 1


def test_versions_of_repeated_keys_and_new_columns(spark, c):
    c.upsert(rows(spark, ("a", 1, None), ("a", 2, 5), ("a", 3, 4), schema="chunk_id string, v int, at int"), version="at")
    c.upsert(rows(spark, ("a", 9, None), schema="chunk_id string, v int, at int"), version="at")
    assert [tuple(r) for r in c.scan().collect()] == [("a", 9, None)]
    c.upsert(rows(spark, ("b", "x"), schema="chunk_id string, w string"))
    assert {tuple(r) for r in c.scan().select("chunk_id", "v", "at", "w").collect()} == {("a", 9, None, None), ("b", None, None, "x")}
    with pytest.raises(ValueError):
        c.upsert(rows(spark, ("b", "x"), schema="chunk_id string, v string"))
    with pytest.raises(ValueError):
        c.upsert(rows(spark, ("b", 1), schema="other string, v int"))


def meet(monkeypatch, c, other):
    """The next commit of `c` is published after `other()` has published its own."""
    publish, pending = store.Collection._publish, [other]

    def late(self, new):
        if pending and self is c:
            pending.pop()()
        return publish(self, new)

    monkeypatch.setattr(store.Collection, "_publish", late)


def buckets_of(spark, keys, n):
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    return {r.k: r.b for r in df.select("k", F.pmod(F.xxhash64("k"), F.lit(n)).alias("b")).collect()}


@pytest.mark.parametrize("apart", [True, False])
def test_two_writers(spark, c, monkeypatch, apart):
    of = buckets_of(spark, [f"k{i}" for i in range(200)], store.BUCKETS)
    a = "k0"
    b = next(k for k in of if k != a and (of[k] != of[a]) == apart)
    c.upsert(rows(spark, (a, 1), (b, 1)))
    other = store.Collection(spark, os.path.dirname(c.path), "c")
    writes = []
    write = store.Collection._write
    monkeypatch.setattr(store.Collection, "_write", lambda self, *x: writes.append(self is c) or write(self, *x))
    meet(monkeypatch, c, lambda: other.upsert(rows(spark, (b, 2))))
    c.upsert(rows(spark, (a, 3)))
    assert held(c) == sorted([(a, 3), (b, 2)]) and c.versions() == [1, 2, 3]
    assert writes.count(True) == (1 if apart else 2)  # only a changed bucket is written again


def test_dead_writers_block_nothing(spark, c, monkeypatch):
    c.upsert(rows(spark, ("a", 1)))
    publish = store.Collection._publish

    def die(self, new):
        raise KeyboardInterrupt

    for _ in range(2):
        monkeypatch.setattr(store.Collection, "_publish", die)
        with pytest.raises(KeyboardInterrupt):
            c.upsert(rows(spark, ("b", 1)))
        monkeypatch.setattr(store.Collection, "_publish", publish)
    assert held(c) == [("a", 1)]
    c.upsert(rows(spark, ("c", 1)))
    assert held(c) == [("a", 1), ("c", 1)]
    assert c.clear(older=3600) == 0
    assert c.clear(older=-1) >= 2
    assert held(c) == [("a", 1), ("c", 1)] and c.versions() == [2]


def test_append_and_replayed_batches(spark, c):
    c.append(rows(spark, ("a", 1)), stream="s", batch=0)
    c.append(rows(spark, ("b", 1)), stream="s", batch=1)
    c.append(rows(spark, ("b", 1)), stream="s", batch=1)
    c.append(rows(spark, ("a", 1)), stream="s", batch=0)
    assert held(c) == [("a", 1), ("b", 1)] and c.versions() == [1, 2]
    c.append(rows(spark, ("c", 1)), stream="t", batch=0)
    for i in range(3):
        c.append(rows(spark, ("a", 10 + i)))
    n = max(len(f) for f in c.version().files.values())
    c.compact(most=1)
    assert n == 4 and max(len(f) for f in c.version().files.values()) == 1 and len(held(c)) == 6
    assert c.version().batches == {"s": 1, "t": 0}


def test_appending_writer_that_meets_another(spark, c, monkeypatch):
    c.append(rows(spark, ("a", 1)), stream="s", batch=0)
    other = store.Collection(spark, os.path.dirname(c.path), "c")
    meet(monkeypatch, c, lambda: other.append(rows(spark, ("b", 1)), stream="s", batch=1))
    c.append(rows(spark, ("b", 1)), stream="s", batch=1)  # the same batch, run twice at once
    assert held(c) == [("a", 1), ("b", 1)]


def test_names_and_drop(spark, c, tmp_path):
    assert M.collections(spark, str(tmp_path)) == []
    M.write(rows(spark, ("a", 1)), str(tmp_path), "c")
    M.write(rows(spark, schema="chunk_id string, v int"), str(tmp_path), "d")
    assert M.collections(spark, str(tmp_path)) == ["c", "d"] and M.scan(spark, str(tmp_path), "d").count() == 0
    assert (c.drop(), c.drop()) == (True, False)
    with pytest.raises(ValueError):
        store.Collection(spark, str(tmp_path), "../c")


def test_upsert_keeps_rows_of_a_null_version(spark):
    schema = "k int, v int, version int"
    out = M.upsert(rows(spark, (1, 10, 0), (None, 5, 0), schema=schema), rows(spark, (1, 20, None), (None, 6, 1), (None, 7, None), schema=schema), "k")
    assert {tuple(r) for r in out.collect()} == {(1, 20, None), (None, 6, 1)}
