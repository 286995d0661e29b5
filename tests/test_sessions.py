"""Sessions and ingest on streams: order, reset, expiry, restart, replayed batches."""

import datetime
import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.sources.store import Collection
from textloom.streaming import sessions

EVENT = "session_id string, kind string, turn long, question string, answer string, at timestamp"
NOON = datetime.datetime(2024, 5, 1, 12)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(sessions.PROVIDER)
    spark.conf.set(sessions.PROVIDER, sessions.ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set(sessions.PROVIDER, before)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


class Stream:
    """Batches of events, each a file, through `remember` into a table."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options, self.runs, self.files = spark, str(folder), options, 0, 0
        os.makedirs(f"{self.folder}/in")

    def run(self, *batches, until=None):
        for events in batches:
            path = f"{self.folder}/made{self.files}"
            self.spark.createDataFrame([(s, k, t, q, a, NOON + datetime.timedelta(minutes=m)) for s, k, t, q, a, m in events], EVENT).coalesce(1).write.parquet(path)
            os.rename(glob.glob(f"{path}/part-*")[0], f"{self.folder}/in/{self.files:03d}.parquet")
            os.utime(f"{self.folder}/in/{self.files:03d}.parquet", (1_700_000_000 + self.files,) * 2)
            self.files += 1
        stream = self.spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in").withWatermark("at", "1 minute")
        out = sessions.remember(stream, **self.options).writeStream.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{self.folder}/out"))
        query = out.outputMode("update").option("checkpointLocation", f"{self.folder}/c")
        if until is None:
            query = query.trigger(availableNow=True).start()
            query.awaitTermination(120)
        else:  # timers by the time of processing keep the trigger busy
            query, begun = query.start(), time.time()
            while not until(self.rows()) and time.time() < begun + 60:
                time.sleep(0.5)
            query.stop()
        assert query.exception() is None
        return self.rows()

    def rows(self):
        held = glob.glob(f"{self.folder}/out/part*")
        rows = self.spark.read.parquet(f"{self.folder}/out").orderBy("batch").collect() if held else []
        return [(r.session_id, r.event, [(t.turn, t.question, t.answer) for t in r.turns]) for r in rows]


def turn(s, n, minute=0, answer="a"):
    return (s, "turn", n, f"q{n}", answer, minute)


def test_order_within_and_across_batches(spark, tmp_path, rocks):
    stream = Stream(spark, tmp_path, n=3, by_events=True)
    rows = stream.run([turn("s", 4), turn("s", 2), (" ", "turn", 1, "q", "a", 0), (None, "turn", 1, "q", "a", 0)], [turn("s", 3), turn("s", 1), ("s", "turn", 4, "tab\tq", None, 0)])
    assert [r for r in rows if r[1] == "update"] == [("s", "update", [(2, "q2", "a"), (4, "q4", "a")]), ("s", "update", [(2, "q2", "a"), (3, "q3", "a"), (4, "tab\tq", None)])]
    rows = stream.run([turn("s", 5)])  # restarted from the checkpoint
    assert rows[-1] == ("s", "update", [(3, "q3", "a"), (4, "tab\tq", None), (5, "q5", "a")])


def test_reset(spark, tmp_path, rocks):
    stream = Stream(spark, tmp_path, n=6, by_events=True)
    rows = stream.run([turn("s", 1), turn("s", 2), turn("t", 1)], [("s", "reset", 3, None, None, 0), turn("s", 4)], [turn("s", 2), turn("s", 5)], [("s", "reset", None, None, None, 0)])
    assert [r for r in rows if r[0] == "s"] == [
        ("s", "update", [(1, "q1", "a"), (2, "q2", "a")]),
        ("s", "reset", [(4, "q4", "a")]),
        ("s", "update", [(4, "q4", "a"), (5, "q5", "a")]),  # turn 2 came after its reset
        ("s", "reset", []),
    ]
    assert [r for r in rows if r[0] == "t"] == [("t", "update", [(1, "q1", "a")])]


def test_expiry_and_reading(spark, tmp_path, rocks):
    stream = Stream(spark, tmp_path, n=6, minutes=30, by_events=True)
    rows = stream.run([turn("idle", 1), turn("read", 1)], [("read", "read", None, None, None, 20)], [turn("other", 1, 45)], [turn("other", 2, 46)], [turn("idle", 2, 47), turn("read", 2, 48)])
    assert [r for r in rows if r[0] == "idle"] == [("idle", "update", [(1, "q1", "a")]), ("idle", "expired", []), ("idle", "update", [(2, "q2", "a")])]
    assert rows[-1][0] in ("idle", "read", "other") and ("read", "expired", []) not in rows
    assert ("read", "update", [(1, "q1", "a"), (2, "q2", "a")]) in rows


def test_initial_state(spark, tmp_path, rocks):
    table = spark.createDataFrame([("s", i, f"q{i}", "a", NOON) for i in range(9)] + [("s", 8, "q8", "a", NOON), ("", 1, "q", "a", NOON), ("old", 1, "q", "a", NOON - datetime.timedelta(hours=3))], "session_id string, turn long, question string, answer string, at timestamp")
    held = sessions.remembered(table, 4)
    assert [(r.session_id, [t.turn for t in r.turns]) for r in held.where("session_id = 's'").collect()] == [("s", [5, 6, 7, 8])]
    rows = Stream(spark, tmp_path, n=4, initial=held, by_events=True).run([turn("s", 9), turn("new", 1)], [turn("new", 2, 1)], [turn("new", 3, 2)])
    assert ("old", "expired", []) in rows and ("s", "expired", []) not in rows
    assert sorted((s, [t for t, _, _ in ts]) for s, e, ts in rows if e == "update") == [("new", [1]), ("new", [1, 2]), ("new", [1, 2, 3]), ("s", [6, 7, 8, 9])]


def test_expiry_by_time_of_processing(spark, tmp_path, rocks):
    rows = Stream(spark, tmp_path, n=2, minutes=1 / 60).run([turn("s", 1)], until=lambda rows: ("s", "expired", []) in rows)
    assert [r[:2] for r in rows] == [("s", "update"), ("s", "expired")]


def test_needs_its_state_store(spark, tmp_path):
    with pytest.raises(ValueError):
        sessions.remember(spark.readStream.schema(EVENT).parquet(str(tmp_path)))


@pytest.fixture
def source(spark, tmp_path):
    def put(name, *texts):
        spark.createDataFrame([(t, "s") for t in texts], "text string, source string").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    return put


def ingest(spark, tmp_path):
    stream = spark.readStream.schema("text string, source string").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = sessions.ingest(stream, str(tmp_path / "out"), "c", str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    return Collection(spark, str(tmp_path / "out"), "c")


def test_ingest_takes_each_text_once(spark, tmp_path, source, monkeypatch):
    monkeypatch.setattr(Collection, "_rows", lambda *x: pytest.fail("a batch reads the collection"))
    source("a", "x", "x", "y", None)
    ingest(spark, tmp_path)
    source("b", "x", "z")
    c = ingest(spark, tmp_path)
    monkeypatch.undo()
    assert sorted(r.text for r in c.scan().collect()) == ["x", "y", "z"]
    want = {r.h for r in spark.createDataFrame([("x",), ("y",), ("z",)], "t string").select(T.content_hash(F.col("t")).alias("h")).collect()}
    assert {r.doc_id for r in c.scan().collect()} == want


def test_replayed_batch_changes_nothing(spark, tmp_path, source):
    source("a", "x", "y")
    before = ingest(spark, tmp_path).versions()
    for f in glob.glob(str(tmp_path / "check" / "commits" / "*")) + glob.glob(str(tmp_path / "check" / "commits" / ".*crc")):
        os.remove(f)  # as if the driver had died between the sink and its own log
    c = ingest(spark, tmp_path)
    assert c.scan().count() == 2 and c.versions() == before
