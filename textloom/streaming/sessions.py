"""Session memory and incremental ingest over streams."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, GroupedData, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..functions import text as T
from ..sources.store import Collection

TURN = "turn long, question string, answer string"
TURNS = "session_id string, event string, turns array<struct<turn:long,question:string,answer:string>>"

#: Setting and value without which Spark can't keep such a state.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Memory(StatefulProcessor):
    """A session's last n turns by their numbers, until it has been idle for so many milliseconds."""

    def __init__(self, n: int, idle: int, by_events: bool) -> None:
        self.n, self.idle, self.by_events = n, idle, by_events

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", TURN)
        self.floor = handle.getValueState("floor", "turn long")

    def handleInputRows(self, key: tuple[str], rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        """Turns and resets count in the order of their numbers, whatever order they come in; each batch is one access."""
        held = {t: (t, q, a) for t, q, a in self.turns.get()}
        floor = self.floor.get()[0] if self.floor.exists() else None
        reset, last = False, None
        for r in sorted(rows, key=lambda r: (r.turn is not None, r.turn or 0, r.kind == "reset", r.question or "", r.answer or "")):
            if r.kind == "reset":
                reset = True
                floor = r.turn if floor is None or r.turn is None else max(floor, r.turn)
                held = {} if r.turn is None else {t: h for t, h in held.items() if t is not None and t > r.turn}
            elif r.kind == "turn" and (floor is None or r.turn is not None and r.turn > floor):
                held[r.turn] = (r.turn, r.question, r.answer)
            last = r.at if r.at is not None and (last is None or r.at > last) else last
        kept = sorted(held.values(), key=lambda h: (h[0] is not None, h[0] or 0))[-self.n :] if self.n else []
        if kept:
            self.turns.put(kept)
        else:
            self.turns.clear()
        if floor is not None:
            self.floor.update((floor,))
        self._wake((int(last.timestamp() * 1000) if last else timerValues.getCurrentWatermarkInMs()) if self.by_events else timerValues.getCurrentProcessingTimeInMs())
        yield Row(session_id=key[0], event="reset" if reset else "update", turns=[Row(turn=t, question=q, answer=a) for t, q, a in kept])

    def _wake(self, seen: int) -> None:
        """Moves the end of the session to `idle` after this access; an earlier access changes nothing."""
        timers = list(self.handle.listTimers())
        if all(t < seen + self.idle for t in timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(seen + self.idle)

    def handleExpiredTimer(self, key: tuple[str], timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.turns.clear()
        self.floor.clear()
        yield Row(session_id=key[0], event="expired", turns=[])

    def handleInitialState(self, key: tuple[str], initialState: Row, timerValues: TimerValues) -> None:
        self.turns.put([(t["turn"], t["question"], t["answer"]) for t in initialState.turns[-self.n :]])
        self._wake(int(initialState.at.timestamp() * 1000) if self.by_events else timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def remembered(turns: DataFrame, n: int = 6) -> DataFrame:
    """session_id, turns, at: the last n of a table of turns(session_id, turn, question, answer, at), as `remember` can start from.

    Of turns of one number the last by question and answer stays; blank sessions have none.
    """
    last = turns.where(F.length(F.trim("session_id")) > 0).groupBy("session_id", "turn").agg(F.max(F.struct("turn", "question", "answer")).alias("t"), F.max("at").alias("at"))
    held = last.groupBy("session_id").agg(F.sort_array(F.collect_list("t")).alias("turns"), F.max("at").alias("at"))  # one session's turns
    return held.withColumn("turns", F.slice("turns", F.greatest(F.size("turns") - n + 1, F.lit(1)), F.lit(n)))


def remember(events: DataFrame, n: int = 6, minutes: float = 120, initial: DataFrame | None = None, by_events: bool = False) -> DataFrame:
    """Stream of events(session_id, kind, turn, question, answer[, at]) -> session_id, event, turns after each batch that touches a session.

    `kind` is `turn`, `reset` (drops the turns up to its number, all if that is
    null) or `read`, which only keeps the session awake.  Turns are ordered by
    number, null first, also across batches: a late one takes its place, one of
    a known number replaces it, and one that a reset covers is dropped.  Null
    questions and answers stay null.  A session that is idle for `minutes` ends
    with a row `expired`, by the time of processing or, with `by_events`, by
    `at` and the stream's watermark, before which Spark drops events.  `initial` is a table as of `remembered`.
    Blank session ids are stateless and have no rows.
    """
    spark = events.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        raise ValueError(f"sessions are kept in timers and lists of state: set {PROVIDER} to {ROCKSDB}")
    if "at" not in events.columns:
        if by_events:
            raise ValueError("events need a column `at` with a watermark")
        events = events.withColumn("at", F.lit(None).cast("timestamp"))
    rows = events.where(F.length(F.trim("session_id")) > 0).select("session_id", "kind", F.col("turn").cast("long").alias("turn"), "question", "answer", "at")
    start: GroupedData | None = None if initial is None else initial.select("session_id", "turns", "at").groupBy("session_id")
    memory = Memory(n, int(timedelta(minutes=minutes) / timedelta(milliseconds=1)), by_events)
    return rows.groupBy("session_id").transformWithState(memory, TURNS, "Update", "EventTime" if by_events else "ProcessingTime", start)


def ingest(stream: DataFrame, root: str, name: str, checkpoint: str, within: str = "7 days") -> StreamingQuery:
    """Adds each new text of stream(text, ...) to the collection `name` below `root`, under its content hash as doc_id; returns the running query.

    A text that comes again `within` that time of its first coming is dropped
    from the stream's own state, so no batch reads the collection, however
    large it is; after that time it counts as new.  A batch that is run again,
    after a failure, finds its number in the collection and changes nothing.
    Null texts are left out.
    """
    new = stream.where("text is not null").withColumn("doc_id", T.content_hash(F.col("text"))).withColumn("_came", F.current_timestamp())
    new = new.withWatermark("_came", within).dropDuplicatesWithinWatermark(["doc_id"]).drop("_came")

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        query = spark.read.json(f"{checkpoint}/metadata").first().id  # of the checkpoint: the same after a restart
        held = Collection(spark, root, name)
        now = held.version()
        if now is not None and now.batches.get(query, -1) >= number:
            rows.write.format("noop").mode("overwrite").save()  # the stream's state goes through the batch all the same
        else:
            held.append(rows, "doc_id", query, number)

    return new.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
