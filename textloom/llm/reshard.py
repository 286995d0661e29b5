"""Resharding by minimum-cost flow (operator 8)."""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, written

#: Rows in a block, about: a block is what one task orders.
BLOCK_ROWS = 2_000


class Flow:
    """Minimum-cost flow by successive shortest paths with potentials."""

    def __init__(self) -> None:
        self.out: dict[object, list[int]] = defaultdict(list)
        self.to: list[object] = []
        self.room: list[int] = []
        self.cost: list[float] = []

    def arc(self, a: object, b: object, room: int, cost: float) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def solve(self, source: object, sink: object) -> None:
        height: dict[object, float] = defaultdict(float)
        while True:
            far, back, queue, n = {source: 0.0}, {}, [(0.0, 0, source)], 0
            done = set()
            while queue:
                d, _, a = heapq.heappop(queue)
                if a in done:
                    continue
                done.add(a)
                for e in self.out[a]:
                    b = self.to[e]
                    if self.room[e] > 0 and b not in done:
                        new = d + max(0.0, self.cost[e] + height[a] - height[b])
                        if new < far.get(b, float("inf")):
                            far[b], back[b], n = new, e, n + 1
                            heapq.heappush(queue, (new, n, b))
            if sink not in far:
                return
            for x in far:
                height[x] += far[x]
            for x in list(self.out):
                if x not in far:
                    height[x] += max(far.values())
            path, x = [], sink
            while x != source:
                path.append(back[x])
                x = self.to[back[x] ^ 1]
            size = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= size
                self.room[e ^ 1] += size


def transfers(blocks: list[tuple[int, int, int, int]], capacity: list[int]) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """(old shard, class) -> [(new shard, rows)], the rows' own shard first.

    blocks: (old shard, class, rows, bytes) by class; a row that stays costs
    nothing, one that moves costs the mean bytes of its class.  The flow fills
    every capacity with the fewest moved bytes.
    """
    flow, stays, leaves, enters = Flow(), {}, {}, {}
    for old, kind, rows, size in blocks:
        flow.arc("source", (old, kind), rows, 0)
        if old < len(capacity):
            stays[old, kind] = flow.arc((old, kind), ("new", old), rows, 0)
        leaves[old, kind] = flow.arc((old, kind), "moved", rows, size / rows)
    for new, room in enumerate(capacity):
        enters[new] = flow.arc("moved", ("new", new), sum(capacity), 0)
        flow.arc(("new", new), "sink", room, 0)
    flow.solve("source", "sink")
    into = [[new, flow.room[e ^ 1]] for new, e in enters.items() if flow.room[e ^ 1]]
    plan: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for key, e in sorted(leaves.items()):
        plan[key] = [(key[0], n)] if key in stays and (n := flow.room[stays[key] ^ 1]) else []
        left = flow.room[e ^ 1]
        while left:
            n = min(left, into[-1][1])
            plan[key].append((into[-1][0], n))
            left -= n
            into[-1][1] -= n
            if not into[-1][1]:
                into.pop()
    return plan


def place(docs: DataFrame, old: str, shards: int, key: str = "doc_id") -> DataFrame:
    """key, size, text_crc32, old_shard, shard, slot under the law `rows`.

    docs[old] holds the present shard, 0 and up (null: 0).  A column `row` that
    names each row (see `numbered`) is passed through, for `rewrite`.  Rows are blocked by
    old shard, class of size and a hash of the key.  The driver sees the sums
    of the classes for the flow and one row per block for the ranges; which
    rows of a block move is decided by their rank within it, smallest first.
    Counts end at most one apart.  Repeated and null keys are rows like others.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(key, *(["row"] if "row" in docs.columns else []), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.greatest(F.coalesce(F.col(old).cast("int"), F.lit(0)), F.lit(0)).alias("old_shard"))
    # eight classes of size to each power of two
    power = F.floor(F.log2(F.col("size").cast("double"))).cast("int")
    rows = rows.withColumn("kind", (power * 8 + F.floor((F.col("size") / F.pow(F.lit(2.0), power) - 1) * 8)).cast("int"))
    rows = written(rows, "rows")
    n = rows.count()
    # blocks of about BLOCK_ROWS within each old shard and class, of which there are few
    parts = rows.groupBy("old_shard", "kind").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    rows = rows.join(F.broadcast(parts), ["old_shard", "kind"]).withColumn("part", F.pmod(F.xxhash64(key, "size"), F.col("parts")).cast("int"))
    block = ["old_shard", "kind", "part"]
    blocks = written(rows.groupBy(*block).agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")), "blocks")
    classes = [tuple(r) for r in blocks.groupBy("old_shard", "kind").agg(F.sum("rows"), F.sum("bytes")).orderBy("old_shard", "kind").collect()]  # old shards x 8 classes a power of two
    capacity = [n // shards + (i < n % shards) for i in range(shards)]
    plan = transfers(classes, capacity)
    targets, at = [], defaultdict(int)
    for (shard, kind), to in plan.items():
        low = 0
        for new, count in to:
            targets.append((shard, kind, low, low + count, new, at[new]))
            low, at[new] = low + count, at[new] + count
    goes = spark.createDataFrame(targets, "old_shard int, kind int, low long, high long, shard int, base long")
    # where each block lies among the rows of its class
    above = Window.partitionBy("old_shard", "kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("begin", F.coalesce(F.sum("rows").over(above), F.lit(0)))
    ranges = blocks.join(F.broadcast(goes), ["old_shard", "kind"]).where("begin < high and begin + rows > low")  # classes x targets rows at most
    ranges = ranges.select(*block, "begin", "low", "high", "shard", "base")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*block).orderBy("size", key, "text_crc32")) - 1)
    found = ranked.join(ranges, block).withColumn("where", F.col("begin") + F.col("rank")).where("where >= low and where < high")
    return found.select(key, *(["row"] if "row" in docs.columns else []), "size", "text_crc32", "old_shard", "shard", (F.col("base") + F.col("where") - F.col("low")).alias("slot"))


def numbered(docs: DataFrame) -> DataFrame:
    """`docs` with `row`, a number of each row, as a table, so that the numbers stay."""
    return written(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")


def rewrite(docs: DataFrame, placed: DataFrame, path: str) -> DataFrame:
    """Writes the shards that lose or gain rows, one folder each, and returns their rows with `shard` and `slot`.

    Both tables have the `row` of `numbered`, so repeated and null keys keep
    all their rows.  Shards that no transfer touches keep their files.
    """
    touched = placed.where("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
    moved = placed.join(touched, "shard", "left_semi").select("row", "shard", "slot")
    out = docs.drop("shard", "slot").join(moved, "row").drop("row")
    out.repartition("shard", F.pmod(F.col("slot"), F.lit(16))).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def op8_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("old_shard", F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(24)).cast("int"))
    placed = place(docs, "old_shard", 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard")
