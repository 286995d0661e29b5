"""BM25 over posting lists in blocks with upper bounds, kept fresh by signed deltas.

A segment holds documents in blocks of BLOCK_DOCS of about one length, and for
each token and block one row of postings with the largest count and the smallest
length in it, from which a bound on any score follows, whatever the mean length
is by then.  A search scores the blocks of highest bound first; blocks whose
bound is below the k-th score so found are never read.  Adding documents writes
a segment, deleting them writes their ids and what they take from the counts;
both only read the documents concerned, and `compact` makes one segment again.
"""

from __future__ import annotations

import functools
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import TRIES, Log
from ..sources.tables import counted, written
from .order import ranked
from .search import B, EPSILON, K1, Index, index, query_terms, sent, top

#: Documents of a block; folders that tokens are dealt to by hash; blocks whose scores give the first bound.
BLOCK_DOCS, FOLDERS, FIRST = 16, 32, 16
#: Scores are rounded to 9 digits, and equal ones ordered by id, so that a block's bound has to be below by more than that.
SLACK = 2e-9


@dataclass(frozen=True)
class Segment:
    """A folder of documents, or of deletions in all segments before it; `n` and `length` are signed sums over its documents."""

    folder: str
    deletes: bool
    n: int
    length: int


def impact(tf: Column, dl: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


class Postings(Log):
    """The index of documents (id, text) below a folder; ids are unique and of one type, null ids have no rows."""

    def segments(self, number: int | None = None) -> list[Segment]:
        """Those of a version, the newest by default, in the order in which they came."""
        numbers = self.versions()
        return [Segment(**s) for s in json.loads(self.text(number or numbers[-1]))] if numbers else []

    def _kind(self, of: Segment) -> str:
        return self.spark.read.parquet(f"{self.path}/data/{of.folder}/{'gone' if of.deletes else 'rows'}").schema["id"].dataType.simpleString()

    def _table(self, name: str, schema: str, segments: list[Segment]) -> DataFrame:
        """A table of the segments together, with the place `seg` of each."""
        tables = [self.spark.read.schema(schema).parquet(f"{self.path}/data/{s.folder}/{name}").withColumn("seg", F.lit(i)) for i, s in enumerate(segments) if s.deletes == (name == "gone") or name == "terms"]
        return functools.reduce(DataFrame.unionByName, tables) if tables else self.spark.createDataFrame([], T.StructType([*self.spark.createDataFrame([], schema).schema, T.StructField("seg", T.IntegerType())]))

    def _alive(self, rows: DataFrame, segments: list[Segment], kind: str) -> DataFrame:
        """rows(id, seg, ...) without those that a later segment deletes."""
        if not any(s.deletes for s in segments):
            return rows
        gone = self._table("gone", f"id {kind}", segments).groupBy("id").agg(F.max("seg").alias("until"))
        return rows.join(gone, "id", "left").where(F.col("until").isNull() | (F.col("seg") > F.col("until"))).drop("until")

    def _rows(self, segments: list[Segment], kind: str) -> DataFrame:
        return self._alive(self._table("rows", f"id {kind}, dl long, block long, tokens array<string>, tfs array<long>", segments), segments, kind)

    def _commit(self, change) -> None:
        """Publishes the segments that change(those held) returns; again from the start if another writer was faster."""
        for _ in range(TRIES):
            numbers = self.versions()
            held = self.segments(numbers[-1]) if numbers else []
            new = change(held)
            if new == held and numbers or self.publish((numbers or [0])[-1] + 1, uuid.uuid4().hex, json.dumps([vars(s) for s in new])):
                return
        raise RuntimeError(f"other writers have published {TRIES} versions meanwhile")

    def _segment(self, rows: DataFrame) -> Segment:
        """Writes rows(id, dl, tokens, tfs) as a segment."""
        folder = uuid.uuid4().hex
        path = f"{self.path}/data/{folder}"
        placed = ranked(rows.select("id", "dl", "tokens", "tfs"), [], [F.asc("dl"), F.asc("id")])
        placed.select("id", F.col("dl").cast("long").alias("dl"), F.floor(F.col("position") / BLOCK_DOCS).cast("long").alias("block"), "tokens", "tfs").write.parquet(f"{path}/rows")
        held = self.spark.read.parquet(f"{path}/rows")
        each = held.select("id", "dl", "block", F.explode(F.arrays_zip("tokens", "tfs")).alias("t")).select("id", "dl", "block", "t.tokens", "t.tfs")
        of = lambda c: F.col(f"p.{c}").alias(f"{c}s")
        # a block's postings of a token are BLOCK_DOCS at most
        lists = each.groupBy(F.col("tokens").alias("token"), "block").agg(F.count("*").alias("n"), F.max("tfs").alias("max_tf"), F.min("dl").alias("min_dl"), F.collect_list(F.struct("id", F.col("tfs").alias("tf"), "dl")).alias("p"))
        lists = lists.select("token", "block", "n", "max_tf", "min_dl", of("id"), of("tf"), of("dl"), F.pmod(F.xxhash64("token"), F.lit(FOLDERS)).cast("int").alias("folder"))
        lists.hint("rebalance", "folder").sortWithinPartitions("folder", "token", "block").write.partitionBy("folder").parquet(f"{path}/blocks")
        self._blocks_of(folder).groupBy("token").agg(F.sum("n").alias("df")).write.parquet(f"{path}/terms")
        total = held.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
        return Segment(folder, False, total.n, total.length)

    def _blocks_of(self, folder: str) -> DataFrame:
        return self.spark.read.schema("token string, n long").parquet(f"{self.path}/data/{folder}/blocks")

    def _deletion(self, rows: DataFrame) -> Segment | None:
        """Writes the deletion of live rows(id, dl, tokens); None if there are none."""
        rows = written(rows.select("id", "dl", "tokens"), "deletion")
        total = rows.agg(F.count("*").alias("n"), F.sum("dl").alias("length")).first()
        if not total.n:
            return None
        folder = uuid.uuid4().hex
        rows.select("id").write.parquet(f"{self.path}/data/{folder}/gone")
        rows.select(F.explode("tokens").alias("token")).groupBy("token").agg((-F.count("*")).alias("df")).write.parquet(f"{self.path}/data/{folder}/terms")
        return Segment(folder, True, -total.n, -total.length)

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Adds documents; those whose ids are there already are replaced.  Null ids are left out."""
        docs = docs.where(F.col(key).isNotNull())
        new = self._segment(index(docs, key, text).rows)

        def change(held: list[Segment]) -> list[Segment]:
            old = None
            if held:
                kind = self._kind(held[0])
                ids = self.spark.read.parquet(f"{self.path}/data/{new.folder}/rows").select("id")
                old = self._deletion(self._rows(held, kind).join(ids, "id", "left_semi"))
            return [*held, *([old] if old else []), new]

        self._commit(change)

    def delete(self, ids: DataFrame, key: str = "doc_id") -> int:
        """Deletes documents; how many there were."""
        removed = []

        def change(held: list[Segment]) -> list[Segment]:
            old = self._deletion(self._rows(held, self._kind(held[0])).join(ids.select(F.col(key).alias("id")).distinct(), "id", "left_semi")) if held else None
            removed.append(-old.n if old else 0)
            return [*held, *([old] if old else [])]

        self._commit(change)
        return removed[-1]

    def compact(self) -> None:
        """Writes what is alive as one segment."""
        self._commit(lambda held: [self._segment(self._rows(held, self._kind(held[0])))] if len(held) > 1 else held)

    def statistics(self) -> tuple[DataFrame, int, float]:
        """terms(token, df, idf), the number of documents and their mean length, from the signed sums of all segments."""
        held = self.segments()
        n, length = sum(s.n for s in held), sum(s.length for s in held)
        df = self._table("terms", "token string, df long", held).groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")
        raw = df.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        mean = raw.agg((EPSILON * F.avg("raw")).alias("floor"))
        return raw.crossJoin(F.broadcast(mean)).select("token", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf")), n, length / n if n else 1.0  # one row

    def live(self) -> Index:
        """The index of what is alive in the form that `search.bm25` takes."""
        held = self.segments()
        terms, n, mean = self.statistics()
        return Index(self._rows(held, self._kind(held[0])), terms, self.spark.createDataFrame([(n, mean)], "n long, avgdl double"))

    def search(self, questions: DataFrame, k: int = 20) -> Found:
        """At most k documents of positive score for each of questions(query_id, text), as `search.bm25` finds them."""
        held = self.segments()
        kinds = questions.schema["query_id"].dataType.simpleString(), self._kind(held[0]) if held else "long"
        terms, _, average = self.statistics()
        mean = F.lit(average)
        asked, pairs = counted(query_terms(questions).join(terms, "token").select("query_id", "token", (F.col("qtf") * F.col("idf")).alias("w")), "asked")
        folders = [r.folder for r in asked.select(F.pmod(F.xxhash64("token"), F.lit(FOLDERS)).cast("int").alias("folder")).distinct().collect()]  # FOLDERS numbers at most
        lists = self._table("blocks", f"token string, block long, n long, max_tf long, min_dl long, ids array<{kinds[1]}>, tfs array<long>, dls array<long>, folder int", held).where(F.col("folder").isin(folders))
        # the bounds of the asked tokens' blocks; the lists themselves are other columns, which this doesn't read
        each = lists.select("token", "seg", "block", "n", "max_tf", "min_dl").join(sent(asked, pairs), "token")
        bound = F.greatest(F.col("w"), F.lit(0.0)) * impact(F.col("max_tf"), F.col("min_dl"), mean)
        bounds = written(each.groupBy("query_id", "seg", "block").agg(F.sum(bound).alias("bound"), F.sum("n").alias("n")).where("bound > 0"), "bounds")

        def scores(chosen: DataFrame) -> DataFrame:
            """query_id, id, score of the documents of chosen(query_id, seg, block)."""
            wanted = chosen.select("query_id", "seg", "block").join(sent(asked, pairs), "query_id")
            found = lists.select("token", "seg", "block", "ids", "tfs", "dls").join(wanted, ["token", "seg", "block"])
            rows = found.select("query_id", "seg", "w", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p")).select("query_id", "seg", F.col("p.ids").alias("id"), (F.col("w") * impact(F.col("p.tfs"), F.col("p.dls"), mean)).alias("s"))
            summed = rows.groupBy("query_id", "seg", "id").agg(F.sum("s").alias("score")).where("score > 0")
            return self._alive(summed, held, kinds[1]).select("query_id", "id", "score")

        best = top(bounds.withColumn("place", F.struct("seg", "block")), "query_id", "bound", "place", FIRST, "at").select("query_id", "seg", "block")
        first = written(top(scores(written(best, "best")), "query_id", "score", "id", k), "first")
        least = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(0.0).alias("least"))
        left = bounds.join(least, "query_id", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - SLACK)
        read = written(left.select("query_id", "seg", "block", "n"), "read")
        hits = top(scores(read), "query_id", "score", "id", k)
        return Found(hits, bounds.agg(F.sum("n").alias("postings")).crossJoin(read.agg(F.sum("n").alias("scored"))))  # one row each


@dataclass
class Found:
    """hits(query_id, id, score, rank), and one row of how many (question, posting) pairs there are and how many were scored for the result."""

    hits: DataFrame
    read: DataFrame
