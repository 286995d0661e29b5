"""Chunks, collections, sessions and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import store


def windows(docs: DataFrame, size: int = 500, overlap: int = 80, key: str = "doc_id") -> DataFrame:
    """doc_id, chunk_index, start_index, text, chunk_id: windows of `size` characters every size - overlap."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    n = F.length("text")
    last = F.greatest(F.ceil((n - overlap) / step), F.lit(1)) - 1
    rows = docs.where(n > 0).select(F.col(key).alias("doc_id"), "text", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("chunk_index"))
    rows = rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), (F.col("chunk_index") * step).cast("long").alias("start_index"), F.substr("text", F.col("chunk_index") * step + 1, F.lit(size)).alias("text"))
    return rows.withColumn("chunk_id", T.content_hash(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"), "text")))


def pages_of(units: DataFrame) -> DataFrame:
    """doc_id, page, begin, end: where each unit lies among its document's units, joined by two characters."""
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    rows = units.where(T.strip(F.col("text")) != "").withColumn("n", F.length(T.strip(F.col("text"))))
    return rows.withColumn("begin", F.coalesce(F.sum(F.col("n") + 2).over(before), F.lit(0))).select("doc_id", "page", "begin", (F.col("begin") + F.col("n")).alias("end"))


def page_lookup(offsets: DataFrame, pages: DataFrame) -> DataFrame:
    """offsets(doc_id, at, ...) with the page that holds `at`; in no page the last one, without pages 1.

    The last page that begins at or before `at` comes from one sort of offsets
    and pages together, not from pairs of them.
    """
    last = pages.groupBy("doc_id").agg(F.max_by("page", "begin").alias("last"))
    begins = pages.select("doc_id", F.col("begin").alias("at"), F.struct("page", "end").alias("p"), F.lit(0).alias("kind"))
    rows = offsets.withColumn("kind", F.lit(1)).unionByName(begins, allowMissingColumns=True)
    by = Window.partitionBy("doc_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("p", F.last("p", ignorenulls=True).over(by)).where("kind = 1").join(last, "doc_id", "left")
    return rows.select(*offsets.columns, F.coalesce(F.when(F.col("at") < F.col("p.end"), F.col("p.page")), "last", F.lit(1)).alias("page"))


def exact_dedup(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The smallest id of each distinct text and how many copies it has."""
    return docs.groupBy(T.content_hash(F.col("text")).alias("hash"), F.sha2("text", 256).alias("full")).agg(F.min(key).alias(key), F.count("*").alias("copies")).select("hash", key, "copies")


def listing(chunks: DataFrame, by: str = "doc_id") -> DataFrame:
    """Per document: chunks, and the source of its first chunk; by source, documents without one first."""
    rows = chunks.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("unknown")).alias("doc_id")).agg(F.count("*").alias("chunks"), F.min_by("source", "chunk_index").alias("source"))
    return rows.orderBy("source", "doc_id")


def summary(rows: DataFrame, kind: str = "source") -> DataFrame:
    """Chunks and documents of every kind, and of all in the row of a null kind."""
    return rows.rollup(kind).agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new` replace those of `old` with the same key; of repeated keys in `new` the last by `version` stays, null versions being the first.

    A null key is a key like others.
    """
    order = F.struct(F.col("version").isNotNull(), F.col("version"))  # max_by passes over null orders, but not over structs with nulls
    last = new.groupBy(key).agg(F.max_by(F.struct(*[c for c in new.columns if c != key]), order).alias("r")).select(key, "r.*")
    return old.join(new.select(F.col(key).alias("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_anti").unionByName(last)


def delete(old: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return old.join(ids, key, "left_anti")


def removed(old: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: how many rows `delete` takes away, and of how many ids."""
    return old.join(ids, key, "left_semi").agg(F.count("*").alias("rows"), F.countDistinct(key).alias("ids"))


def new_only(docs: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """Skip-existing: the documents that the collection doesn't have."""
    return docs.join(known.select(key), key, "left_anti")


def last_turns(turns: DataFrame, n: int = 6) -> DataFrame:
    """The most recent n turns of every conversation."""
    by = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("back", F.row_number().over(by)).where(F.col("back") <= n)


def exchanges(turns: DataFrame) -> DataFrame:
    """conv_id, turn, question, answer of turns(conv_id, turn, role, text): each user turn with what the assistant says before the next one, '' for nothing."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    asks = F.col("role") == "user"
    rows = turns.withColumn("no", F.sum(asks.cast("int")).over(by)).where("no > 0")
    said = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("turn", "text")))), lambda r: r["text"]), "\n")
    return rows.groupBy("conv_id", "no").agg(F.min("turn").alias("turn"), said(asks).alias("question"), said(F.col("role") == "assistant").alias("answer")).drop("no")


def history(pairs: DataFrame, n: int = 6, most: int = 200) -> DataFrame:
    """The last n of pairs(conv_id, turn, question, answer) of every conversation as one text, long answers cut; null answers stand for no exchange."""
    cut = F.when(F.length("answer") > most, F.concat(F.left("answer", F.lit(most)), F.lit("…"))).otherwise(F.col("answer"))
    line = F.concat(F.lit("用户："), F.coalesce("question", F.lit("")), F.lit("\n助手："), cut)
    rows = last_turns(pairs, n).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("answer").isNotNull(), F.struct("turn", line.alias("line"))))).alias("l"))
    return rows.select("conv_id", F.when(F.size("l") > 0, F.array_join(F.col("l.line"), "\n")).otherwise(F.lit(T.NO_HISTORY)).alias("history"))


def ttl_sessions(events: DataFrame, minutes: int = 120) -> DataFrame:
    """Sessions of a user: a gap of more than `minutes` starts a new one."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.col("ts") - F.lag("ts").over(by) <= F.expr(f"interval {minutes} minutes"), 0).otherwise(1)
    rows = events.withColumn("new", new).withColumn("session", F.sum("new").over(by))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("begin"), F.max("ts").alias("end"))


def chunk_stats(chunks: DataFrame, size: int = 500) -> DataFrame:
    """Chunks, characters, their integer mean and advice per source and in total: `small` below half of `size`, `large` above 1.1 times it, else `fine`."""
    n = F.length("text")
    rows = chunks.rollup("source").agg(F.count("*").alias("chunks"), F.sum(n).alias("chars"), F.floor(F.sum(n) / F.count("*")).alias("mean_chars"))
    return rows.withColumn("advice", F.when(F.col("mean_chars") < size * 0.5, "small").when(F.col("mean_chars") > size * 1.1, "large").otherwise("fine"))


def where_equal(**values) -> Column:
    """Metadata equality filter."""
    out = F.lit(True)
    for name, value in values.items():
        out = out & (F.col(name) == F.lit(value))
    return out


def context(blocks: DataFrame) -> DataFrame:
    """query_id, context: the question's blocks(query_id, block, source, page, text), numbered, with source and page where there are any."""
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit(" | 第 "), F.col("page").cast("string"), F.lit(" 页"))).otherwise(F.lit(""))
    line = F.concat(F.lit("["), F.col("block").cast("string"), F.lit("] 来源："), F.coalesce("source", F.lit("未知来源")), page, F.lit("\n"), T.strip(F.coalesce("text", F.lit(""))))
    rows = blocks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("block", line.alias("line")))).alias("rows"))  # top k blocks
    return rows.select("query_id", F.array_join(F.col("rows.line"), "\n\n").alias("context"))


def session_stats(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Sessions and turns in all; blank and null sessions are stateless and don't count."""
    return turns.where(F.length(F.trim(F.col(key).cast("string"))) > 0).agg(F.countDistinct(key).alias("sessions"), F.count("*").alias("turns"))


def ingest_totals(units: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row for units(doc_id, text, error) and their chunks: documents, failed units, characters, chunks."""
    good = F.col("error").isNull()
    read = units.agg(F.countDistinct(F.when(good, F.col("doc_id"))).alias("documents"), F.count(F.when(~good, 1)).alias("failed"), F.coalesce(F.sum(F.when(good, F.length("text"))), F.lit(0)).alias("chars"))
    return read.crossJoin(F.broadcast(chunks.agg(F.count("*").alias("chunks"))))  # one row each


#: How an invalid rewrite of a question starts.
STOCK = ("改写", "好的", "根据")


def rewritten_or(question: Column, rewritten: Column) -> Column:
    """The rewritten question if it has 2 to 200 characters and no stock start, else the question."""
    t = T.strip(F.coalesce(rewritten, F.lit("")))
    bad = ~F.length(t).between(2, 200)
    for start in STOCK:
        bad = bad | F.startswith(t, F.lit(start))
    return F.when(bad, question).otherwise(t)


def write(rows: DataFrame, root: str, name: str, key: str = "chunk_id", version: str | None = None) -> None:
    """Upserts rows into the collection `name` below `root` as a new version; see `Collection.upsert`."""
    store.Collection(rows.sparkSession, root, name).upsert(rows, key, version)


def versions(spark, root: str, name: str) -> list[int]:
    """The versions of a collection, old to new; none for a collection that doesn't exist."""
    return store.Collection(spark, root, name).versions()


def collections(spark, root: str) -> list[str]:
    """Names of the collections below `root`, sorted."""
    return store.names(spark, root)


def drop(spark, root: str, name: str) -> bool:
    """Removes a collection with all its versions; whether there was one."""
    return store.Collection(spark, root, name).drop()


def scan(spark, root: str, name: str, limit: int | None = None) -> DataFrame | None:
    """The newest version of a collection, or None without one."""
    rows = store.Collection(spark, root, name).scan()
    return rows if rows is None or limit is None else rows.limit(limit)
