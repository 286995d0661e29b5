"""Units to numbered chunks as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import collections as M


def chunks_of(units: DataFrame, size: int = 500, overlap: int = 80, near: float | None = None) -> DataFrame:
    """doc_id, chunk_index, page, source, text, chunk_id for units(doc_id, page, text, source).

    A document's units are joined by blank lines and split; chunks are cleaned,
    noise goes, with `near` also chunks that similar to an earlier one of the
    document; what is left is numbered from 0.
    """
    solid = units.select("doc_id", "page", T.strip(F.col("text")).alias("text"), "source").where("text <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    whole = solid.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "\n\n").alias("text"), F.min_by("source", "page").alias("source"))
    cut = C.recursive_chunks(whole, size, overlap).select("doc_id", "chunk_index", F.col("start_index").alias("at"), "text")
    rows = M.page_lookup(cut, M.pages_of(solid)).drop("at").withColumn("text", T.normalize(F.col("text"))).where(~T.is_noise(F.col("text")))
    if near is not None:
        rows = C.drop_near_chunks(rows, near)
    by = Window.partitionBy("doc_id").orderBy("chunk_index")
    rows = rows.withColumn("chunk_index", (F.row_number().over(by) - 1).cast("long")).join(whole.select("doc_id", "source"), "doc_id")
    return rows.select("doc_id", "chunk_index", "page", "source", "text", T.content_hash(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"), "text")).alias("chunk_id"))


#: Why a document that was read has nothing to store.
NO_CHUNKS = "no chunks"


def failures(units: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, source, error: the units(doc_id, source, error) that could not be read, and documents of which no chunk is left."""
    bad = units.where("error is not null").select("doc_id", "source", "error")
    read = units.where("error is null").groupBy("doc_id").agg(F.min("source").alias("source"))
    return bad.unionByName(read.join(chunks.select("doc_id"), "doc_id", "left_anti").withColumn("error", F.lit(NO_CHUNKS)))
