"""Recursive chunking and greedy near-duplicate removal."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import written

#: Separators from coarse to fine; the last cuts anywhere.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", ". ", "! ", "? ", "; ", "，", "、", ", ", " ", "")


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Stripped chunks of at most `size` characters where a separator allows it; separators start the following piece."""
    at = next(i for i, s in enumerate(separators) if not s or s in text)
    sep, finer = separators[at], separators[at + 1 :]
    if sep:
        head, *rest = text.split(sep)
        parts = [p for p in (head, *(sep + r for r in rest)) if p]
    else:
        parts = list(text)
    out: list[str] = []
    held: list[str] = []
    length = 0

    def flush() -> None:
        if chunk := "".join(held).strip():
            out.append(chunk)

    for part in parts:
        if len(part) >= size and finer:
            flush()
            held, length = [], 0
            out += split_text(part, size, overlap, finer)
            continue
        if held and length + len(part) > size:
            flush()
            while held and (length > overlap or length + len(part) > size):
                length -= len(held.pop(0))
        held.append(part)
        length += len(part)
    flush()
    return out


def recursive_chunks(docs: DataFrame, size: int = 500, overlap: int = 80, key: str = "doc_id") -> DataFrame:
    """doc_id, chunk_index, start_index, text of each whole text; null and blank texts have none."""
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch[key], batch["text"], strict=True):
                at = 0
                for i, chunk in enumerate(split_text(text, size, overlap)):
                    at = text.find(chunk, max(0, at))
                    rows.append((doc, i, at, chunk))
                    at += len(chunk) - overlap
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "start_index", "text"])

    return docs.where(F.length(T.strip(F.col("text"))) > 0).select(key, "text").mapInPandas(run, f"doc_id {kind}, chunk_index long, start_index long, text string")


#: Chunks of a document up to which one task decides on them, and rounds in which the rest is compared with sure ones alone.
ONE_TASK, LEADS = 5_000, 3


def drop_near_chunks(chunks: DataFrame, most: float = 0.9) -> DataFrame:
    """Greedy removal within each document: a chunk stays if no kept one before it has a Jaccard over `most`.

    Chunks without tokens always stay; chunk_index is unique in a document.
    A document of more than ONE_TASK chunks is decided by `spread_greedy`.
    """
    chunks = written(chunks, "chunks")
    large = chunks.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > ONE_TASK).select(F.col("doc_id").alias("large"))
    is_large = F.col("doc_id").eqNullSafe(F.col("large"))
    if large.isEmpty():
        return _greedy_by_document(chunks, most)
    large = written(large, "large")
    rest = chunks.join(large, is_large, "left_anti")
    return _greedy_by_document(rest, most).unionByName(spread_greedy(chunks.join(large, is_large, "left_semi"), most))


def _greedy_by_document(chunks: DataFrame, most: float) -> DataFrame:
    """Candidates share their first rare token, so a kept chunk is compared with few others."""
    types = dict(chunks.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk_index")
        sets = [frozenset(t) for t in rows["tokens"]]
        count: dict[str, int] = {}
        for s in sets:
            for t in s:
                count[t] = count.get(t, 0) + 1
        by: dict[str, list[int]] = {}
        keep = []
        for i, s in enumerate(sets):
            order = sorted(s, key=lambda t: (count[t], t))
            prefix = order[: len(s) - int(-(-most * len(s) // 1)) + 1]  # sets this similar share a token of their prefixes
            near = {j for t in prefix for j in by.get(t, ())}
            if any(len(s & sets[j]) > most * len(s | sets[j]) for j in near):
                keep.append(False)
                continue
            keep.append(True)
            for t in prefix:
                by.setdefault(t, []).append(i)
        return rows[keep].drop(columns="tokens")

    schema = ", ".join(f"`{c}` {t}" for c, t in types.items())
    return chunks.withColumn("tokens", F.array_distinct(T.tokens(F.col("text")))).groupBy("doc_id").applyInPandas(run, schema)


def spread_greedy(chunks: DataFrame, most: float = 0.9) -> DataFrame:
    """`drop_near_chunks` with one document's chunks over many tasks.

    Of chunks with equal tokens only the first can stay.  Two chunks this
    similar share one of their rarest tokens (a prefix).  A chunk that comes
    first among all that share one of its prefix tokens surely stays, and is
    compared with those; after LEADS rounds of this, what is undecided is
    compared in pairs, and a chunk whose similar predecessors are decided is
    decided, round by round.
    """
    doc = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")).alias("doc")
    tokens = F.array_sort(F.array_distinct(T.tokens(F.col("text"))))
    whole = written(chunks.select(doc, F.col("chunk_index").alias("at"), tokens.alias("set")), "sets")
    first = whole.where(F.size("set") > 0).groupBy("doc", "set").agg(F.min("at").alias("at")).withColumn("n", F.size("set"))
    each = first.select("doc", "at", "n", F.explode("set").alias("token"))
    counted = each.join(each.groupBy("doc", "token").agg(F.count("*").alias("df")), ["doc", "token"])
    ordered = counted.groupBy("doc", "at", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token")))["token"].alias("set"))  # one chunk's tokens
    sets = written(ordered, "sets")
    prefix = F.slice("set", F.lit(1), (F.col("n") - F.ceil(F.lit(most) * F.col("n")) + 1).cast("int"))
    prefixes = written(sets.select("doc", "at", "n", F.explode(prefix).alias("token")), "prefixes")

    def similar(pairs: DataFrame) -> DataFrame:
        """Those of pairs(doc, a, b) over `most`."""
        side = lambda c: sets.select("doc", F.col("at").alias(c), F.col("set").alias(f"{c}_set"))
        both = F.size(F.array_intersect("a_set", "b_set"))
        return pairs.join(side("a"), ["doc", "a"]).join(side("b"), ["doc", "b"]).where(both > most * (F.size("a_set") + F.size("b_set") - both)).select("doc", "a", "b")

    alike_sizes = F.least("n", "m") > most * F.greatest("n", "m")
    kept, left = [], prefixes
    for _ in range(LEADS):
        leads = left.groupBy("doc", "token").agg(F.min(F.struct("at", "n")).alias("lead"))
        met = written(left.join(leads, ["doc", "token"]).select("doc", "token", "at", "n", F.col("lead.at").alias("a"), F.col("lead.n").alias("m")), "met")
        sure = written(met.groupBy("doc", "at").agg(F.min("a").alias("a")).where("a = at").select("doc", "at"), "sure")
        near = met.where((F.col("a") < F.col("at")) & alike_sizes).join(sure.withColumnRenamed("at", "a"), ["doc", "a"], "left_semi")
        gone = similar(near.select("doc", "a", F.col("at").alias("b")).distinct()).select("doc", F.col("b").alias("at"))
        kept.append(sure)
        left = written(met.select("doc", "token", "at", "n").join(gone.union(sure).distinct(), ["doc", "at"], "left_anti"), "left")
    other = left.select("doc", "token", F.col("at").alias("a"), F.col("n").alias("m"))
    pairs = left.join(other, ["doc", "token"]).where((F.col("a") < F.col("at")) & alike_sizes)
    links = written(similar(pairs.select("doc", "a", F.col("at").alias("b")).distinct()), "links")
    open_ = written(left.select("doc", "at").distinct(), "open")
    while not open_.isEmpty():
        waiting = links.join(open_.withColumnRenamed("at", "a"), ["doc", "a"], "left_semi").select("doc", F.col("b").alias("at")).distinct()
        sure = written(open_.join(waiting, ["doc", "at"], "left_anti"), "sure")
        gone = links.join(sure.withColumnRenamed("at", "a"), ["doc", "a"], "left_semi").select("doc", F.col("b").alias("at"))
        kept.append(sure)
        open_ = written(open_.join(gone.union(sure).distinct(), ["doc", "at"], "left_anti"), "open")
    stay = reduce(DataFrame.union, kept).union(whole.where(F.size("set") == 0).select("doc", "at"))
    return chunks.withColumn("doc", doc).join(stay.withColumnRenamed("at", "chunk_index"), ["doc", "chunk_index"], "left_semi").select(*chunks.columns)
