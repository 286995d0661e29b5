"""Removal of repeated passages with suffix automata of reference shards (operator 1).

A window is `window` consecutive words of one document; a word goes if some
window over it also stands in a document with a smaller doc_id.

Only passages that several documents may share reach an automaton.  Each window
has one anchor: the leftmost smallest hash of its `gram`-word pieces, which
every copy of the window has at the same place.  The windows that share one
anchor's place form a segment.  A segment that is equal, word for word, to one
of a smaller doc_id goes whole; of the others one of each kind, kept with its
smallest doc_id, is a reference.  References with the same anchor lie in the
same shard, of about SHARD_TOTAL references; its automaton keeps the smallest owner of every
state, the references are streamed through it, and the matching statistics give
each window's owner.  The shards grow with the corpus, so they are dealt to
tasks by anchor rather than broadcast.  An anchor with very many references is
dealt to several shards, whose window owners are then compared by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .common import map_pieces, pieces, range_hashes, read, signed, word_hashes, words, written

#: References in a shard, at most about; an anchor with more is dealt to several shards.
SHARD_SEGMENTS = 400
#: References in a shard of several anchors, about; their number grows with the references.
SHARD_TOTAL = 4_000


def _segments(hashes: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """anchor hash, segment hash, document, first window (from the document's start) and windows of each segment."""
    n = len(hashes) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    pieces_at = np.arange(len(hashes) - gram + 1)
    grams = range_hashes(hashes, pieces_at, pieces_at + gram)
    width = window - gram + 1
    # leftmost smallest gram of each window, by doubling
    least, place, size = grams, np.arange(len(grams), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        left, right = least[:-step], least[step:]
        take = right < left
        least, place = np.where(take, right, left), np.where(take, place[step:], place[:-step])
        size += step
    windows = np.arange(n)
    doc = np.searchsorted(first, windows, "right") - 1
    good = windows + window <= first[doc + 1]
    windows, doc, place = windows[good], doc[good], place[:n][good]
    if not len(windows):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    new = np.ones(len(windows), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(windows)))
    start, doc = windows[begin], doc[begin]
    return grams[place[begin]], range_hashes(hashes, start, start + count + window - 1), doc, start - first[doc], count


def _word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    starts, ends, first = words(data, offs)
    return word_hashes(data, starts, ends), starts, ends, first


def removals(docs: DataFrame, window: int = 50, gram: int = 14, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """doc_id, fp, spans: for each document with something to remove, array<struct<start, size>> of words."""

    def segments(rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
        hashes, _, _, first = _word_hashes(data, offs)
        anchor, segment, doc, start, count = _segments(hashes, first, window, gram)
        at = pa.array(doc)
        return pa.record_batch([rows.column("doc_id").take(at), rows.column("fp").take(at), pa.array(signed(anchor)), pa.array(signed(segment)), pa.array(start * 64 + count)], names=["doc_id", "fp", "anchor", "segment", "place"])

    found = map_pieces(docs.where("doc_id is not null"), segments, "doc_id long, fp long, anchor long, segment long, place long")
    # written, so that AQE can split the joins where an anchor is hot
    counts = written(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    shared = written(found.join(counts, "anchor"), "segments")
    kinds = shared.groupBy("anchor", "segment").agg(F.min(F.struct("doc_id", "fp", "place")).alias("r")).select("anchor", "segment", "r.*")
    kinds = written(kinds, "kinds")
    many = written(kinds.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "many")
    # copies of a segment with a smaller doc_id go whole
    least = kinds.select("anchor", "segment", F.col("doc_id").alias("owner"), F.col("fp").alias("first_fp"), F.col("place").alias("first_place"))
    judge = shared.join(least, ["anchor", "segment"])
    # more places in the owner itself, which fare as the first of them
    again = judge.where("owner = doc_id and (fp <> first_fp or place <> first_place)").select("doc_id", "fp", "place", "first_fp", "first_place").distinct()  # repeated rows once
    whole = judge.where("owner < doc_id").select("doc_id", "fp", F.shiftright("place", 6).alias("start"), (F.col("place").bitwiseAND(F.lit(63)) + window - 1).alias("size"))
    # one of each kind: its words
    wanted = kinds.join(many, "anchor").select("doc_id", "fp", F.struct("place", "anchor", "n").alias("s"))
    wanted = wanted.groupBy("doc_id", "fp").agg(F.collect_list("s").alias("s"))  # as many as one document has

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in pieces(batches):
            hashes, _, _, first = _word_hashes(data, offs)
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, fp, at, asked in zip(rows.column("doc_id").to_pylist(), rows.column("fp").to_pylist(), first[:-1].tolist(), rows.column("s").to_pylist(), strict=True):
                for s in asked:
                    begin, count = s["place"] >> 6, s["place"] & 63
                    for column, value in zip(out, (doc, fp, s["place"], s["anchor"], s["n"], hashes[at + begin : at + begin + count + window - 1].tobytes()), strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out[:5]] + [pa.array(out[5], pa.binary())], names=["doc_id", "fp", "place", "anchor", "n", "words"])

    references = docs.join(wanted, ["doc_id", "fp"]).mapInArrow(cut, "doc_id long, fp long, place long, anchor long, n long, words binary")
    salts = F.ceil(F.col("n") / shard_segments)
    references = references.withColumn("salt", F.when(salts > 1, F.pmod(F.xxhash64("doc_id", "place"), salts)).otherwise(F.lit(0))).withColumn("hot", F.col("n") > shard_segments)
    shards = max(64, -(-(many.agg(F.coalesce(F.sum(F.least("n", F.lit(shard_segments))), F.lit(0))).first()[0]) // SHARD_TOTAL))
    references = references.withColumn("shard", F.when(F.col("hot"), F.xxhash64("anchor", "salt")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards))))

    def owners(table: pa.Table) -> pa.Table:
        """One shard.  Per reference the windows that a smaller doc_id owns; of hot shards every distinct window and its owner."""
        held = table.to_pydict()
        order = sorted(range(len(held["anchor"])), key=held["anchor"].__getitem__)
        at = 0
        out: list[tuple[int, int, int, int, int, int | None]] = []
        while at < len(order):
            anchor, sam, group = held["anchor"][order[at]], SuffixAutomaton(), []
            while at < len(order) and held["anchor"][order[at]] == anchor:
                i = order[at]
                sequence = np.frombuffer(held["words"][i], np.uint64)
                group.append((i, sequence, sequence.tolist()))
                sam.add(group[-1][2], held["doc_id"][i])
                at += 1
            sam.finish()
            told = set()
            for i, sequence, listed in group:
                doc = held["doc_id"][i]
                begin = held["place"][i] >> 6
                marks = [(k, state, sam.owner(state, size, window)) for k, (size, state) in enumerate(sam.statistics(listed))][window - 1 :]
                if not held["hot"][i]:
                    out += [(doc, held["fp"][i], held["place"][i], begin + k - window + 1, 0, None) for k, _, owner in marks if owner < doc]
                    continue
                starts = np.arange(len(marks))
                for (k, _, owner), h in zip(marks, signed(range_hashes(sequence, starts, starts + window)).tolist(), strict=True):
                    out.append((doc, held["fp"][i], held["place"][i], begin + k - window + 1, h, owner if h not in told else None))
                    told.add(h)
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "fp", "place", "start", "window", "owner"])

    judged = written(references.groupBy("shard").applyInArrow(owners, "doc_id long, fp long, place long, start long, window long, owner long"), "owners")
    cold = judged.where("window = 0").select("doc_id", "fp", "place", "start")
    # windows of hot anchors: owners from all their shards
    hot = judged.where("window <> 0")
    least = written(hot.where("owner is not null").groupBy("window").agg(F.min("owner").alias("least")), "least")
    marked = cold.union(hot.join(least, "window").where("least < doc_id").select("doc_id", "fp", "place", "start"))
    first = marked.select("doc_id", F.col("fp").alias("first_fp"), F.col("place").alias("first_place"), (F.col("start") - F.shiftright("place", 6)).alias("off"))
    more = again.join(first, ["doc_id", "first_fp", "first_place"]).select("doc_id", "fp", (F.shiftright("place", 6) + F.col("off")).alias("start"))
    single = marked.select("doc_id", "fp", "start").union(more).withColumn("size", F.lit(window).cast("long"))
    spans = whole.union(single).groupBy("doc_id", "fp").agg(F.collect_set(F.struct("start", "size")).alias("spans"))  # a repeated row's spans once
    return spans


def keyed(docs: DataFrame) -> DataFrame:
    """Adds `fp`, which with doc_id names one text, also where a doc_id is repeated."""
    return docs.withColumn("fp", F.xxhash64("text"))


def strip_repeats(docs: DataFrame, window: int = 50, gram: int = 14) -> DataFrame:
    """doc_id, n_words, n_removed, kept: each document's text without repeated passages.

    Words are `[^\\x20\\x09-\\x0D]+`; kept words are joined by one space.  Null
    and empty texts have no words.  Rows that share a doc_id don't remove each
    other's words; rows with a null doc_id neither lose words nor own any.
    """
    return _strip(docs, window, gram, "kept string", lambda kept: pa.array(kept, pa.string()))


def _strip(docs: DataFrame, window: int, gram: int, column: str, show) -> DataFrame:
    if not 1 <= gram <= window <= gram + 62:
        raise ValueError("a segment has 63 windows at most: gram must be window - 62 or more")
    source = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    spans = removals(source, window, gram)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in pieces(batches):
            starts, ends, first = words(data, offs)
            raw = data.tobytes()
            gone = np.zeros(len(starts) + 1, np.int32)
            column_of = rows.column("spans")
            has = np.diff(np.concatenate([[0], np.cumsum(column_of.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]))
            inner = column_of.flatten()
            if len(inner):
                at = inner.field("start").to_numpy() + np.repeat(first[:-1], has)
                np.add.at(gone, at, 1)
                np.add.at(gone, at + inner.field("size").to_numpy(), -1)
            gone = np.cumsum(gone[:-1]) > 0
            kept = []
            for a, b in zip(first, first[1:], strict=False):
                stay = np.flatnonzero(~gone[a:b]) + a
                kept.append(b" ".join([raw[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)]))
            lost = np.concatenate([[0], np.cumsum(gone)])
            yield pa.record_batch([rows.column("doc_id"), pa.array(np.diff(first)), pa.array(np.diff(lost[first])), show(kept)], names=["doc_id", "n_words", "n_removed", column.split()[0]])

    return source.join(spans, ["doc_id", "fp"], "left").mapInArrow(cut, f"doc_id long, n_words long, n_removed long, {column}")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strip(read(spark, sf_dir, "documents"), 50, 14, "kept_sha256 string", lambda kept: pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()))
