"""Shared pieces: session folders, Arrow text chunks, word hashing, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables

_LIBC = ctypes.CDLL(None)  # this process and its libraries

#: Bytes of text that one numpy pass works on; bounds a Python worker's memory.
CHUNK_BYTES = 1 << 20

#: The separators of `[^\x20\x09-\x0D]+`, and of ASCII-alphanumeric words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:0x80] = True
NON_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows where the session has Spark's default: with whole texts, 10,000 take much memory in a Python worker."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder, by small Arrow batches."""
    small_batches(df.sparkSession)
    return tables.written(df, name)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (of strings in UTF-8) and row offsets of a string or binary column; nulls are empty."""
    col = (col.fill_null("") if col.null_count else col).cast(pa.large_string() if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else pa.large_binary())
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def give_back() -> None:
    """Returns free memory of this Python worker, which lives on, to the system; does nothing where that isn't known."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) with about `most` bytes each; one row is never split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to
        del data, offs, batch
    give_back()


def words(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each row's first word; a row's end ends a word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    ok = np.zeros(n + 2, bool)
    ok[1:-1] = ~sep[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    starts = np.flatnonzero(ok[1:-1] & (~ok[:-2] | edge[:-1]))
    ends = np.flatnonzero(ok[1:-1] & (~ok[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


_MULT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULT, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = 1 << max(16, (n - 1).bit_length())
        held = np.full(size, base, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if size <= 1 << 23:
            _powers[base] = held
    return held[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that all bits of a polynomial hash count."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for all pairs, from one prefix sum (wrapping)."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_MULT, len(values)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_INVERSE, len(values) + 1)[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return _ranges(_BYTES[data], starts, ends)


def range_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the words start..end-1 for each pair; equal word sequences have equal hashes."""
    return _ranges(hashes, starts, ends)


def hash_text(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def map_pieces(df: DataFrame, work: Callable, schema: str, column: str = "text", most: int = CHUNK_BYTES) -> DataFrame:
    """work(rows, bytes, offsets) -> RecordBatch, over all rows of `df`, in bounded pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in pieces(batches, column, most):
            if (out := work(rows, data, offs)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces one partition's links by a star to the smallest id of each of its components."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
                parent.setdefault(min(a, b), min(a, b))
    out = [(x, find(x)) for x in parent]
    out = [(x, r) for x, r in out if x != r]
    for i in range(0, len(out), 100_000):
        part = out[i : i + 100_000]
        yield pa.record_batch([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], names=["u", "v"])


#: Links that one task may hold when forests are merged.
FOREST_LINKS = 500_000


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in `edges(u long, v long)`, component being the smallest reachable id.

    Every partition shrinks its links to a forest, and forests are merged
    FOREST_LINKS at a time; where they all fit into one task, that is the
    result.  Beyond that, rounds of large-star and small-star (each a min per
    id and a join) go on until the links are stars.
    """
    held = written(edges.where("u <> v"), "links")  # apart from what made them, so that no task has two Python workers
    while True:
        parts = -(-held.count() // FOREST_LINKS)
        if parts <= 1:
            new = written(held.coalesce(1).mapInArrow(_forest, "u long, v long"), "stars")
            break
        held = written(held.coalesce(parts).mapInArrow(_forest, "u long, v long"), "links")
        both = held.select("u", "v").union(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        # large-star: larger neighbours move to the smallest id around
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.mapInArrow(_forest, "u long, v long"), "links")
        # small-star: an id's smaller neighbours move to the smallest of them
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = written(small.select("e.*").where("u <> v").distinct(), "links")
        split = new.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if not split and not new.select("v").distinct().join(new.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            break
        held = new
    heads = new.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return new.select(F.col("u").alias("id"), F.col("v").alias("component")).union(heads)
