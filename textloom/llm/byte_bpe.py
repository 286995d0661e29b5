"""Byte-level BPE encoding and decoding by the tiktoken library and a local rank file (operator 13)."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_pieces, read, small_batches

#: Characters after which a text is cut at the next safe boundary; bounds what one call of the library works on.
PART = 1 << 16

#: White space runs from this length on go past the library's pattern, which gives up on about a million characters.
LONG_SPACE = 1 << 14

_START_OF_SPACE = regex.compile(r"(?<=\S)\s")
_LONG_SPACE = regex.compile(r"\s{%d,}" % LONG_SPACE)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _spans(text: str, start: int, end: int, part: int) -> Iterator[tuple[int, int]]:
    """start..end in spans of about `part` characters, cut where white space follows another character."""
    while end - start > part and (cut := _START_OF_SPACE.search(text, start + part, end)):
        yield start, cut.start()
        start = cut.start()
    yield start, end


def safe_parts(text: str, part: int = PART) -> Iterator[tuple[str, bool]]:
    """(part of `text`, whether it is one match of the pattern); the parts' matches are those of the whole text.

    No match of the pattern holds white space after another character, and
    nothing in it looks back, so the place between the two ends a match
    whatever stands around.  A long run of white space is one match up to its
    last character, which the pattern leaves to what follows, or to the text's end.
    """
    at = 0
    for run in _LONG_SPACE.finditer(text) if len(text) >= LONG_SPACE else ():
        start, end = run.start(), run.end() - (run.end() < len(text))
        if start > at:
            yield from ((text[a:b], False) for a, b in _spans(text, at, start, part))
        yield text[start:end], True
        at = end
    yield from ((text[a:b], False) for a, b in _spans(text, at, len(text), part) if b > a)


class ByteBpe:
    """The library's encoding of a rank file, without special tokens."""

    def __init__(self, path: str, pattern: str) -> None:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known = np.zeros(max(ranks.values()) + 1, bool)
        self.known[list(ranks.values())] = True

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids, little-endian unsigned 32-bit; null is empty."""
        one, many = self.library._encode_single_piece, self.library.encode_ordinary
        return np.fromiter(chain.from_iterable(one(part.encode()) if whole else many(part) for part, whole in safe_parts(text or "")), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' raw bytes, whether or not they form characters; ids that the rank file lacks give none."""
        ids = ids[(ids >= 0) & (ids < len(self.known))]
        return self.library.decode_bytes(ids[self.known[ids]].tolist())


@functools.lru_cache(2)
def tokenizer(path: str, pattern: str) -> ByteBpe:
    """One for each rank file and Python worker."""
    return ByteBpe(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, column: str = "text", into: str = "ids") -> DataFrame:
    """`docs` with the token ids of each whole text (null: none); a column of that name is replaced."""

    def work(rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
        bpe = tokenizer(path, pattern)
        ids = [bpe.encode(t) for t in rows.column(column).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        flat = pa.array(np.concatenate(ids).astype(np.int32))
        return pa.record_batch([*rows.columns, pa.ListArray.from_arrays(pa.array(offsets), flat)], names=[*rows.schema.names, into])

    small_batches(docs.sparkSession)
    docs = docs.drop(into).withColumn(column, F.col(column).cast("string"))
    return map_pieces(docs, work, T.StructType([*docs.schema, T.StructField(into, T.ArrayType(T.IntegerType()))]), column)


def decode(tokens: DataFrame, path: str, pattern: str, column: str = "ids", into: str = "decoded") -> DataFrame:
    """`tokens` with the raw bytes of each id array as binary: null arrays, null ids and ids that the rank file lacks give none."""
    types = T.StructType([*tokens.drop(into).schema, T.StructField(into, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = batch.slice(at, 200)
                ids = (row.values.drop_null().to_numpy(zero_copy_only=False) if row.is_valid else np.zeros(0, np.int64) for row in rows.column(column))
                yield pa.record_batch([*rows.columns, pa.array([bpe.decode(x) for x in ids], pa.binary())], names=[*rows.schema.names, into])

    return tokens.drop(into).mapInArrow(run, types)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each whole text, without shipping ids.

    Null and empty texts have no tokens and the digests of nothing; repeated
    rows and null keys stay as they are; other columns are not read.
    """

    def work(rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
        bpe = tokenizer(path, pattern)
        counts, of_ids, of_bytes = [], [], []
        for text in rows.column("text").to_pylist():
            ids = bpe.encode(text)
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(ids.tobytes()).hexdigest())
            of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return pa.record_batch([rows.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_pieces(docs, work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), default_ranks(), default_pattern())
