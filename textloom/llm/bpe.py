"""BPE encoding and decoding with a pair occurrence index (operator 6)."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, pieces, read, small_batches


def _byte_letters() -> list[str]:
    """Printable bytes stand for themselves, the others for letters from 256 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b if b in shown else 256 + hidden.index(b)) for b in range(256)]


class WordBpe:
    """A tokenizer of byte letters with word ends, read from a tokenizers JSON file.

    The vocabulary decides everything: ids, merges, the pattern and the word
    end.  `keep` bounds how many encoded words are remembered per worker.
    """

    def __init__(self, path: str, keep: int = 400_000) -> None:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        self.left_of, self.right_of = [self.vocab[a] for a, _ in merges], [self.vocab[b] for _, b in merges]
        self.made_of = [self.vocab[a + b] for a, b in merges]
        self.rank_of = {a << 20 | b: r for r, (a, b) in enumerate(zip(self.left_of, self.right_of, strict=True))}
        self.pairs = np.array(sorted(self.rank_of), np.int64)
        self.pair_ranks = np.array([self.rank_of[p] for p in self.pairs.tolist()], np.int64)
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(regex.escape(t) for t in self.special)) if self.special else None
        letters = _byte_letters()
        self.inner, self.last = [self.vocab[c] for c in letters], [self.vocab[c + self.end] for c in letters]
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.keep = keep
        self.known: dict[str, tuple[int, ...]] = {}
        self.shown: dict[str, tuple[int, str, str]] = {}

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # each letter by itself, so no final form
        return text.lower()

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(self.normal(text))

    def learn(self, words: list[str]) -> None:
        """Encodes distinct words together: one index of pair -> places for all of them.

        Active pairs are taken in ascending rank; each of a pair's places is
        merged from left to right, and only the lists of its two neighbouring
        pairs change.  A pair is known by its rank.
        """
        inner, last, rank_of, made_of, left_of, right_of = self.inner, self.last, self.rank_of, self.made_of, self.left_of, self.right_of
        ids: list[int] = []
        begins = []
        for word in words:
            raw = word.encode()
            begins.append(len(ids))
            ids += [inner[b] for b in raw[:-1]]
            ids += (last[raw[-1]], -1)
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[int, list[int]] = {}
        flat = np.array(ids, np.int64)
        pairs = flat[:-1] << 20 | flat[1:]
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        there = np.flatnonzero((self.pairs[at] == pairs) & (flat[:-1] >= 0) & (flat[1:] >= 0))
        rank = self.pair_ranks[at[there]]
        order = np.argsort(rank, kind="stable")
        there, rank = there[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, held in zip(rank[np.concatenate([[0], cuts])].tolist() if len(rank) else (), np.split(there, cuts), strict=False):
            places[r] = held.tolist()
        active = list(places)  # ascending, so a heap
        push, pop, get = heapq.heappush, heapq.heappop, rank_of.get
        while active:
            r = pop(active)
            a, b, made = left_of[r], right_of[r], made_of[r]
            held = places.pop(r)
            held.sort()
            for i in held:
                if ids[i] != a:
                    continue
                j = after[i]
                if j >= n or ids[j] != b:
                    continue
                ids[i], ids[j] = made, -2
                k = after[i] = after[j]
                before[k] = i
                if (q := get(made << 20 | ids[k])) is not None:
                    if q in places:
                        places[q].append(i)
                    else:
                        places[q] = [i]
                        push(active, q)
                h = before[i]
                if h >= 0 and (q := get(ids[h] << 20 | made)) is not None:
                    if q in places:
                        places[q].append(h)
                    else:
                        places[q] = [h]
                        push(active, q)
        known = self.known
        for word, i in zip(words, begins, strict=True):
            out = []
            while (t := ids[i]) != -1:
                out.append(t)
                i = after[i]
            known[word] = tuple(out)

    def parts(self, text: str) -> list[str | int]:
        """Words of the text; the id of each special token that stands in it."""
        if self.cut is None or not self.cut.search(text):
            return self.split(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*self.split(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self.split(text[at:])

    def prepare(self, texts: list[str | None]) -> list[list[str | int]]:
        found = [self.parts(t or "") for t in texts]
        if len(self.known) > self.keep:
            self.known.clear()
            self.shown.clear()
        if new := [w for w in set().union(*found).difference(self.known) if type(w) is str]:
            self.learn(new)
        return found

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        known = self.known
        return [[i for w in words for i in (known[w] if type(w) is str else (w,))] for words in self.prepare(texts)]

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by one space, as with no decoder of its own; unknown ids are left out."""
        names = self.names
        return " ".join([names[i] for i in ids if i in names])

    def digests(self, texts: list[str | None]) -> tuple[list[int], list[str], list[str]]:
        """Token count, SHA-256 of the ids and of the decoded text, word by word from the encoded ids."""
        counts, of_ids, of_text = [], [], []
        shown, known = self.shown, self.known
        for words in self.prepare(texts):
            for w in set(words).difference(shown):
                ids = known[w] if type(w) is str else (w,)
                shown[w] = (len(ids), " ".join(map(str, ids)), self.decode(ids))
            rows = [shown[w] for w in words]
            counts.append(sum([r[0] for r in rows]))
            of_ids.append(hashlib.sha256(" ".join([r[1] for r in rows]).encode()).hexdigest())
            of_text.append(hashlib.sha256(" ".join([r[2] for r in rows]).encode()).hexdigest())
        return counts, of_ids, of_text


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str, keep: int = 400_000) -> WordBpe:
    """One per worker and file, which remembers `keep` words from now on; the file must be at `path` on every executor."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    _loaded[path].keep = keep
    return _loaded[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str, column: str = "text", into: str = "ids") -> DataFrame:
    """`docs` with the array of token ids of each whole text; a null or empty text has none."""
    types = T.StructType([*docs.drop(into).schema, T.StructField(into, T.ArrayType(T.IntegerType()))])

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for rows, _, _ in pieces(batches, column):
            ids = bpe.encode(rows.column(column).to_pylist())
            yield pa.record_batch([*rows.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*rows.schema.names, into])

    return docs.drop(into).mapInArrow(run, types)


def _texts_of(ids: pa.Array, names: dict[int, str], shown: pa.Array) -> pa.Array:
    """The decoded text of each id list; null lists give an empty text, unknown ids leave no space behind."""
    ids = ids.fill_null([]) if ids.null_count else ids
    flat = ids.flatten()
    known = pc.and_kleene(pc.greater_equal(flat, 0), pc.less(flat, len(shown)))
    parts = shown.take(pc.if_else(pc.fill_null(known, False), flat, pa.scalar(None, flat.type)))
    if parts.null_count:
        return pa.array([" ".join([names[i] for i in row if i in names]) for row in ids.to_pylist()], pa.string())
    offsets = np.concatenate([[0], np.cumsum(pc.fill_null(ids.value_lengths(), 0).to_numpy(zero_copy_only=False))]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), parts), " ")


def round_trip(docs: DataFrame, path: str, keep: int = 100_000) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of each whole text, by one Python worker a task; `keep` encoded words are remembered in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, keep)
        shown = pa.array([bpe.names.get(i) for i in range(max(bpe.names) + 1)], pa.string())
        for rows, _, _ in pieces(batches, most=256 << 10):
            ids = pa.array(bpe.encode(rows.column("text").to_pylist()), pa.list_(pa.int32()))
            yield pa.record_batch([rows.column("doc_id"), ids.value_lengths().cast(pa.int64()), ids, _texts_of(ids, bpe.names, shown)], names=["doc_id", "n_tokens", "ids", "decoded"])
        give_back()

    small_batches(docs.sparkSession)
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, decoded string")


def decode(tokens: DataFrame, path: str, column: str = "ids", into: str = "decoded") -> DataFrame:
    """`tokens` with the text of each id array, specials included; null ids give an empty text."""
    types = T.StructType([*tokens.drop(into).schema, T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = tokenizer(path).names
        shown = pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                rows = batch.slice(at, 200)
                at += 200
                yield pa.record_batch([*rows.columns, _texts_of(rows.column(column), names, shown)], names=[*rows.schema.names, into])

    return tokens.drop(into).mapInArrow(run, types)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 without shipping the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for rows, _, _ in pieces(batches):
            counts, of_ids, of_text = bpe.digests(rows.column("text").to_pylist())
            yield pa.record_batch([rows.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read(spark, sf_dir, "documents"), default_vocabulary())
