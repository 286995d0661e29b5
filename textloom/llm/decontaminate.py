"""Benchmark decontamination with spaced seeds (operator 7)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NON_ALNUM, map_pieces, mix, read, word_hashes, words, written

#: Which word positions of a window a seed compares (1) and ignores (0).
MASKS = ("1111001", "110100111", "1101100011", "10110010101")
#: Words of an item up to which every substitution that its share allows is found; longer ones have many windows for the seeds.
SHORT = 12
#: The bound on benchmark words that are broadcast at once; more are taken in blocks of so many.
BLOCK_WORDS = 2_000_000
_FACTORS = np.random.default_rng(7).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BITS = 22


def _seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """One hash for each window of the mask's length; ignored positions don't count."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, hash_of_mask(mask), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            total += hashes[i : i + n] * _FACTORS[i % 64]
            if i % 64 == 63:
                total = mix(total)
    return mix(total)


def hash_of_mask(mask: str) -> int:
    return int(mask, 2) % (1 << 61)


@dataclass
class Block:
    """Benchmark items and their seeds, by mask."""

    ids: list
    hashes: list[np.ndarray]
    tables: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    bits: np.ndarray


def short_masks(n: int, share: float) -> list[str]:
    """Masks over all n words of an item, one of which hits wherever the substitutions stand that `share` allows.

    With m substitutions, two at least of m + 2 parts have none, so each pair of parts is a mask.
    """
    parts = np.array_split(np.arange(n), n - math.ceil(share * n) + 2) if n > math.ceil(share * n) else [np.arange(n)]
    return ["".join("1" if i in own else "0" for i in range(n)) for own in ({*a, *b} for k, a in enumerate(parts) for b in parts[k + 1 :] or parts[: len(parts) == 1])]


def build(items: list[tuple[object, np.ndarray]], masks: tuple[str, ...] = MASKS, share: float = 0.8) -> Block:
    """Items of up to SHORT words are also sought as a whole, by masks of their own length."""
    lengths = sorted({len(h) for _, h in items if 0 < len(h) <= SHORT})
    block = Block([i for i, _ in items], [h for _, h in items], {}, np.zeros(1 << _BITS, bool))
    for mask, own in [*((m, False) for m in masks), *((m, True) for n in lengths for m in short_masks(n, share) if m not in masks)]:
        parts = [(_seeds(h, mask), k) for k, (_, h) in enumerate(items) if (len(h) == len(mask) if own else len(h) >= len(mask))]
        if not parts:
            continue
        seeds = np.concatenate([s for s, _ in parts])
        item = np.concatenate([np.full(len(s), k, np.int32) for s, k in parts])
        place = np.concatenate([np.arange(len(s), dtype=np.int32) for s, _ in parts])
        order = np.argsort(seeds, kind="stable")
        seeds, item, place = seeds[order], item[order], place[order]
        # neighbouring places of one seed in one item (as in a run of equal words) are one entry
        new = np.ones(len(seeds), bool)
        new[1:] = (seeds[1:] != seeds[:-1]) | (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1)
        begin = np.flatnonzero(new)
        block.tables[mask] = (seeds[begin], item[begin], place[begin], place[np.append(begin[1:], len(seeds)) - 1])
        block.bits[seeds >> np.uint64(64 - _BITS)] = True
    return block


def _blocks(benchmark: DataFrame, key: str, most: int) -> Iterator[list[tuple[object, np.ndarray]]]:
    """Items with their words' hashes, in blocks of about `most` words."""

    def work(rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
        low = LOWER[data]
        starts, ends, first = words(low, offs, NON_ALNUM)
        hashes = word_hashes(low, starts, ends)
        return pa.record_batch([rows.column(key), pa.array([hashes[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary())], names=[key, "h"])

    kind = benchmark.select(key).schema[0].dataType.simpleString()
    held, size = [], 0
    for row in map_pieces(benchmark.select(key, F.col("text").cast("string").alias("text")), work, f"`{key}` {kind}, h binary").toLocalIterator():
        held.append((row[key], np.frombuffer(row.h, np.uint64)))
        size += len(row.h) // 8
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _expanded(n: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[slice, np.ndarray]]:
    """Slices of about `most` repetitions (n[i] of i), each with the numbers 0.. of the repetitions of every i."""
    ends, at = np.cumsum(n), 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        part = n[at:to]
        yield slice(at, to), np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
        at = to


class Alignments:
    """Distinct (document, item, begin of the item in the piece), in bounded memory: doubles are dropped as they gather."""

    def __init__(self, items: int, span: int) -> None:
        self.items, self.span, self.parts, self.size = items, span, [np.zeros(0, np.int64)], 0

    def add(self, doc: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        for s, more in _expanded(high - low + 1):
            n = (high - low + 1)[s]
            self.parts.append(np.unique(np.repeat((doc[s] * self.items + item[s]) * (2 * self.span) + self.span + low[s], n) + more))
            self.size += len(self.parts[-1])
            if self.size > 1 << 22:
                self.parts = [np.unique(np.concatenate(self.parts))]
                self.size = 0

    def all(self) -> Iterator[tuple[int, int, int]]:
        keys = np.unique(np.concatenate(self.parts))
        for at in range(0, len(keys), 1 << 16):
            pair, begin = np.divmod(keys[at : at + (1 << 16)], 2 * self.span)
            yield from zip((pair // self.items).tolist(), (pair % self.items).tolist(), (begin - self.span).tolist(), strict=True)


def best_overlap(same: np.ndarray, share: float) -> tuple[int, int]:
    """(begin, end) of the stretch with the most matches among those of which `share` or more are matches."""
    total = np.concatenate([[0.0], np.cumsum(same - share)])
    low = np.minimum.accumulate(total)
    begin = np.minimum(np.searchsorted(-low, -(total + 1e-9), "left"), np.arange(len(total)))  # the first that is no higher than the end
    matches = np.concatenate([[0], np.cumsum(same)])
    end = int(np.argmax(matches - matches[begin]))
    return int(begin[end]), end


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", masks: tuple[str, ...] = MASKS, words_needed: int = 13, share: float = 0.8, most: int = BLOCK_WORDS) -> DataFrame:
    """key, item, first_word, n_words, n_same: for each document and item, the best verified overlap.

    A seed hit fixes an alignment; along it the stretch is taken whose words
    are equal to a share of `share` or more, and it counts from `words_needed`
    equal words on (for shorter items from `share` of their words on).  Words
    are runs of letters and digits, A-Z lower-cased.  Items without words match
    nothing; null and empty texts have no rows.  The benchmark is broadcast in
    blocks of `most` words, one pass over the documents for each block.
    """
    kinds = [docs.select(key).schema[0].dataType.simpleString(), benchmark.select(item).schema[0].dataType.simpleString()]
    schema = f"`{key}` {kinds[0]}, `{item}` {kinds[1]}, first_word long, n_words long, n_same long"
    types = [pa.int64()] * 3
    source = docs.select(key, F.col("text").cast("string").alias("text"))
    id_type = None

    def pass_over(held) -> DataFrame:
        def work(rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> pa.RecordBatch | None:
            block: Block = held.value
            low = LOWER[data]
            starts, ends, first = words(low, offs, NON_ALNUM)
            hashes = word_hashes(low, starts, ends)
            found = Alignments(len(block.ids), len(hashes) + max(map(len, block.hashes)) + 1)
            for mask, (seeds, of, least, last) in block.tables.items():
                here = _seeds(hashes, mask)
                at = np.flatnonzero(block.bits[here >> np.uint64(64 - _BITS)])
                lo, hi = np.searchsorted(seeds, here[at], "left"), np.searchsorted(seeds, here[at], "right")
                n = hi - lo
                at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
                doc = np.searchsorted(first, at, "right") - 1
                whole = at + len(mask) <= first[doc + 1]  # within one document
                at, lo, n, doc = at[whole], lo[whole], n[whole], doc[whole]
                # neighbouring hits of one seed are one run, from its first to its last place
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1] + 1) | (lo[1:] != lo[:-1]) | (doc[1:] != doc[:-1])
                begin = np.flatnonzero(new)
                end = at[np.append(begin[1:], len(at)) - 1] if len(at) else at
                at, lo, n, doc = at[begin], lo[begin], n[begin], doc[begin]
                for s, more in _expanded(n):
                    k = np.repeat(lo[s], n[s]) + more
                    found.add(np.repeat(doc[s], n[s]), of[k].astype(np.int64), np.repeat(at[s], n[s]) - last[k], np.repeat(end[s], n[s]) - least[k])
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for doc, k, begin in found.all():
                words_of = block.hashes[k]
                a, b = max(begin, int(first[doc])), min(begin + len(words_of), int(first[doc + 1]))
                same = hashes[a:b] == words_of[a - begin : b - begin]
                need = min(words_needed, int(np.ceil(share * len(words_of))))
                if same.sum() < need:
                    continue
                s, e = best_overlap(same, share)
                n = int(same[s:e].sum())
                if n >= need and n > best.get((doc, k), (0, 0, 0))[2]:
                    best[doc, k] = (a + s - int(first[doc]), e - s, n)
            if not best:
                return None
            ids = rows.column(key).take(pa.array([d for d, _ in best]))
            items = pa.array([block.ids[k] for _, k in best], id_type)
            return pa.record_batch([ids, items, *(pa.array(c, t) for c, t in zip(zip(*best.values(), strict=True), types, strict=True))], names=[key, item, "first_word", "n_words", "n_same"])

        return map_pieces(source, work, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(benchmark.select(item).schema[0].dataType)
    passes = [pass_over(docs.sparkSession.sparkContext.broadcast(build(items, masks, share))) for items in _blocks(benchmark, item, most)]
    return reduce(DataFrame.union, passes) if passes else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any verified overlap, with all columns and rows as they are."""
    hit = written(overlaps(docs, benchmark).select("doc_id").distinct(), "hits")  # Spark knows its size, and broadcasts or shuffles by that
    return docs.join(hit, "doc_id", "left_anti").select(*docs.columns)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
