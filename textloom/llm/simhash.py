"""SimHash near-duplicates with pigeonring filtering (operator 2)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, components, give_back, map_pieces, mix, range_hashes, read, signed, word_hashes, words, written

_LOWER = LOWER.tobytes()


def fingerprint(text: bytes, width: int) -> int:
    """Majority bits of the XXH64 (seed 42) of all `width`-word shingles; 0 for no words."""
    found = text.translate(_LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    k = min(width, len(found))
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[s:e], 42) for s, e in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys + `fp` long, one row per document; a null text has no words."""
    schema = ", ".join(f"`{k}` {docs.select(k).schema[0].dataType.simpleString()}" for k in keys) + ", fp long"

    def work(rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
        raw = data.tobytes()
        out = np.fromiter((fingerprint(raw[a:b], width) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)), np.uint64, len(offs) - 1)
        return pa.record_batch([*(rows.column(k) for k in keys), pa.array(out.view(np.int64))], names=[*keys, "fp"])

    return map_pieces(docs.select(*keys, F.col("text").cast("string").alias("text")), work, schema)


def _segments(segments: int) -> list[tuple[int, int]]:
    """(first bit, mask) of each of the ring's segments."""
    edges = [round(i * 64 / segments) for i in range(segments + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _within_budget(diff: Column, start: Column, parts: list[tuple[int, int]], most: int) -> Column:
    """Pigeonring: from its start, each chain of l segments differs in at most l*most/m bits."""
    m, ok = len(parts), F.lit(False)
    for i in range(m):
        chain, total = F.lit(True), F.lit(0)
        for size in range(1, m + 1):
            low, mask = parts[(i + size - 1) % m]
            total = total + F.bit_count(F.shiftrightunsigned(diff, low).bitwiseAND(F.lit(mask)))
            chain = chain & (total * m <= size * most)
        ok = ok | ((start == i) & chain)
    return ok


def near_pairs(fps: DataFrame, most: int = 2, segments: int = 7, hot: int = 48) -> DataFrame:
    """Links (u, v) whose closure is that of all pairs of distinct `fp` at `most` or fewer differing bits.

    With m segments on a ring and at most `most` differing bits, some run of
    m // most - (m % most == 0) ... consecutive segments has no difference; this
    run is the join key, the rest of the ring is checked against the
    proportional budgets of the chain, then the whole distance is.  A key that
    over `hot` fingerprints share is not paired: each of them puts out itself
    and its one-bit neighbours outside the key, and two fingerprints at
    distance two or less share one of those.  A neighbour is shared by at most
    65 fingerprints, so nothing there grows with a group's square.
    """
    if not 1 <= most <= 2:
        raise ValueError("near_pairs links at one or two differing bits")
    parts = _segments(segments)
    run = -(-(segments - most) // most)  # the longest of `most` arcs that share the other segments
    keys = []
    for i in range(segments):
        mask = 0
        for low, width in (parts[(i + j) % segments] for j in range(run)):
            mask |= width << low
        keys.append((i, mask - (1 << 64) if mask >> 63 else mask))
    keyed = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key"), F.lit(mask).alias("mask")) for i, mask in keys))).alias("k")).select("fp", "k.*")
    sizes = keyed.groupBy("start", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(sizes, ["start", "key"])
    few, many = shared.where(F.col("n") <= hot), shared.where(F.col("n") > hot)
    members = few.groupBy("start", "key").agg(F.collect_list("fp").alias("fps"))  # at most `hot`
    left = members.select("start", F.col("fps"), F.explode("fps").alias("u"))
    pairs = left.select("start", "u", F.explode("fps").alias("v")).where("u < v")
    diff = F.col("u").bitwiseXOR(F.col("v"))
    pairs = pairs.where(_within_budget(diff, F.col("start"), parts, most)).where(F.bit_count(diff) <= most).select("u", "v")
    flips = F.array(*(F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(64)))
    free = F.filter(flips, lambda b: b.bitwiseAND(F.col("mask")) == 0)
    around = F.concat(F.array("fp"), F.transform(free, lambda b: F.col("fp").bitwiseXOR(b))) if most == 2 else F.concat(F.array("fp"), F.transform(free, lambda b: F.col("fp").bitwiseOR(b)))
    near = many.select("fp", F.explode(around).alias("at"))
    if most == 1:  # two at distance one share the value with their differing bit set
        near = many.select("fp", F.explode(F.transform(free, lambda b: F.struct(b.alias("bit"), F.col("fp").bitwiseOR(b).alias("or")))).alias("at"))
    stars = near.groupBy("at").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # at most 65
    stars = stars.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u <> v")
    return pairs.union(stars)


def near_groups(docs: DataFrame, width: int = 3, most: int = 2, segments: int = 7) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links of `most` or fewer differing bits.

    Documents without words have fingerprint zero and are linked like others.
    Repeated doc_ids keep their rows; a null doc_id keeps its row and takes part
    with no id of its own.  An empty table gives no rows.
    """
    marked = written(fingerprints(docs, width), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    same = components(near_pairs(distinct.select("fp"), most, segments))
    # a repeated doc_id joins the groups of its rows
    repeated = marked.groupBy("doc_id").agg(F.min("fp").alias("u"), F.max("fp").alias("v"), F.count("*").alias("n")).where("n > 1 and u <> v and doc_id is not null")
    if repeated.limit(1).count():
        again = marked.join(repeated.select("doc_id", "u"), "doc_id").select(F.col("fp").alias("u"), F.col("u").alias("v"))
        same = components(near_pairs(distinct.select("fp"), most, segments).union(again))
    classes = distinct.join(same, distinct.fp == same.id, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "component").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


#: The wide fingerprint: bits of a segment and segments on its ring.  Two documents at Jaccard 0.8 differ in 38 of its 252 bits on
#: average (47 where they have five shingles or fewer); MOST is four standard deviations beyond that, and what passes is compared exactly.
SEGMENT, RING, MOST = 28, 9, 72
#: Least Jaccard similarity of the five-word shingles of two near copies.
JACCARD = 0.8
#: Keys of a document, and least hashes in each: at Jaccard J two documents share none with (1 - J**ROWS)**BANDS, 0.0004 at 0.8.
BANDS, ROWS = 20, 5
#: Documents of a block: what a task holds of those who share a key or a rare shingle.
BLOCK = 512
_FACTORS = np.random.default_rng(20240301).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _wide(hashes: np.ndarray) -> np.ndarray:
    """RING segments of SEGMENT majority bits over a document's distinct shingles."""
    bits = []
    for k in range(-(-RING * SEGMENT // 64)):
        total = np.zeros(64, np.int64)
        part = mix(hashes + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)))
        for i in range(0, len(part), 1 << 15):
            total += np.unpackbits(part[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits.append(total * 2 > len(hashes))
    rows = np.concatenate(bits)[: RING * SEGMENT].reshape(RING, SEGMENT)
    return rows @ (1 << np.arange(SEGMENT, dtype=np.int64))


def _bands(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys, each of ROWS least hashes (MinHash) over a document's distinct shingles and of the band's number."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(hashes), 1 << 12):
        np.minimum(least, (hashes[None, i : i + (1 << 12)] * _FACTORS[:, None]).min(axis=1), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + part)
    return signed(keys)


def _sets(data: np.ndarray, offs: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its `width`-word shingles) of every row with words."""
    low = LOWER[data]
    starts, ends, first = words(low, offs)
    hashes = word_hashes(low, starts, ends)
    for i, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist(), strict=False)):
        if a < b:
            at = np.arange(a, max(b - width, a) + 1)
            yield i, np.unique(range_hashes(hashes, at, np.minimum(at + width, b)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def wide_fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, same (a digest of the set), fp (binary, RING 4-byte segments) and bands of every document with words, over the set of its `width`-word shingles."""

    def work(rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
        keep, same, fps, bands = [], [], [], []
        for i, found in _sets(data, offs, width):
            keep.append(i)
            same.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
            fps.append(_wide(found).astype("<i4").tobytes())
            bands.append(_bands(found))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * BANDS, pa.int32()), pa.array(np.concatenate(bands) if bands else [], pa.int64()))
        return pa.record_batch([rows.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(same, pa.binary()), pa.array(fps, pa.binary()), lists], names=["doc_id", "same", "fp", "bands"])

    return map_pieces(_texts(docs), work, "doc_id long, same binary, fp binary, bands array<long>")


def shingle_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, shingles (binary, sorted distinct 8-byte hashes) of every document with words."""

    def work(rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
        found = [(i, x.tobytes()) for i, x in _sets(data, offs, width)]
        return pa.record_batch([rows.column("doc_id").take(pa.array([i for i, _ in found], pa.int64())), pa.array([x for _, x in found], pa.binary())], names=["doc_id", "shingles"])

    return map_pieces(_texts(docs), work, "doc_id long, shingles binary")


def rare_shingles(docs: DataFrame, width: int = 5, least: float = JACCARD) -> DataFrame:
    """id, h, n, left: of each document's n distinct shingles the n - ceil(least * n) + 1 that the fewest of `docs` have, where others have them too.

    Two documents with a Jaccard similarity of `least` or more share one of
    these at least.  `left` counts the document's shingles from this one on in
    that order, so from the first one shared on no more can be shared.
    """

    def work(rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
        found = list(_sets(data, offs, width))
        at = np.repeat([i for i, _ in found], [len(x) for _, x in found]).astype(np.int64)
        which = np.repeat([int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "big", signed=True) for _, x in found], [len(x) for _, x in found]).astype(np.int64)
        n = np.repeat([len(x) for _, x in found], [len(x) for _, x in found]).astype(np.int64)
        h = signed(np.concatenate([x for _, x in found])) if found else np.zeros(0, np.int64)
        return pa.record_batch([rows.column("doc_id").take(pa.array(at)), pa.array(which), pa.array(n), pa.array(h)], names=["id", "which", "n", "h"])

    every = written(map_pieces(_texts(docs), work, "id long, which long, n long, h long"), "shingles")
    counts = every.groupBy("h").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("id", "which").orderBy("df", "h"))  # one document's shingles
    first = every.join(counts, "h").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    return first.where("df > 1").select("id", "h", "n", (F.col("n") - F.col("rank") + 1).alias("left"))


def _segments_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, RING).astype(np.int64)


def ring_check(a: np.ndarray, b: np.ndarray, most: int = MOST) -> np.ndarray:
    """Which pairs of rows differ in `most` bits or fewer.

    First the pigeonring filter: of a pair within `most`, some chain around the
    ring has every prefix of l segments within l * most / RING; pairs without
    one are dropped segment by segment before the whole distance is summed.
    """
    ok = np.zeros(len(a), bool)
    for start in range(RING):
        alive, total = np.flatnonzero(~ok), 0
        total = np.zeros(len(alive), np.int64)
        for size in range(1, RING + 1):
            s = (start + size - 1) % RING
            total = total + np.bitwise_count(a[alive, s] ^ b[alive, s])
            stay = total * RING <= size * most
            alive, total = alive[stay], total[stay]
            if not len(alive):
                break
        ok[alive] = True  # the whole ring is within its budget, which is `most`
    return ok


def near(distinct: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the distinct `pairs(u, v)` whose fingerprints differ in MOST bits or fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                yield rows.select(["u", "v"]).filter(pa.array(ring_check(_segments_of(rows.column("fu")), _segments_of(rows.column("fv")))))

    fps = distinct.select(F.col("id").alias("u"), F.col("fp").alias("fu"))
    both = pairs.join(fps, "u").join(fps.select(F.col("u").alias("v"), F.col("fu").alias("fv")), "v")
    return both.select("u", "v", "fu", "fv").mapInArrow(run, "u long, v long")


def similar(docs: DataFrame, pairs: DataFrame, width: int = 5, least: float = JACCARD) -> DataFrame:
    """Those of the written `pairs(u, v)` whose sets of shingles have a Jaccard similarity of `least` or more, compared in full."""
    wanted = written(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "wanted")  # its size is known to the join
    sets = written(shingle_sets(docs.join(wanted, "doc_id", "left_semi"), width), "sets")
    if sets.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        sets = written(sets.dropDuplicates(["doc_id", "shingles"]), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            good = []
            for a, b in zip(rows.column("a"), rows.column("b"), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                if min(len(a), len(b)) < least * max(len(a), len(b)):
                    good.append(False)
                    continue
                merged = np.concatenate([a, b])
                merged.sort(kind="stable")
                both = int((merged[1:] == merged[:-1]).sum())
                good.append(both >= least * (len(merged) - both))
            yield rows.select(["u", "v"]).filter(pa.array(good, pa.bool_()))
        give_back()

    left = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _across(batches: Iterator[pa.RecordBatch], least: float = JACCARD) -> Iterator[pa.RecordBatch]:
    """All pairs of those who have one rare shingle that are in different components, can share enough from it on, and are within MOST bits.

    A row holds the members of two blocks of a shingle, and pairs go across
    these, or those of one block (`alone`), and pairs go within it.
    """
    for rows in batches:
        for group, alone in zip(rows.column("members"), rows.column("alone").to_pylist(), strict=True):
            ids, heads, n, left, block, fps = group.values.flatten()
            ids, heads, n, left, block, segments = ids.to_numpy(), heads.to_numpy(), n.to_numpy(), left.to_numpy(), block.to_numpy(), _segments_of(fps)
            for i in range(len(ids)):
                enough = np.minimum(left[i], left[i + 1 :]) * (1 + least) >= least * (n[i] + n[i + 1 :]) - 1e-6
                apart = alone | (block[i + 1 :] != block[i])
                other = i + 1 + np.flatnonzero((heads[i + 1 :] != heads[i]) & (ids[i + 1 :] != ids[i]) & enough & apart)
                other = other[ring_check(np.broadcast_to(segments[i], (len(other), RING)), segments[other])]
                if len(other):
                    yield pa.record_batch([pa.array(np.full(len(other), ids[i])), pa.array(ids[other])], names=["u", "v"])


def rare_blocks(found: DataFrame, size: int = BLOCK) -> DataFrame:
    """alone, members: of `found(id, h, n, left, component, fp)` those who have one shingle `h`, where they are of several components.

    The members of a shingle are dealt to blocks of about `size`; each two
    blocks are one row, as is each block alone, so no row grows with the group.
    """
    many = found.groupBy("h").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.ceil(F.count("*") / size).alias("blocks")).where("a <> b").select("h", "blocks")
    dealt = found.join(many, "h").withColumn("block", F.expr("pmod(xxhash64(id), blocks)"))
    met = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).groupBy("h", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    return met.agg(F.array_sort(F.collect_list(F.struct("id", "component", "n", "left", "block", "fp"))).alias("members")).select((F.col("x") == F.col("y")).alias("alone"), "members").where("size(members) > 1")


def near_copies(docs: DataFrame, distinct: DataFrame, width: int = 5, block: int = BLOCK) -> DataFrame:
    """(id, component) of all ids of `distinct(id, fp, bands)` with a near copy.

    Ids that share a key are candidates: all of them, however many share it.
    First each is compared with the first of its key, the one before it in its
    block of the key and the key's hub, which shares most keys with others, as the text does that the
    others were made from;
    what this joins needs no further comparison, so that a large group of
    copies costs no square.  Of the keys that still hold several components,
    all pairs across these are compared that share a rare shingle, as all near
    copies do (see `rare_shingles`).
    """
    every = distinct.select("id", F.explode("bands").alias("key")).distinct()
    same = [F.count("*").alias("size"), F.min("id").alias("head"), F.sum(F.shiftrightunsigned(F.xxhash64("id"), 32)).alias("total"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("xor")]
    keys = every.groupBy("key").agg(*same).where("size > 1")
    keys = keys.groupBy("size", "head", "total", "xor").agg(F.min("key").alias("key"))  # the same ids under several keys are compared once
    groups = written(every.join(keys.select("key", "size", "head"), "key"), "groups")
    before = F.lag("id").over(Window.partitionBy("key", F.expr(f"pmod(xxhash64(id), ceil(size / {block}))")).orderBy("id"))
    lines = groups.where("id <> head").select(F.col("head").alias("u"), F.col("id").alias("v"))
    lines = lines.union(groups.select(before.alias("u"), F.col("id").alias("v")).where("u is not null"))
    of_key = groups.where("size > 2").select("key", "id")
    shared = groups.groupBy("id").agg(F.sum(F.col("size") - 1).alias("n"))
    hubs = of_key.join(shared, "id").groupBy("key").agg(F.max_by("id", F.struct("n", -F.col("id"))).alias("hub"))
    lines = lines.union(of_key.join(hubs, "key").where("id <> hub").select(F.least("id", "hub").alias("u"), F.greatest("id", "hub").alias("v"))).distinct()
    links = written(similar(docs, written(near(distinct, lines), "pairs"), width), "near")
    heads = components(links)
    of = distinct.select("id", "fp").join(heads, "id", "left").select("id", "fp", F.coalesce("component", "id").alias("component"))
    members = of_key.join(of.select("id", "component"), "id")
    open_ = members.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
    left = written(members.join(open_.select("key"), "key", "left_semi").select("id").distinct(), "open")  # its size is known to the join
    if not left.limit(1).count():
        return heads
    rare = rare_shingles(docs.join(left.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"), width)
    rest = rare_blocks(written(rare.join(of, "id"), "rare"), block)
    pairs = written(rest.mapInArrow(_across, "u long, v long").distinct(), "pairs")
    if not pairs.limit(1).count():
        return heads
    return components(links.union(similar(docs, pairs, width)))


def drop_near_copies(docs: DataFrame, width: int = 5, block: int = BLOCK) -> DataFrame:
    """One document of each group of near copies stays, with all its columns: that with the smallest doc_id.

    Documents are linked where their sets of five-word shingles have a Jaccard
    similarity of JACCARD or more, and links are closed transitively.
    Candidates share a MinHash key and are within MOST bits of their wide
    fingerprints; each is compared in full before it links.  Documents without
    words hold nothing to compare and all stay, as do rows with a null doc_id.
    Of rows with one doc_id and equal texts one stays.
    """
    own = docs.where("doc_id is not null")
    marked = written(wide_fingerprints(own, width), "wide")
    distinct = written(marked.groupBy("same").agg(F.min(F.struct("doc_id", "fp", "bands")).alias("x")).select("same", F.col("x.doc_id").alias("id"), "x.fp", "x.bands"), "distinct")
    groups = near_copies(own, distinct, width, block)
    heads = distinct.join(groups, "id", "left").select("same", F.coalesce("component", "id").alias("head"))
    gone = written(marked.select("doc_id", "same").join(heads, "same").where("doc_id <> head").select("doc_id").distinct(), "gone")  # its size is known to the join
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # repeated rows: the first of equal (doc_id, text) stays, and only they are compared
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id")
    if not again.limit(1).count():
        return kept
    twice = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).union(twice)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(read(spark, sf_dir, "documents"), width=3, most=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
