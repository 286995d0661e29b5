"""Embedding near-duplicates with iterative quantisation and multi-index hashing (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, read, written

#: The bound on vectors that a rotation is learned from (the first by hash), and on the lengths that have a learned one.
SAMPLE, LENGTHS = 8_192, 64


@dataclass
class Quantiser:
    """Signs of (unit vector - mean) @ rotation: `bits` balanced bits."""

    mean: np.ndarray
    rotation: np.ndarray

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        signs = (vectors - self.mean) @ self.rotation > 0
        out = np.zeros((len(vectors), 64), bool)
        out[:, : signs.shape[1]] = signs
        return np.packbits(out, axis=1, bitorder="little").view("<i8").ravel()


def learn(sample: np.ndarray, bits: int = 64, rounds: int = 30, seed: int = 5) -> Quantiser:
    """ITQ: principal directions, then alternately codes for the rotation and the rotation for the codes.

    Unit vectors are centred by at most half their length: all of their mean
    would tear a sample apart that is one tight cluster.
    """
    mean = sample.mean(axis=0)
    mean = mean * min(1.0, 0.5 / max(float(np.linalg.norm(mean)), 1e-12))
    _, _, axes = np.linalg.svd((sample - mean).T @ (sample - mean))
    axes = axes[: min(bits, sample.shape[1])].T
    low = (sample - mean) @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(low.shape[1], low.shape[1])))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
        turn = (u @ v).T
    return Quantiser(mean, axes @ turn)


def drawn(length: int, bits: int = 64) -> Quantiser:
    """A rotation that no data is needed for."""
    turn = np.linalg.qr(np.random.default_rng(length).normal(size=(length, min(bits, length))))[0]
    return Quantiser(np.zeros(length), turn)


def _unit(column: pa.Array, length: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, length)
    with np.errstate(over="ignore"):
        flat = flat / np.maximum(np.abs(flat).max(axis=1, keepdims=True), 1e-300)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def classes(table: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """label, vector, id (smallest key), copies: distinct usable vectors; all others link with nothing."""
    v = F.col(vector)
    usable = F.col(label).isNotNull() & F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return table.where(F.coalesce(usable, F.lit(False))).groupBy(F.col(label).alias("label"), v.alias("vector")).agg(F.min(key).alias("id"), F.count("*").alias("copies"))


def coded(distinct: DataFrame, bits: int = 64) -> DataFrame:
    """Adds `code`: each of the LENGTHS most frequent vector lengths has its own rotation, learned from SAMPLE vectors of that length; all others have one drawn for the length."""
    lengths = [r[0] for r in distinct.select(F.size("vector").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").limit(LENGTHS).collect()]
    held = {}
    for n in lengths:
        rows = distinct.where(F.size("vector") == n).orderBy(F.xxhash64("vector"), "id").select("vector").limit(SAMPLE).toArrow()
        held[n] = learn(_unit(rows.column("vector").combine_chunks(), n), bits)
    sent = distinct.sparkSession.sparkContext.broadcast(held)  # LENGTHS rotations at most

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sizes = rows.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            for n in np.unique(sizes):
                part = rows.filter(pa.array(sizes == n))
                codes = (sent.value.get(int(n)) or drawn(int(n), bits)).codes(_unit(part.column("vector"), int(n)))
                yield pa.record_batch([*part.columns, pa.array(codes)], names=[*part.schema.names, "code"])

    return distinct.mapInArrow(code, T.StructType([*distinct.schema, T.StructField("code", T.LongType())]))


def candidates(codes: DataFrame, tables: list[tuple[int, int]], radius: int) -> DataFrame:
    """(a, b): every ordered pair of one label and length, once, whose codes differ by one bit or none in some table and by `radius` in all."""

    def sub(code: Column, t: int) -> Column:
        low, width = tables[t]
        return F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << width) - 1))

    entry = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), sub(F.col("code"), t).alias("key")) for t in range(len(tables)))))
    probe = F.explode(F.flatten(F.array(*(F.array(*(F.struct(F.lit(t).alias("t"), sub(F.col("code"), t).bitwiseXOR(F.lit(flip)).alias("key")) for flip in (0, *(1 << i for i in range(width))))) for t, (_, width) in enumerate(tables)))))
    index = codes.select("label", "length", F.col("id").alias("b"), F.col("code").alias("cb"), entry.alias("e")).select("label", "length", "b", "cb", "e.*")
    asks = codes.select("label", "length", F.col("id").alias("a"), F.col("code").alias("ca"), probe.alias("e")).select("label", "length", "a", "ca", "e.*")
    diff = F.col("ca").bitwiseXOR(F.col("cb"))
    first = F.lit(len(tables))
    for t in reversed(range(len(tables))):
        first = F.when(F.bit_count(sub(diff, t)) <= 1, t).otherwise(first)
    pairs = asks.join(index, ["label", "length", "t", "key"])
    return pairs.where((F.col("a") != F.col("b")) & (F.bit_count(diff) <= radius) & (first == F.col("t"))).select("a", "b")


def near_links(distinct: DataFrame, least: float = 0.98, bits: int = 64, radius: int = 18) -> DataFrame:
    """(a, b) in both orders: distinct vectors of one label whose cosine in double precision is `least` or more."""
    codes = written(coded(distinct, bits).withColumn("length", F.size("vector")), "codes")
    largest = codes.groupBy("label", "length").count().agg(F.max("count")).first()[0] or 1
    width = int(min(16, max(8, np.ceil(np.log2(largest)))))
    edges = [round(i * bits / max(1, bits // width)) for i in range(max(1, bits // width) + 1)]
    tables = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    pairs = candidates(codes.select("label", "length", "id", "code"), tables, radius)
    vectors = codes.select("id", "vector", "length")
    pairs = pairs.where("a < b").join(vectors.select(F.col("id").alias("a"), F.col("vector").alias("va"), "length"), "a").join(vectors.select(F.col("id").alias("b"), F.col("vector").alias("vb")), "b")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lengths = rows.column("length").to_numpy()
            for n in np.unique(lengths):
                part = rows.filter(pa.array(lengths == n))
                cosine = np.einsum("ij,ij->i", _unit(part.column("va"), int(n)), _unit(part.column("vb"), int(n)))
                good = pa.array(cosine >= least)
                yield pa.record_batch([part.column("a").filter(good), part.column("b").filter(good), pa.array(cosine).filter(good)], names=["a", "b", "cosine"])

    return pairs.select("a", "b", "va", "vb", "length").mapInArrow(rerank, "a long, b long, cosine double")


def near_groups(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98) -> DataFrame:
    """key, n_links, component_id, kept: one row per vector.

    Copies of a vector share one class and are counted, not paired.  Vectors
    that are null, empty, zero or hold null or non-finite components, and those
    without label or key, link with nothing; a row without key has no component.
    """
    rows = table.select(F.col(key).cast("long").alias(key), F.col(vector).alias(vector), F.col(label).alias(label))
    distinct = written(classes(rows, key, vector, label), "classes")
    links = written(near_links(distinct, least), "pairs")
    both = links.select("a", "b").union(links.select("b", "a"))
    size = distinct.select(F.col("id").alias("b"), "copies")
    others = both.join(size, "b").groupBy("a").agg(F.sum("copies").alias("others")).withColumnRenamed("a", "id")
    groups = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    found = distinct.join(others, "id", "left").join(groups, "id", "left").select(F.col("label").alias(label), F.col("vector").alias(vector), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.join(found, [label, vector], "left")
    return out.select(key, F.coalesce(F.when(F.col(key).isNotNull(), F.col("n_links")), F.lit(0)).cast("long").alias("n_links"), F.when(F.col(key).isNotNull(), F.coalesce("component_id", key)).alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "embeddings"))
