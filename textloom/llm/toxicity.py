"""Toxicity by multiple-instance learning (operator 9).

A document is a bag of sentences.  Each sentence has a probability from the
hashed words and pieces of words in it; noisy-or makes the document's probability of them:
1 - product(1 - p).  Only document labels are learned from; the sentences'
probabilities then show which ones offend.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, SPACE, mix, pieces, read, word_hashes, words, written

#: The bound on labelled documents to train on, the first by a hash of doc_id.
SAMPLE_DOCS = 20_000
#: The bound on the bytes of their texts: no further document is taken once they hold so many.
SAMPLE_BYTES = 256 << 20
#: Buckets of hashed words and pieces of words, and how many of them the model may use: its size, whatever the corpus.
BUCKETS, CHOSEN = 1 << 20, 20_000
#: Bytes in a piece of a word, so that inflected and joined forms share evidence.
PIECES = (4, 6)
THRESHOLD = 0.3
#: Bytes that end a sentence, and bytes around words that are no part of them.
_STOP = np.zeros(256, bool)
_STOP[[*b".!?\n"]] = True
_EDGE = SPACE.copy()
_EDGE[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


@dataclass
class Model:
    """Weights of the chosen buckets (0 elsewhere) and the bias of every sentence."""

    weights: np.ndarray
    bias: float


@dataclass
class Bags:
    """`feature` sorted by sentence without repeats; `of` its sentence; `row` each sentence's row; `begin`, `end` its bytes."""

    feature: np.ndarray
    of: np.ndarray
    row: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def bags(data: np.ndarray, offs: np.ndarray, use: np.ndarray | None = None) -> Bags:
    """Sentences of all rows and the distinct buckets in each, those of `use` only where it is given.

    A row without words has no sentence.
    """
    low = LOWER[data]
    starts, ends, rows = words(low, offs, _EDGE)
    stops = np.cumsum(_STOP[data], dtype=np.int64)
    part = stops[starts] if len(starts) else np.zeros(0, np.int64)
    new = np.zeros(len(starts), bool)
    new[1:] = part[1:] != part[:-1]
    new[rows[:-1][rows[:-1] < len(starts)]] = True
    first = np.flatnonzero(new)
    row = np.searchsorted(rows, first, "right") - 1
    sentence = np.cumsum(new) - 1
    found, where = [(word_hashes(low, starts, ends) >> np.uint64(44)).astype(np.int32)], [sentence]
    for size in PIECES:
        n = np.maximum(ends - starts - size + 1, 0)
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        found.append((mix(word_hashes(low, at, at + size) + np.uint64(size)) >> np.uint64(44)).astype(np.int32))
        where.append(np.repeat(sentence, n))
    feature, of = np.concatenate(found), np.concatenate(where)
    if use is not None:
        keep = use[feature]
        feature, of = feature[keep], of[keep]
    if len(feature):
        both = np.unique(of.astype(np.int64) * BUCKETS + feature)
        of, feature = both // BUCKETS, (both % BUCKETS).astype(np.int32)
    last = np.append(first[1:], len(starts)) - 1
    return Bags(feature, of, row, starts[first], ends[last] if len(first) else starts[:0])


def sentence_logits(bag: Bags, model: Model) -> np.ndarray:
    return model.bias + np.bincount(bag.of, model.weights[bag.feature], len(bag.row))


def noisy_or(z: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """1 - product of (1 - sigmoid(z)) of each row's sentences; 0 for a row of none."""
    return np.clip(-np.expm1(-np.bincount(row, np.logaddexp(0, z), n)), 0, 1)


def train(bag: Bags, label: np.ndarray, rounds: int = 200, rate: float = 0.1, l2: float = 1e-5) -> Model:
    """Full-batch Adam on the documents' log-likelihood under noisy-or."""
    n = len(label)
    base = min(max(label.mean() if n else 0.01, 1e-4), 0.999)
    each = max(1.0, len(bag.row) / max(1, n))
    start = -np.expm1(np.log1p(-base / 2) / each)
    model = Model(np.zeros(BUCKETS, np.float32), float(np.log(start / (1 - start))))
    if not n or label.min() == label.max():
        return model
    used, at = np.unique(bag.feature, return_inverse=True)
    w, bias = np.zeros(len(used)), model.bias
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = bias + np.bincount(bag.of, w[at], len(bag.row))
        p = noisy_or(z, bag.row, n)
        # d loss / d z of a sentence: sigmoid(z) * (1 - y / p of its document)
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) * (1 - label / np.maximum(p, 1e-9))[bag.row]) / n
        gw, gb = np.bincount(at, g[bag.of], len(used)) + l2 * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        bias -= rate / 5 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    model.weights[used], model.bias = w, float(bias)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE_DOCS, most: int = SAMPLE_BYTES) -> Model:
    """The model from at most `sample` labelled documents, those with the smallest hashes of doc_id, until their texts hold `most` bytes.

    Labels other than 0 and 1 are left out, and a document with both counts as
    1.  Without both kinds the score rests on the label's base rate.  Rows of
    labels that are held out must not be in `labels`.  The buckets that stand
    in clearly more documents of one label are chosen first, by counts that
    Spark sums; then the weights are trained on those buckets alone.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sizes = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))  # `sample` rows at most
    before = F.coalesce(F.sum("bytes").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = written(sizes.withColumn("before", before).where(F.col("before") < most).select("doc_id", "y"), "sample")
    chosen = texts.join(F.broadcast(known), "doc_id")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((2, BUCKETS), np.int32), np.zeros(2, np.int64)
        for rows, data, offs in pieces(batches, most=512 << 10):
            bag, y = bags(data, offs), rows.column("y").to_numpy(zero_copy_only=False)
            both = np.unique(bag.row[bag.of] * BUCKETS + bag.feature)
            for k in (0, 1):
                total[k] += np.bincount((both % BUCKETS)[y[both // BUCKETS] == k], minlength=BUCKETS).astype(np.int32)
                seen[k] += (y == k).sum()
        there = np.flatnonzero(total.sum(axis=0))
        yield pa.record_batch([pa.array([-1, *there], pa.int64()), pa.array([seen[0], *total[0][there]], pa.int64()), pa.array([seen[1], *total[1][there]], pa.int64())], names=["bucket", "n0", "n1"])

    found = chosen.mapInArrow(counts, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 + n1 >= 5").toArrow()  # BUCKETS + 1 rows at most
    bucket, n0, n1 = (found.column(c).to_numpy() for c in ("bucket", "n0", "n1"))
    all0, all1 = n0[bucket == -1].sum(), n1[bucket == -1].sum()
    real = bucket >= 0
    bucket, n0, n1 = bucket[real], n0[real], n1[real]
    odds = np.log((n1 + 0.5) / (all1 - n1 + 0.5)) - np.log((n0 + 0.5) / (all0 - n0 + 0.5))
    sure = np.abs(odds) / np.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5) + 1 / (np.maximum(all1 - n1, 0) + 0.5) + 1 / (np.maximum(all0 - n0, 0) + 0.5))
    good = np.argsort(-sure, kind="stable")[:CHOSEN]
    use = np.zeros(BUCKETS, bool)
    use[bucket[good[sure[good] > 3.5]]] = True
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(use))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.unpackbits(held.value).astype(bool)
        place = np.cumsum(mask) - 1
        for rows, data, offs in pieces(batches, most=512 << 10):
            bag = bags(data, offs, mask)
            x, n = place[bag.feature].astype(np.uint16), np.bincount(bag.of, minlength=len(bag.row)).astype(np.int32)
            edge = np.searchsorted(bag.row, np.arange(rows.num_rows + 1))
            inner = np.searchsorted(bag.of, edge)
            out = [(x[a:b].tobytes(), n[s:t].tobytes()) for a, b, s, t in zip(inner, inner[1:], edge, edge[1:], strict=False)]
            yield pa.record_batch([rows.column("y").cast(pa.int8()), pa.array([x for x, _ in out], pa.binary()), pa.array([n for _, n in out], pa.binary())], names=["y", "x", "n"])

    # of each document its label, its chosen buckets by their places among these (16 bits), and their number in each sentence
    got = chosen.mapInArrow(features, "y byte, x binary, n binary").toArrow()  # `sample` rows and `most` bytes of text at most
    label_of = got.column("y").to_numpy().astype(float)
    joined = lambda name, kind: np.frombuffer(b"".join(got.column(name).to_pylist()), kind)
    sizes = np.array([len(n) // 4 for n in got.column("n").to_pylist()], np.int64)
    n = joined("n", np.int32)
    none = np.zeros(0, np.int64)
    feature = np.flatnonzero(use).astype(np.int32)[joined("x", np.uint16)]
    return train(Bags(feature, np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(label_of)), sizes), none, none), label_of)


def _sent(docs: DataFrame, model: Model):
    """The model's chosen buckets to every executor: CHOSEN weights at most."""
    at = np.flatnonzero(model.weights)
    return docs.sparkSession.sparkContext.broadcast((at, model.weights[at], model.bias))


def _got(held) -> tuple[np.ndarray, Model]:
    at, weights, bias = held.value
    model = Model(np.zeros(BUCKETS, np.float32), bias)
    model.weights[at] = weights
    return model.weights != 0, model


def score(docs: DataFrame, model: Model, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys + `score` of each whole text and where its worst sentence stands: first byte, bytes, probability.

    Null and empty texts have no sentence: their score is 0 and the rest null.
    """
    held = _sent(docs, model)
    schema = ", ".join(f"`{k}` {docs.select(k).schema[0].dataType.simpleString()}" for k in keys) + ", score double, worst_byte long, worst_bytes long, worst_score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, model = _got(held)
        for rows, data, offs in pieces(batches, most=512 << 10):
            bag, n = bags(data, offs, use), rows.num_rows
            z = sentence_logits(bag, model)
            worst = np.full(n, -1)
            order = np.argsort(z, kind="stable")
            worst[bag.row[order]] = order  # the last written is the largest
            none = worst < 0
            at = np.where(none, 0, worst)
            pick = lambda values: pa.array(values[at] if len(values) else np.zeros(n, values.dtype), mask=none)
            start = pick(bag.begin - offs[:-1][bag.row])
            yield pa.record_batch([*(rows.column(k) for k in keys), pa.array(noisy_or(z, bag.row, n)), start, pick(bag.end - bag.begin), pick(1 / (1 + np.exp(-z)))], names=[*keys, "score", "worst_byte", "worst_bytes", "worst_score"])

    return docs.select(*keys, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def remainder(column: str, n: int):
    return F.crc32(F.col(column).cast("string")) % n


def train_labels(labels: DataFrame) -> DataFrame:
    """The rows that may be learned from."""
    return labels.where(remainder("doc_id", 4) != 2)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below `threshold`, with all columns and rows as they are."""
    held = _sent(docs, fit(docs, train_labels(labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, model = _got(held)
        for rows, data, offs in pieces(batches, most=512 << 10):
            bag = bags(data, offs, use)
            yield rows.filter(pa.array(noisy_or(sentence_logits(bag, model), bag.row, rows.num_rows) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, train_labels(read(spark, sf_dir, "labels"))))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst_byte", "worst_bytes", "worst_score")
