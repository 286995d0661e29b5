"""Target-distribution importance resampling by hashed n-grams (operator 12)."""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sql
from .common import map_pieces, pieces, read, small_batches, written
from .ranking import ranked

#: Fixed value: what separates words.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42

#: Words that n-grams are formed of at once; bounds a Python worker's memory on very long texts.
BLOCK_WORDS = 1 << 18


@functools.lru_cache(256)
def _past(n: int) -> np.ndarray:
    """(4, 256) table: what n further bytes make of a CRC, for each of its four bytes; CRC is linear in them."""
    zeros = bytes(n)
    bit = [zlib.crc32(zeros, 1 << k) ^ zlib.crc32(zeros) for k in range(32)]
    table = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for k in range(8):
            table[byte, 1 << k : 2 << k] = table[byte, : 1 << k] ^ np.uint32(bit[8 * byte + k])
    return table


def _joined(left: np.ndarray, right: np.ndarray, length: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """CRC of two strings from theirs; `length` is the place of the right one's length in `tables`."""
    out = right.copy()
    for byte in range(4):
        out ^= tables[length, byte, (left >> np.uint32(8 * byte)) & np.uint32(255)]
    return out


def _distinct(left: np.ndarray, right: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs: each one's place among the distinct ones, and the distinct ones' left and right sides."""
    coded = pc.dictionary_encode(pa.array(left.astype(np.int64) * width + right))
    pairs = coded.dictionary.to_numpy()
    return coded.indices.to_numpy(), pairs // width, pairs % width


def word_lists(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(dictionary index of every word, row offsets among the words, dictionary) of a text column; nulls have no words."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")), SEPARATOR)
    words, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    held = pc.greater(pc.binary_length(words), 0)
    coded = pc.dictionary_encode(words.filter(held))
    counts = np.bincount(rows.filter(held).to_numpy(), minlength=len(texts))
    return coded.indices.to_numpy(), np.concatenate([[0], np.cumsum(counts)]), coded.dictionary


def buckets(texts: pa.Array, use: Callable[[int, np.ndarray], None]) -> np.ndarray:
    """Row offsets among the words of `texts`; calls use(first word, buckets) for blocks of runs of 1, 2 and 3 words that start there.

    `buckets` is (3, words); BUCKETS marks where no such run starts.
    """
    ids, offsets, dictionary = word_lists(texts)
    if not len(ids):
        return offsets
    spelled = [w.encode() for w in dictionary.to_pylist()]
    crc = np.array([zlib.crc32(w) for w in spelled], np.uint32)
    after = np.array([zlib.crc32(b" " + w) for w in spelled], np.uint32)  # as a run goes on
    lengths, length = np.unique([len(w) + 1 for w in spelled], return_inverse=True)
    tables = np.stack([_past(int(n)) for n in lengths])
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    for at in range(0, len(ids), BLOCK_WORDS):
        n = min(BLOCK_WORDS, len(ids) - at)
        word, left = ids[at : at + n + 2], row_end[at : at + n] - np.arange(at, at + n)
        out = np.full((3, n), BUCKETS, np.int64)
        out[0] = crc[word[:n]] % BUCKETS
        two = np.flatnonzero(row_end[at : at + n + 1][: len(word) - 1] - np.arange(at, at + len(word) - 1) >= 2)
        pair, a, b = _distinct(word[two], word[two + 1], len(spelled))
        crc_pair = _joined(crc[a], after[b], length[b], tables)
        inside = two < n
        out[1, two[inside]] = crc_pair[pair[inside]] % BUCKETS
        three = left[two[inside]] >= 3
        start = two[inside][three]
        triple, p, c = _distinct(pair[inside][three], word[start + 2], len(spelled))
        out[2, start] = (_joined(crc_pair[p], after[c], length[c], tables) % BUCKETS)[triple]
        use(at, out)
    return offsets


def bucket_counts(docs: DataFrame, column: str = "text") -> DataFrame:
    """(bucket int, n long) over all features of all texts; buckets without any are not among them.

    Each task adds its texts up, so at most BUCKETS rows of each task are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)

        def add(at: int, found: np.ndarray) -> None:
            total[:] += np.bincount(found.ravel(), minlength=BUCKETS + 1)

        for rows, _, _ in pieces(batches, column):
            buckets(rows.column(column), add)
        held = np.flatnonzero(total[:BUCKETS])
        yield pa.record_batch([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(column).cast("string").alias(column)).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int]) -> np.ndarray:
    """Each bucket's gain in thousandths of a nat, from the features in it; of both tables, with one more in each bucket."""
    s_all, t_all = float(sum(source.values()) + BUCKETS), float(sum(target.values()) + BUCKETS)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((source.get(b, 0) + 1.0) * t_all))) for b in range(BUCKETS)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, column: str = "text") -> DataFrame:
    """`docs` without their texts, with n_words, n_features and weight (all long); columns of those names are replaced."""
    added = ["n_words", "n_features", "weight"]
    of_bucket = np.append(gain, 0)  # no run, no gain

    def work(rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
        totals = [np.zeros(1, np.int64)]
        offsets = buckets(rows.column(column), lambda at, found: totals.append(totals[-1][-1] + np.cumsum(of_bucket[found].sum(axis=0))))
        total, n = np.concatenate(totals), np.diff(offsets)
        weight = total[offsets[1:]] - total[offsets[:-1]]
        features = n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
        rest = [c for c in rows.schema.names if c != column]
        return pa.record_batch([*(rows.column(c) for c in rest), *(pa.array(x.astype(np.int64)) for x in (n, features, weight))], names=[*rest, *added])

    small_batches(docs.sparkSession)
    docs = docs.drop(*added).withColumn(column, F.col(column).cast("string"))
    fields = [f for f in docs.schema if f.name != column]
    return map_pieces(docs, work, T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in added)]), column)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of `docs(doc_id, text)`; the drawn ones, towards `target(text)`, have a rank.

    A score is the weight plus Gumbel noise that `seed` and doc_id fix, so the
    highest scores are a draw without replacement by weight.  Null and empty
    texts have no features, weight 0 and, with fewer words than `least_words`,
    no rank.  A null doc_id has the noise of an empty one and comes before all
    others of its score; rows alike in both are drawn in any order.  Only the counts of
    BUCKETS buckets (80 KB) reach the driver; the order is by ranges, so no
    task sees all rows.
    """
    gain = gains(*({r.bucket: r.n for r in bucket_counts(t).collect()} for t in (docs, target)))
    docs = docs.select("doc_id", "text")
    uniform = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000 * F.log(-F.log(uniform)))
    scored = written(weights(docs, gain).withColumn("score", F.col("weight") + noise), "scored")
    eligible = scored.where(F.col("n_words") >= least_words)
    drawn = percent * eligible.count() // 100
    place = ranked(eligible, [], [F.desc("score"), F.asc("doc_id")], "rank")
    place = place.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    return place.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("n_words")


def oracle_sql() -> str:
    """DuckDB SQL for op12's rows."""
    word = f"regexp_extract_all({sql.lowered("coalesce(text, '')")}, '[^{SEPARATOR[1:-2]}]+')"
    return f"""with
  texts as (select row_number() over () as r, * from (select doc_id, text, true as source from documents union all select null, text, false from benchmark)),
  lists as (select r, doc_id, source, {word} as w from texts),
  places as (select r, source, w, unnest(range(1, len(w) + 1)) as i from lists),
  runs as (select r, source, w[i] as g from places
    union all select r, source, w[i] || ' ' || w[i + 1] from places where i + 1 <= len(w)
    union all select r, source, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] from places where i + 2 <= len(w)),
  kinds as (select g, {sql.crc32("g")} % {BUCKETS} as bucket from (select distinct g from runs)),
  features as (select r, source, bucket from runs join kinds using (g)),
  counts as (select bucket, count(*) filter (where source) as s, count(*) filter (where not source) as t from features group by bucket),
  totals as (select coalesce(sum(s), 0)::double + {BUCKETS} as s_all, coalesce(sum(t), 0)::double + {BUCKETS} as t_all from counts),
  gains as (select bucket, floor(1000 * ln((t + 1)::double * s_all / ((s + 1)::double * t_all)))::bigint as gain from counts, totals),
  sums as (select r, count(*) as n_features, sum(gain)::bigint as weight from features join gains using (bucket) where source group by r),
  scored as (
    select doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
      coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id::varchar), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
    from lists left join sums using (r) where source),
  placed as (select *, row_number() over (partition by n_words >= {LEAST_WORDS} order by score desc, doc_id) as place, count(*) over (partition by n_words >= {LEAST_WORDS}) as n from scored)
select doc_id, n_features, weight, score, case when n_words >= {LEAST_WORDS} and place <= {PERCENT} * n // 100 then place end as rank
from placed"""
