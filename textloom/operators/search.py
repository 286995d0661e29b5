"""BM25, dense top-k, fusion and rerank over batches of questions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType

from ..functions import text as T
from ..sources.tables import counted, written

#: BM25's constants and the share of the mean idf that replaces negative ones.
K1, B, EPSILON = 1.5, 0.75, 0.25


def top(df: DataFrame, group: str, score: str, tie: str, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group by the score, rounded to 9 digits, and the tie-breaker."""
    by = Window.partitionBy(group).orderBy(F.round(score, 9).desc(), F.col(tie))
    return df.withColumn(rank, F.row_number().over(by)).where(F.col(rank) <= k)


@dataclass
class Index:
    """rows(id, dl, tokens, tfs) by document, terms(token, df, idf), one-row corpus(n, avgdl)."""

    rows: DataFrame
    terms: DataFrame
    corpus: DataFrame


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """A table of each document's distinct tokens, and the statistics from it; ids are unique.

    A document without tokens counts with one placeholder.
    """
    own = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).repartition("id")  # texts are no larger than their postings, which then need no shuffle to be counted
    tokens = own.select("id", T.tokens(F.col("text")).alias("tokens"))
    # explode_outer: explode would add a filter on the array, which evaluates the tokens again
    posted = tokens.select("id", F.greatest(F.size("tokens"), F.lit(1)).alias("dl"), F.explode_outer("tokens").alias("token"))
    postings = posted.groupBy("id", "dl", F.coalesce("token", F.lit("")).alias("token")).agg(F.count("*").alias("tf"))
    whole = postings.groupBy("id", "dl").agg(F.collect_list(F.struct("token", "tf")).alias("p"))  # one document's words
    rows = written(whole.select("id", "dl", F.col("p.token").alias("tokens"), F.col("p.tf").alias("tfs")), "postings")
    corpus = rows.agg(F.count("*").alias("n"), (F.sum("dl") / F.count("*")).alias("avgdl"))
    raw = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(corpus.select("n")))  # one row
    raw = raw.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg((EPSILON * F.avg("raw")).alias("floor"))
    terms = raw.crossJoin(F.broadcast(mean)).select("token", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))  # one row
    return Index(rows, terms, corpus)


def query_terms(questions: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    """query_id, token, qtf: repeated tokens count as often as they stand there."""
    return questions.select(F.col(key).alias("query_id"), F.explode(T.tokens(F.coalesce(F.col(text), F.lit("")))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))


def bm25(questions: DataFrame, held: Index, k: int = 20) -> DataFrame:
    """query_id, id, score, rank: at most k documents of positive score.

    Terms of BLOCK questions go to the tasks, each of which scores its own
    documents and keeps k of them for each question.
    """
    asked = query_terms(questions).join(held.terms, "token").groupBy("query_id").agg(F.collect_list(F.struct("token", (F.col("qtf") * F.col("idf")).alias("w"))).alias("v")).withColumnRenamed("query_id", "id")
    average = held.corpus.first().avgdl
    types = {name: df.schema[c].dataType.simpleString() for name, df, c in (("query_id", questions, "query_id"), ("id", held.rows, "id"))}

    def one(rows: list) -> DataFrame:
        token = pa.array([e.token for r in rows for e in r.v], pa.string()).dictionary_encode()
        order = np.argsort(codes := token.indices.to_numpy(), kind="stable")
        question = np.repeat(np.arange(len(rows)), [len(r.v) for r in rows])[order]
        weight = np.array([e.w for r in rows for e in r.v], float)[order]
        begins = np.searchsorted(codes[order], np.arange(len(token.dictionary) + 1))
        sent = held.rows.sparkSession.sparkContext.broadcast(([r.id for r in rows], token.dictionary, begins, question, weight))  # BLOCK questions at most

        def scores(batches: Iterator[pa.RecordBatch], n: int, words: pa.Array, begins: np.ndarray, question: np.ndarray, weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for at in range(0, batch.num_rows if n else 0, ROWS):
                    part = batch.slice(at, ROWS)
                    code = pc.index_in(part.column("tokens").flatten(), words)
                    here = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
                    row = np.repeat(np.arange(part.num_rows), part.column("tokens").value_lengths().to_numpy())[here]
                    code, tf = code.fill_null(0).to_numpy()[here], part.column("tfs").flatten().to_numpy()[here].astype(float)
                    f = tf * (K1 + 1) / (tf + K1 * (1 - B + B * part.column("dl").to_numpy()[row] / average))
                    out, seen = np.zeros(n * part.num_rows), np.zeros(n * part.num_rows, bool)
                    times = begins[code + 1] - begins[code]
                    ends = np.cumsum(times)
                    lo = 0
                    while lo < len(code):  # PAIRS pairs of a question's and a document's word at once
                        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
                        much = times[lo:hi]
                        each = np.repeat(np.arange(lo, hi), much)
                        slot = np.arange(len(each)) - np.repeat(np.cumsum(much) - much, much) + begins[code[each]]
                        flat = question[slot] * part.num_rows + row[each]
                        out += np.bincount(flat, weight[slot] * f[each], len(out))
                        seen[flat] = True
                        lo = hi
                    yield np.array(part.column("id").to_pylist()), np.where(seen & (out > 0), out, -1.0).reshape(n, -1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, *rest = sent.value
            yield from _best(scores(batches, len(ids), *rest), ids, k)

        return held.rows.where("id is not null").mapInArrow(run, f"query_id {types['query_id']}, id {types['id']}, score double")

    return top(_in_blocks(asked, one), "query_id", "score", "id", k).where("score > 0")


LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _grams(low: Column) -> Column:
    """array<string>: words, CJK characters, pairs and triples, and for each letter `letter:count`; strings explode faster than structs."""
    letters = F.array(*(F.concat(F.lit(f"{g}:"), F.octet_length(low) - F.octet_length(F.replace(low, F.lit(g)))) for g in LETTERS))
    runs = F.regexp_extract_all(low, F.lit(f"({T.CJK}+)"), F.lit(1))
    of = lambda s, n: F.transform(F.when(F.length(s) >= n, F.sequence(F.lit(1), F.length(s) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(s, i, F.lit(n)))
    cjk = F.when(low.rlike(T.CJK), F.flatten(F.transform(runs, lambda s: F.concat(*(of(s, n) for n in (1, 2, 3))))))
    return F.concat(letters, F.split(low, "[^a-z0-9]+"), F.coalesce(cjk, F.array().cast("array<string>")))


def gram_weights(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, gram, w: letters (1, counted), words of two characters and more (2); of CJK runs characters (1), pairs (2) and triples (1.5)."""
    own = docs.select(F.col(key).alias("id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low")).repartition("id")  # texts are smaller than their grams, and no later step shuffles
    found = own.select("id", F.explode_outer(_grams(F.col("low"))).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("n"))
    gram, n = F.col("gram"), F.length("gram")
    letter = F.substring("gram", 2, 1) == ":"
    each = F.when(letter, F.substring("gram", 3, 20).cast("double")).when(gram >= "\u4e00", F.when(n == 2, 2.0).when(n == 3, 1.5).otherwise(1.0)).when(n > 1, 2.0).otherwise(0.0)
    return found.select("id", F.when(letter, F.left(gram, F.lit(1))).otherwise(gram).alias("gram"), (each * F.col("n")).alias("w")).where("w > 0")


def hashed_vectors(docs: DataFrame, key: str = "doc_id", text: str = "text", dim: int = 512, digest: str = "md5") -> DataFrame:
    """id, bucket, value: signed feature hashing of 1 + ln(weight), of unit length."""
    return sparse_vectors(docs, key, text, dim, digest).select("id", F.explode("v").alias("b")).select("id", "b.bucket", "b.value")


@F.arrow_udf(returnType=BinaryType())
def blake2b_64(grams: pa.Array) -> pa.Array:
    """BLAKE2b of 8 bytes; each distinct gram of a batch is hashed once."""
    coded = grams.dictionary_encode()
    hashed = [hashlib.blake2b(g.encode(), digest_size=8).digest() for g in coded.dictionary.to_pylist()]
    return pa.array(hashed, pa.binary()).take(coded.indices)


def bucket_and_sign(gram: Column, dim: int, digest: str) -> tuple[Column, Column]:
    """Where a gram counts and which way: by `md5`, which SQL has too, or by `blake2b`, little-endian, as the reference values are."""
    if digest == "blake2b":
        h = F.hex(blake2b_64(gram))
        low = F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1)))
        odd = F.conv(F.substring(h, 9, 2), 16, 10)
    elif digest == "md5":
        low, odd = F.substring(F.md5(gram), 1, 8), F.conv(F.substring(F.md5(gram), 9, 1), 16, 10)
    else:
        raise ValueError("digest is md5 or blake2b")
    return F.conv(low, 16, 10).cast("long") % dim, F.when(odd.cast("long") % 2 == 1, 1.0).otherwise(-1.0)


def sparse_vectors(docs: DataFrame, key: str = "doc_id", text: str = "text", dim: int = 512, digest: str = "md5") -> DataFrame:
    """id, v array<struct<bucket, value>>: `hashed_vectors` with one row for each text that has any."""
    grams = gram_weights(docs, key, text)
    bucket, sign = bucket_and_sign(F.col("gram"), dim, digest)
    sums = grams.select("id", bucket.alias("bucket"), (sign * (1 + F.log("w"))).alias("v")).groupBy("id", "bucket").agg(F.sum("v").alias("v")).where("abs(v) > 1e-9")
    whole = sums.groupBy("id").agg(F.collect_list(F.struct("bucket", "v")).alias("b"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))  # `dim` buckets at most
    return whole.select("id", F.transform("b", lambda e: F.struct(e["bucket"].alias("bucket"), (e["v"] / F.col("norm")).alias("value"))).alias("v"))


#: Questions that are sent to the executors at once, rows that are scored at once, and pairs of words that are.
BLOCK, ROWS, PAIRS = 2_000, 1_000, 4_000_000


def _best(parts: Iterator[tuple[np.ndarray, np.ndarray]], asked: list, k: int) -> Iterator[pa.RecordBatch]:
    """query_id, id, score: each question's k best of (ids, scores by question and id), equal scores by id; scores below 0 are none."""
    ids = scores = None
    for mine, s in parts:
        mine = np.broadcast_to(mine, s.shape)
        ids, scores = (mine, s) if ids is None else (np.concatenate([ids, mine], axis=1), np.concatenate([scores, s], axis=1))
        order = np.lexsort((ids, -scores), axis=1)[:, :k]
        ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
    if ids is not None:
        query, at = np.nonzero(scores >= 0)
        yield pa.record_batch([pa.array([asked[i] for i in query.tolist()]), pa.array(ids[query, at].tolist()), pa.array(scores[query, at])], names=["query_id", "id", "score"])


def _in_blocks(questions: DataFrame, one: Callable[[list], DataFrame]) -> DataFrame:
    """one(rows) for every BLOCK questions; with more than one block, each one's hits are written before the next is sent."""
    out, held = None, []
    for row in questions.toLocalIterator():
        if len(held) == BLOCK:
            part, held = written(one(held), "hits"), []
            out = part if out is None else out.union(part)
        held.append(row)
    last = one(held)
    return last if out is None else out.union(last)


def dense(vectors: DataFrame, questions: DataFrame, k: int = 20) -> DataFrame:
    """query_id, id, score, rank from sparse unit vectors (id, bucket, value) or (id, v), for those that share a bucket.

    Questions are taken in blocks of BLOCK; each task keeps its own top k of
    each question from matrix products over the buckets that the block's
    questions have (the vectors' dimension at most).  Null ids have no rows.
    """
    types = {name: df.schema["id"].dataType.simpleString() for name, df in (("query_id", questions), ("id", vectors))}
    of = lambda df: df.where("id is not null") if "v" in df.columns else df.where("id is not null").groupBy("id").agg(F.collect_list(F.struct("bucket", "value")).alias("v"))
    source = of(vectors)

    def one(asked: list) -> DataFrame:
        buckets = np.unique(np.array([e.bucket for r in asked for e in r.v], np.int64))
        q = np.zeros((len(asked), len(buckets)))
        for n, r in enumerate(asked):
            q[n, np.searchsorted(buckets, [e.bucket for e in r.v])] = [e.value for e in r.v]
        sent = vectors.sparkSession.sparkContext.broadcast(([r.id for r in asked], buckets, q))  # BLOCK vectors at most

        def scores(batches: Iterator[pa.RecordBatch], buckets: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            asks = (q != 0).astype(np.float32)
            for batch in batches:
                for at in range(0, batch.num_rows if len(q) and len(buckets) else 0, ROWS):
                    part = batch.slice(at, ROWS)
                    row = np.repeat(np.arange(part.num_rows), part.column("v").value_lengths().to_numpy())
                    flat = part.column("v").flatten()
                    bucket, value = flat.field("bucket").to_numpy(), flat.field("value").to_numpy()
                    column = np.minimum(np.searchsorted(buckets, bucket), len(buckets) - 1)
                    ok = buckets[column] == bucket
                    m = np.zeros((part.num_rows, len(buckets)))
                    m[row[ok], column[ok]] = value[ok]
                    shared = asks @ (m != 0).astype(np.float32).T > 0
                    yield np.array(part.column("id").to_pylist()), np.where(shared, np.round(np.clip(q @ m.T, 0, 1), 9), -1.0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, buckets, q = sent.value
            yield from _best(scores(batches, buckets, q), ids, k)

        return source.mapInArrow(run, f"query_id {types['query_id']}, id {types['id']}, score double")

    return top(_in_blocks(of(questions), one), "query_id", "score", "id", k)


def vectors_of(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of the arrays of that length that hold finite numbers only and aren't zero."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == length)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64())
    m = flat.to_numpy(zero_copy_only=False).reshape(len(at), length)  # nulls are NaN here
    norm = np.linalg.norm(m, axis=1)
    ok = np.isfinite(norm) & (norm > 0)
    return at[ok], m[ok] / norm[ok, None]


def knn(rows: DataFrame, questions: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """query_id, id, score, rank: exact cosine top k of every question against all rows of its length; ids keep their types.

    Questions are taken in blocks of BLOCK; each task keeps its own top k of
    each question from one matrix product for each length and batch, so k rows
    of a question and task are shuffled.  Null keys and vectors that are null,
    empty, zero or not finite have no score.  `where` filters rows, not questions.
    """
    source = (rows.where(where) if where is not None else rows).where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    types = {name: df.schema[key].dataType for name, df in (("query_id", questions), ("id", rows))}
    arrow = {name: to_arrow_type(t) for name, t in types.items()}

    def one(asked: list) -> DataFrame:
        column = pa.array([r.v for r in asked], pa.list_(pa.float64()))
        lengths = sorted({len(r.v) for r in asked if r.v})
        sent = rows.sparkSession.sparkContext.broadcast({n: vectors_of(column, n) for n in lengths})  # BLOCK vectors at most

        def scores(batches: Iterator[pa.RecordBatch], held: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    ids = np.array(part.column("id").to_pylist())
                    for n, (places, q) in held.items():
                        mine, unit = vectors_of(part.column("v"), n)
                        s = np.full((len(asked_ids), len(mine)), -1.0)
                        s[places] = np.round(np.clip(q @ unit.T, 0, 1), 9)
                        yield ids[mine], s

        asked_ids = [r.id for r in asked]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for best in _best(scores(batches, sent.value), asked_ids, k):
                yield pa.record_batch([best.column(0).cast(arrow["query_id"]), best.column(1).cast(arrow["id"]), best.column(2)], names=best.schema.names)

        return source.mapInArrow(run, f"query_id {types['query_id'].simpleString()}, id {types['id'].simpleString()}, score double")

    asked = questions.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return top(_in_blocks(asked, one), "query_id", "score", "id", k)


def fuse(a: DataFrame, b: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two hit lists (query_id, id, score, rank); questions with one list get `wrap` instead.

    query_id, id, rrf, final, vector_rank, bm25_rank, position; a miss has rank -1.
    """
    both = a.select("query_id", "id", F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score")).join(b.select("query_id", "id", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score")), ["query_id", "id"], "full_outer")
    by = Window.partitionBy("query_id")
    part = lambda r: F.coalesce(1 / (k + F.col(r)), F.lit(0.0))
    rrf = part("vector_rank") + part("bm25_rank")
    single = (F.max(F.col("vector_rank")).over(by).isNull()) | (F.max(F.col("bm25_rank")).over(by).isNull())
    rank, score = F.coalesce("vector_rank", "bm25_rank"), F.coalesce("vector_score", "bm25_score")
    low, high, n = F.min(score).over(by), F.max(score).over(by), F.count("*").over(by)
    wrapped = F.round(0.6 * F.when(high == low, F.lit(1.0)).otherwise((score - low) / (high - low)) + 0.4 * (1 - (rank - 1) / n), 4)
    out = both.withColumn("rrf", rrf).withColumn("final", F.when(single, wrapped).otherwise(F.least(F.lit(1.0), F.col("rrf") / (2 / (k + 1)))))
    order = Window.partitionBy("query_id").orderBy(F.round("rrf", 9).desc(), F.col("vector_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last(), "id")
    return out.select("query_id", "id", "rrf", "final", F.coalesce("vector_rank", F.lit(-1)).alias("vector_rank"), F.coalesce("bm25_rank", F.lit(-1)).alias("bm25_rank"), F.row_number().over(order).alias("position"))


def length_score(n: Column, ideal: int = 500) -> Column:
    r = n / ideal
    return F.when(r < 0.2, 0.2).when(r < 0.5, 0.2 + (r - 0.2) / 0.3 * 0.8).when(r <= 1.5, 1.0).otherwise(F.greatest(F.lit(0.3), 1 - (r - 1.5) / 3)) if ideal > 0 else F.lit(1.0)


def phrase_share(found: Column, text: Column, total: Column) -> Column:
    """Share by length of the phrases that stand in the text; 0 for none."""
    hit = F.aggregate(found, F.lit(0), lambda a, p: a + F.when(F.contains(text, p), F.length(p)).otherwise(0))
    return F.when(total > 0, hit / total).otherwise(F.lit(0.0))


def total_length(found: Column) -> Column:
    return F.aggregate(found, F.lit(0), lambda a, p: a + F.length(p))


def number_share(asked: Column, text: Column, some: float) -> Column:
    """Share of the asked numbers that stand in the text as whole numbers; without asked ones `some` for a text with digits."""
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(T.numbers(text), asked)) / F.size(asked)).otherwise(F.when(text.rlike(T.DIGIT), some).otherwise(0.0))


def term_weights(candidates: DataFrame, group: str, tokens: str, asked: DataFrame) -> DataFrame:
    """asked(group, terms) with the map `weights`, ln((1 + n) / (1 + df)) + 1 over the group's own candidates, and their total."""
    rows = candidates.groupBy(group).agg(F.count("*").alias("n"))
    df = candidates.select(group, F.explode_outer(F.array_distinct(tokens)).alias("term")).where("term is not null").join(asked.select(group, F.explode("terms").alias("term")), [group, "term"], "left_semi").groupBy(group, "term").agg(F.count("*").alias("df"))
    each = asked.select(group, F.explode("terms").alias("term")).join(rows, group).join(df, [group, "term"], "left")
    weight = F.log((1 + F.col("n")) / (1 + F.coalesce("df", F.lit(0)))) + 1
    each = each.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("term", weight.alias("w")))).alias("weights"), F.sum(weight).alias("total"))  # one question's terms
    none = F.create_map().cast("map<string, double>")
    return asked.join(each, group, "left").withColumns({"weights": F.coalesce("weights", none), "total": F.coalesce("total", F.lit(0.0))})


def coverage(matched: Column) -> Column:
    """Share by weight of a question's terms that are `matched`; 0 without terms."""
    found = F.aggregate(matched, F.lit(0.0), lambda a, t: a + F.coalesce(F.element_at("weights", t), F.lit(0.0)))
    return F.when(F.col("total") > 0, found / F.col("total")).otherwise(F.lit(0.0))


#: Rows of a side that is broadcast.
SENT = 500_000


def spread(df: DataFrame, rows: int) -> DataFrame:
    """`df` of that many rows in parts of 200 or more, where each row is much work and the parts are fewer than the cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = min(-(-rows // 200), cores)
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts)


def sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SENT else df


def candidates(fused: DataFrame, docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """`fused` hits with the texts of docs(id, text) and their distinct tokens, as a table; texts move only where there are more than SENT hits.

    Tokens are those of known(id, tokens), as an index has them ('' stands for none there), else they are found in the texts.
    """
    hits, n = counted(fused, "fused")
    texts = docs.select("id", F.coalesce("text", F.lit("")).alias("text")).join(sent(hits.select("id").distinct(), n), "id", "left_semi")
    if known is None:
        texts = texts.withColumn("tokens", F.array_distinct(T.tokens(F.col("text"))))
    else:
        own = known.select("id", F.array_remove("tokens", "").alias("tokens")).join(sent(hits.select("id").distinct(), n), "id", "left_semi")
        texts = texts.join(own, "id")
    return spread(written(texts.join(sent(hits, n), "id"), "candidates"), n)


def rerank(rows: DataFrame, questions: DataFrame, ideal: int = 500, blend: float = 0.6) -> DataFrame:
    """Heuristic rerank of `candidates`: coverage, phrases, numbers and length, rounded to 4 digits, then blended with the fused score.

    questions(query_id, question), stripped.  The idf is that of each
    question's own candidates.
    """
    asked = questions.select("query_id", T.content_terms(T.tokens(F.col("question"))).alias("terms"), T.phrases(F.col("question"), (2, 3, 4, 6), 40, True).alias("phrases"), T.numbers(F.col("question")).alias("numbers"))
    asked = asked.withColumn("letters", total_length(F.col("phrases")))
    known, n = counted(term_weights(rows, "query_id", "tokens", asked), "weights")
    rows = rows.join(sent(known, n * 50), "query_id").withColumn("matched", F.array_intersect("terms", "tokens"))
    text = F.col("text")
    score = 0.40 * coverage(F.col("matched")) + 0.25 * phrase_share(F.col("phrases"), text, F.col("letters")) + 0.20 * number_share(F.col("numbers"), text, 0.5) + 0.15 * length_score(F.length(text), ideal)
    out = rows.withColumn("rerank", F.round(score, 4)).withColumn("score", F.round((1 - blend) * F.col("final") + blend * F.col("rerank"), 4))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "position")
    return out.select("query_id", "id", "tokens", "final", "rerank", "score", F.row_number().over(order).alias("rank"))


def drop_similar(hits: DataFrame, most: float = 0.85, threshold: float = 0.0, k: int = 5) -> DataFrame:
    """Greedy near-duplicate removal in rank order (at most 2 x fetch rows of a question), then threshold and cut.

    Scores fall with the rank, so the fold ends at k kept rows.
    """
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", "tokens"))).alias("rows"))
    size = lambda r: F.size(r["tokens"])
    # sets of very different sizes can't be similar, and need no look at their tokens
    alike = lambda o, r: (F.least(size(o), size(r)) > most * F.greatest(size(o), size(r))) & (T.jaccard(o["tokens"], r["tokens"]) > most)
    kept = F.aggregate("rows", F.slice("rows", 1, 0), lambda a, r: F.when((F.size(a) >= k) | F.exists(a, lambda o: alike(o, r)), a).otherwise(F.concat(a, F.array(r))))
    left = rows.select("query_id", F.posexplode(F.filter(kept, lambda r: r["score"] >= threshold) if threshold > 0 else kept).alias("at", "r")).where(F.col("at") < k)
    return left.select("query_id", (F.col("at") + 1).alias("rank"), "r.id", "r.score")
