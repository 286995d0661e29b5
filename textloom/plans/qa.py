"""Questions to answers as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers as A
from ..operators import search as S
from ..sources.tables import counted, written


@dataclass
class Corpus:
    """docs(id, text, ...) with their BM25 index and sparse vectors, both tables, and the digest of the latter."""

    docs: DataFrame
    index: S.Index
    vectors: DataFrame
    digest: str = "md5"


def corpus(docs: DataFrame, key: str = "doc_id", digest: str = "md5") -> Corpus:
    """What `hits` searches; made once for any number of questions."""
    own = docs.withColumnRenamed(key, "id")
    return Corpus(own, S.index(own, "id"), written(S.sparse_vectors(own, "id", digest=digest), "vectors"), digest)


def asked_of(questions: DataFrame) -> DataFrame:
    """query_id, question of questions(query_id, text), stripped; blank ones have no hits."""
    return questions.select("query_id", T.strip(F.col("text")).alias("question")).where("question <> ''")


def hits(held: Corpus, questions: DataFrame, fetch: int = 20, hybrid: bool = True, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Dense and lexical hits, both tables; `where` filters documents on the dense side alone."""
    asked = asked_of(questions).withColumnRenamed("question", "text")
    vectors = held.vectors if where is None else held.vectors.join(held.docs.where(where).select("id"), "id", "left_semi")
    dense = written(S.dense(vectors, S.sparse_vectors(asked, "query_id", digest=held.digest), fetch), "dense")
    return dense, written(S.bm25(asked, held.index, fetch), "lexical") if hybrid else dense.limit(0)


def ranked(held: Corpus, questions: DataFrame, found: tuple[DataFrame, DataFrame], k: int = 5, reranked: bool = True, threshold: float = 0.0) -> DataFrame:
    """query_id, rank, id, score: fused hits, with `reranked` by their texts, without near-duplicates, those over the threshold."""
    rows = S.candidates(S.fuse(*found), held.docs, held.index.rows)
    if reranked:
        rows = S.rerank(rows, asked_of(questions))
    else:
        rows = rows.withColumnsRenamed({"position": "rank", "final": "score"})
    return S.drop_similar(rows, k=k, threshold=threshold)


def retrieve(held: Corpus, questions: DataFrame, k: int = 5, fetch: int | None = None, hybrid: bool = True, reranked: bool = True, where: Column | None = None, threshold: float = 0.0) -> DataFrame:
    """query_id, rank, id, score for questions(query_id, text); `fetch` hits of each kind, 20 or k if that is more."""
    return ranked(held, questions, hits(held, questions, fetch or max(20, k), hybrid, where), k, reranked, threshold)


def counters(questions: DataFrame, found: tuple[DataFrame, DataFrame], kept: DataFrame, hybrid: bool = True, reranked: bool = True) -> DataFrame:
    """query_id, vector_hits, bm25_hits, fused, kept, reranked, used_hybrid, used_rerank, note: what each question's search went through.

    `reranked` is what was returned, as `kept`; `empty_query` and `no_hits` say why there is nothing.
    """
    count = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    union = found[0].select("query_id", "id").union(found[1].select("query_id", "id")).distinct()
    out = questions.select("query_id", (T.strip(F.coalesce("text", F.lit(""))) == "").alias("blank"))
    for df, name in ((found[0], "vector_hits"), (found[1], "bm25_hits"), (union, "fused"), (kept, "kept")):
        out = out.join(count(df, name), "query_id", "left")
    out = out.fillna(0, ["vector_hits", "bm25_hits", "fused", "kept"])
    note = F.when(F.col("blank"), "empty_query").when(F.col("fused") == 0, "no_hits")
    used = (F.lit(hybrid) & ~F.col("blank")).alias("used_hybrid"), (F.lit(reranked) & (F.col("fused") > 0)).alias("used_rerank")
    return out.select("query_id", "vector_hits", "bm25_hits", "fused", "kept", F.col("kept").alias("reranked"), *used, note.alias("note"))


def blocks(found: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, block, score, and the columns of docs(id, text, ...) for ranked hits, as a table."""
    found, n = counted(found, "ranked")
    rows = docs.join(S.sent(found, n), "id").select("query_id", F.col("rank").alias("block"), "score", *docs.columns)
    return S.spread(written(rows, "blocks"), n)


@dataclass
class Answered:
    """blocks, their scored sentences, gate per question, outcome (answer, refused, reason) and citations."""

    blocks: DataFrame
    found: DataFrame
    gates: DataFrame
    answers: DataFrame
    citations: DataFrame


def answer(held: Corpus, questions: DataFrame, k: int = 5) -> Answered:
    """From questions(query_id, text) to answers with citations, or refusals with their reason."""
    return answer_from(blocks(retrieve(held, questions, k), held.docs), questions)


def answer_from(found: DataFrame, questions: DataFrame) -> Answered:
    """`answer` from blocks(query_id, block, score, id, text) that are already there."""
    asked = questions.select("query_id", T.strip(F.coalesce("text", F.lit(""))).alias("question"))
    scored = written(A.evidence(found, asked), "evidence")
    gates = A.gate(scored, asked)
    out = A.outcome(A.answer(scored, gates), found)
    return Answered(found, scored, gates, out, A.citations(out, found))
