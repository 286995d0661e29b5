"""Every query of the library outside the subpackage llm, with its DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import ann
from .operators import answers as A
from .operators import chunking as C
from .operators import collections as M
from .operators import prompts
from .operators import search as S
from .operators.postings import Postings
from .plans import ingest, qa
from .sources import store
from .sources.tables import shared_dir, written

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = (f, sql)
        return f

    return add


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def questions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def gold_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a question's text, found by that of its tokens which the fewest documents have, and then in full.

    A word at either end may go on in the document, so inner tokens come first
    where there are any.  Texts are read again for the candidates alone.
    """
    docs, asked = docs_of(spark, sf_dir), questions_of(spark, sf_dir)
    inner = T.tokens(F.regexp_replace("text", "^[A-Za-z0-9_]+|[A-Za-z0-9_]+$", ""))
    terms = asked.select("query_id", F.explode(F.array_distinct(F.when(F.size(inner) > 0, inner).otherwise(T.tokens(F.col("text"))))).alias("token"))
    words = docs.select("doc_id", F.explode_outer(F.array_distinct(T.tokens(F.col("text")))).alias("token")).join(terms.select("token").distinct(), "token", "left_semi")
    df = words.groupBy("token").agg(F.count("*").alias("df"))
    rare = terms.join(df, "token", "left").groupBy("query_id").agg(F.min_by("token", F.struct(F.coalesce("df", F.lit(0)), "token")).alias("token"))
    near = words.join(rare, "token").select("query_id", "doc_id")
    found = near.join(docs.select("doc_id", "text"), "doc_id").join(asked.withColumnRenamed("text", "q"), "query_id")
    return found.where(F.contains("text", F.col("q"))).select("query_id", F.col("doc_id").alias("id")).distinct()


#: White space as the library sees it, for RE2.
_SPACE = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_STRIP = f"regexp_replace({{0}}, '^{_SPACE.replace('{', '{{').replace('}', '}}')}+|{_SPACE.replace('{', '{{').replace('}', '}}')}+$', '', 'g')"
_SOLID = "length(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
_NUMBERS = "list_distinct(regexp_extract_all({0}, '\\p{{Nd}}+(?:\\.\\p{{Nd}}+)?'))"
TOKENS = "list_transform(list_filter(regexp_extract_all({0}, '[A-Za-z0-9_]+'), lambda w: length(w) > 1 or regexp_full_match(w, '[0-9]')), lambda w: lower(w))"
#: Text as the tokenizer takes it where it holds no CJK, as in these tables.
_BM25 = f"""
tok AS (SELECT doc_id AS id, CASE WHEN len(t) > 0 THEN t ELSE [''] END AS t FROM (SELECT doc_id, {TOKENS.format("coalesce(text, '')")} AS t FROM documents)),
post AS (SELECT id, len(t) AS dl, unnest(t) AS token FROM tok),
tf AS (SELECT id, dl, token, count(*) AS tf FROM post GROUP BY ALL),
corpus AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
raw AS (SELECT token, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, corpus),
terms AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT item_id AS query_id, token, count(*) AS qtf FROM (SELECT item_id, unnest({TOKENS.format("text")}) AS token FROM benchmark) GROUP BY ALL),
bm AS (SELECT query_id, id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN qt USING (token) JOIN terms USING (token), corpus GROUP BY ALL),
bm25 AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM bm) WHERE rank <= 20 AND score > 0)"""
_GRAMS = """SELECT id, gram, sum(w) AS w FROM (
  SELECT id, unnest(string_split(w, '')) AS gram, 1.0::DOUBLE AS w FROM {0}words UNION ALL SELECT id, w, 2.0 FROM {0}words WHERE length(w) > 1) WHERE gram <> '' GROUP BY ALL"""


def _vectors(source: str, key: str, name: str) -> str:
    return f"""
{name}words AS (SELECT {key} AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS w FROM {source}),
{name}grams AS ({_GRAMS.format(name)}),
{name}hash AS (SELECT id, (('0x' || substr(md5(gram), 1, 8))::BIGINT) % 512 AS bucket, CASE WHEN (('0x' || substr(md5(gram), 9, 1))::BIGINT) % 2 = 1 THEN 1.0 ELSE -1.0 END::DOUBLE * (1 + ln(w)) AS v FROM {name}grams),
{name}sum AS (SELECT id, bucket, sum(v) AS v FROM {name}hash GROUP BY ALL HAVING abs(sum(v)) > 1e-9),
{name}vec AS (SELECT id, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS value FROM {name}sum)"""


@query(f"SELECT doc_id, len(t)::BIGINT AS n, sha256(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)")
def tokenize(spark, sf_dir):
    t = T.tokens(F.col("text"))
    return docs_of(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n"), F.sha2(F.array_join(t, " "), 256).alias("digest"))


@query("SELECT doc_id, sha256(text)[:16] AS hash FROM documents")
def content_hash_ids(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query("SELECT doc_id, length(s) < 15 OR length(regexp_replace(s, '[^A-Za-z0-9一-鿿]', '', 'g')) / length(s) < 0.3 AS noise FROM (SELECT doc_id, regexp_replace(text, '\\s', '', 'g') AS s FROM documents)")
def noise_filter(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", T.is_noise(F.col("text")).alias("noise"))


@query("SELECT doc_id, round(length(regexp_replace(s, '[^一-鿿]', '', 'g')) / length(s), 6) AS ratio FROM (SELECT doc_id, regexp_replace(text, '\\s', '', 'g') AS s FROM documents)")
def char_ratio(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.round(T.cjk_ratio(F.col("text")), 6).alias("ratio"))


@query("SELECT doc_id, CASE WHEN length(t) <= 180 THEN t ELSE rtrim(t[:179], E' \\t\\n\\r') || '…' END AS snippet FROM (SELECT doc_id, trim(text, E' \\t\\n\\r') AS t FROM documents)")
def truncate_snippet(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", T.truncate(F.col("text"), 180).alias("snippet"))


@query(f"SELECT doc_id, len(n)::BIGINT AS n, array_to_string(n, ' ') AS numbers FROM (SELECT doc_id, list_sort({_NUMBERS.format('text')}) AS n FROM documents)")
def numbers(spark, sf_dir):
    n = F.array_sort(T.numbers(F.col("text")))
    return docs_of(spark, sf_dir).select("doc_id", F.size(n).cast("long").alias("n"), F.array_join(n, " ").alias("numbers"))


def _sentences(source: str, keys: str, name: str) -> str:
    """CTEs that end in `name`: keys, at, sentence; short parts go to the next longer one, the last to the one before."""
    return f"""
{name}p AS (SELECT {keys}, i, {_STRIP.format("x")} AS s FROM (SELECT {keys}, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT {keys}, string_split(regexp_replace(coalesce(text, ''), '([。！？；!?;])', E'\\\\1\\n', 'g'), E'\\n') AS l FROM {source}))),
{name}l AS (SELECT *, ({_SOLID.format("s")} >= 6)::INT AS long FROM {name}p WHERE s <> ''),
{name}g AS (SELECT *, least(coalesce(sum(long) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), greatest(sum(long) OVER (PARTITION BY {keys}) - 1, 0)) AS g FROM {name}l),
{name} AS (SELECT {keys}, g::BIGINT AS spot, string_agg(s, '' ORDER BY i) AS sentence FROM {name}g GROUP BY {keys}, g)"""


@query(f"WITH {_sentences('documents', 'doc_id', 's').strip()} SELECT doc_id, spot AS \"at\", sentence FROM s")
def sentence_split(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.posexplode_outer(T.sentences(F.col("text"))).alias("at", "sentence")).where("sentence is not null").withColumn("at", F.col("at").cast("long"))


@query("WITH p AS (SELECT item_id, unnest([2, 3, 4, 6]) AS n, text FROM benchmark), g AS (SELECT item_id, n, unnest(range(1, length(text) - n + 2)) AS i, text FROM p), s AS (SELECT item_id, n, i, substr(text, i, n) AS s FROM g), d AS (SELECT item_id, s, min((n, i)) AS o FROM s WHERE trim(s, E' \\n\\t') <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY o) AS k FROM d) SELECT item_id, string_agg(s, '|' ORDER BY k) AS phrases FROM r WHERE k <= 40 GROUP BY item_id")
def phrases(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.phrases(F.col("text"), (2, 3, 4, 6), 40, True), "|").alias("phrases"))


@query("SELECT page_id, CASE WHEN n = '' THEN 'unnamed' ELSE n END AS name FROM (SELECT page_id, regexp_replace(regexp_extract(regexp_replace(url, '(/+\\.?)+$', ''), '([^/]*)$', 1), '[^\\p{L}\\p{N}_.\\-]', '_', 'g')[:120] AS n FROM pages)")
def safe_filenames(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.safe_filename(F.col("url")).alias("name"))


@query("SELECT conv_id, turn, trim(text, E' \\t\\n\\r') = '' OR contains(trim(text, E' \\t\\n\\r')[:80], '根据现有知识库无法回答') OR contains(trim(text, E' \\t\\n\\r')[:80], '根据现有资料无法回答') OR contains(trim(text, E' \\t\\n\\r')[:80], '无法根据现有资料') OR text IS NULL AS refused FROM conversations")
def refusal_markers(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_refusal(F.col("text")).alias("refused"))


@query()
def normalize_text(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", T.normalize(F.col("text")).alias("text"))


_WINDOWS = "w AS (SELECT doc_id, source, unnest(range(0, greatest(ceil((length(text) - 80) / 420.0)::BIGINT, 1))) AS chunk_index, text FROM documents WHERE length(text) > 0), chunks AS (SELECT doc_id, source, chunk_index, chunk_index * 420 AS start_index, substr(text, chunk_index * 420 + 1, 500) AS text FROM w)"


@query(f"WITH {_WINDOWS} SELECT doc_id, chunk_index, start_index, text, sha256(doc_id || ':' || chunk_index || ':' || text)[:16] AS chunk_id FROM chunks")
def window_chunks(spark, sf_dir):
    return M.windows(docs_of(spark, sf_dir))


@query(f"WITH {_WINDOWS} SELECT source, count(*) AS chunks, sum(length(text))::BIGINT AS chars, floor(sum(length(text)) / count(*))::BIGINT AS mean_chars, CASE WHEN mean_chars < 250 THEN 'small' WHEN mean_chars > 550 THEN 'large' ELSE 'fine' END AS advice FROM chunks GROUP BY ROLLUP (source)")
def chunk_stats_rollup(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    return M.chunk_stats(M.windows(docs).join(docs.select("doc_id", "source"), "doc_id"))


_PAGES = "u AS (SELECT conv_id AS doc_id, turn AS page, length(trim(text, E' \\t\\n\\r')) AS n FROM conversations WHERE trim(text, E' \\t\\n\\r') <> ''), p AS (SELECT doc_id, page, coalesce(sum(n + 2) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b, n FROM u), o AS (SELECT DISTINCT doc_id, unnest(range(0, m + 50, 50)) AS at FROM (SELECT doc_id, max(b + n) AS m FROM p GROUP BY 1))"


@query(f"WITH {_PAGES} SELECT o.doc_id, o.at, coalesce((SELECT page FROM p WHERE p.doc_id = o.doc_id AND o.at >= b AND o.at < b + n), (SELECT max(page) FROM p WHERE p.doc_id = o.doc_id)) AS page FROM o")
def page_lookup(spark, sf_dir):
    units = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    pages = M.pages_of(units)
    offsets = pages.groupBy("doc_id").agg(F.max("end").alias("m")).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), (F.ceil((F.col("m") + 50) / 50) * 50 - 50).cast("long"), F.lit(50).cast("long"))).alias("at"))
    return M.page_lookup(offsets, pages)


@query()
def recursive_chunks(spark, sf_dir):
    return C.recursive_chunks(docs_of(spark, sf_dir))


@query(f"""WITH RECURSIVE {_WINDOWS}, t AS MATERIALIZED (SELECT *, sha256(doc_id || ':' || chunk_index || ':' || text)[:16] AS chunk_id, list_distinct({TOKENS.format('text')}) AS k FROM chunks),
near AS MATERIALIZED (SELECT a.doc_id, a.chunk_index, list(b.chunk_index) AS l FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.chunk_index < a.chunk_index AND least(len(a.k), len(b.k)) > 0.9 * greatest(len(a.k), len(b.k)) AND len(list_intersect(a.k, b.k)) > 0.9 * (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k))) GROUP BY ALL),
last AS (SELECT doc_id, max(chunk_index) AS m FROM t GROUP BY 1),
walk AS (SELECT doc_id, m, 0::BIGINT AS i, [0::BIGINT] AS kept FROM last UNION ALL
  SELECT w.doc_id, w.m, w.i + 1, CASE WHEN len(list_intersect(coalesce(n.l, []), w.kept)) > 0 THEN w.kept ELSE list_append(w.kept, w.i + 1) END FROM walk w LEFT JOIN near n ON n.doc_id = w.doc_id AND n.chunk_index = w.i + 1 WHERE w.i < w.m),
kept AS (SELECT doc_id, unnest(kept) AS chunk_index FROM walk WHERE i = m)
SELECT doc_id, chunk_index, start_index, text, chunk_id FROM t JOIN kept USING (doc_id, chunk_index)""")
def greedy_near_dup(spark, sf_dir):
    return C.drop_near_chunks(M.windows(docs_of(spark, sf_dir)))


@query("SELECT sha256(text)[:16] AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def exact_dedup(spark, sf_dir):
    return M.exact_dedup(docs_of(spark, sf_dir))


@query(f"SELECT item_id // 5 AS query_id, (item_id % 5 + 1)::INTEGER AS block, {_STRIP.format('text')} AS text, {_STRIP.format("concat('What of ', min(text) OVER (PARTITION BY item_id // 5), '?')")} AS question FROM benchmark")
def prompt_blocks(spark, sf_dir):
    """Benchmark passages, five to a prompt, taken out of the prompts again."""
    items = table(spark, sf_dir, "benchmark").select(F.expr("item_id div 5").alias("query_id"), (F.col("item_id") % 5 + 1).cast("int").alias("block"), "text", F.lit("benchmark").alias("source"), F.col("item_id").alias("page"))
    asked = items.groupBy("query_id").agg(F.concat(F.lit("What of "), F.min("text"), F.lit("?")).alias("question"))
    rows = prompts.parsed(prompts.prompts(asked, items))
    return rows.select("query_id", "question", F.inline("blocks"))


@query(f"WITH {_WINDOWS} SELECT doc_id::VARCHAR AS doc_id, count(*) AS chunks, arg_min(source, chunk_index) AS source FROM chunks GROUP BY 1")
def list_documents(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    return M.listing(M.windows(docs).join(docs.select("doc_id", "source"), "doc_id"))


@query("SELECT source, count(*) AS chunks, count(DISTINCT doc_id) AS documents FROM documents GROUP BY ROLLUP (source)")
def collection_summary(spark, sf_dir):
    return M.summary(docs_of(spark, sf_dir))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def skip_existing(spark, sf_dir):
    return M.new_only(docs_of(spark, sf_dir).select("doc_id", "source"), table(spark, sf_dir, "labels"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.n_chars ELSE l.q END AS value FROM documents d LEFT JOIN (SELECT doc_id, max(quality)::BIGINT AS q FROM labels GROUP BY 1) l USING (doc_id)")
def upsert(spark, sf_dir):
    new = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("value"), F.col("quality").alias("version"))
    old = docs_of(spark, sf_dir).select("doc_id", F.col("n_chars").alias("value"), F.lit(0).alias("version"))
    return M.upsert(old, new, "doc_id").select("doc_id", "value")


@query("SELECT doc_id::VARCHAR AS chunk_id, coalesce(CASE WHEN l.doc_id IS NOT NULL THEN 'labelled' END, source) AS source, l.quality FROM documents LEFT JOIN labels l USING (doc_id) WHERE lang <> 'de' OR lang IS NULL UNION ALL SELECT concat('b', item_id), 'benchmark', NULL FROM benchmark")
def collection_log(spark, sf_dir):
    """The last version of a collection after an upsert, one of other columns, a delete and an append."""
    docs, labels = docs_of(spark, sf_dir), table(spark, sf_dir, "labels")
    held = store.Collection(spark, shared_dir(spark), f"collection-{uuid.uuid4().hex}")
    held.upsert(docs.select(F.col("doc_id").cast("string").alias("chunk_id"), "source"))
    known = labels.join(docs.select("doc_id"), "doc_id", "left_semi")
    held.upsert(known.select(F.col("doc_id").cast("string").alias("chunk_id"), F.lit("labelled").alias("source"), "quality"))
    held.delete(docs.where("lang = 'de'").select(F.col("doc_id").cast("string").alias("chunk_id")))
    held.append(table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("chunk_id"), F.lit("benchmark").alias("source")))
    return held.scan()


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_document(spark, sf_dir):
    return M.delete(docs_of(spark, sf_dir).select("doc_id", "lang"), table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"))


@query("SELECT conv_id, turn, role, text, back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 6")
def last_n_turns(spark, sf_dir):
    return M.last_turns(table(spark, sf_dir, "conversations")).withColumn("back", F.col("back").cast("long"))


@query("""WITH t AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM conversations),
p AS (SELECT conv_id, no, min(turn) AS turn, coalesce(string_agg(text, E'\\n' ORDER BY turn) FILTER (role = 'user'), '') AS q, coalesce(string_agg(text, E'\\n' ORDER BY turn) FILTER (role = 'assistant'), '') AS a FROM t WHERE no > 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM p)
SELECT conv_id, string_agg('用户：' || q || E'\\n助手：' || CASE WHEN length(a) > 200 THEN a[:200] || '…' ELSE a END, E'\\n' ORDER BY turn) AS history FROM r WHERE back <= 6 GROUP BY conv_id""")
def history_format(spark, sf_dir):
    return M.history(M.exchanges(table(spark, sf_dir, "conversations")))


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 120 MINUTE THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*) AS events, min(ts) AS begin, max(ts) AS \"end\" FROM s GROUP BY 1, 2")
def ttl_sessions(spark, sf_dir):
    return M.ttl_sessions(table(spark, sf_dir, "events"))


@query(f"WITH {_BM25.strip()} SELECT token, df, round(idf, 6) AS idf FROM terms")
def bm25_terms(spark, sf_dir):
    return S.index(docs_of(spark, sf_dir)).terms.select("token", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_BM25.strip()} SELECT query_id, id, round(score, 6) AS score, rank FROM bm25 WHERE rank <= 5")
def bm25_topk(spark, sf_dir):
    hits = S.bm25(questions_of(spark, sf_dir), S.index(docs_of(spark, sf_dir)), 5)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _postings(spark) -> Postings:
    return Postings(spark, f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}")


def _pruned(spark, sf_dir, held: Postings):
    hits = held.search(questions_of(spark, sf_dir), 5).hits
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_BM25.strip()} SELECT query_id, id, round(score, 6) AS score, rank FROM bm25 WHERE rank <= 5")
def bm25_topk_pruned(spark, sf_dir):
    """bm25_topk from posting blocks, without those whose bound is too low."""
    held = _postings(spark)
    held.add(docs_of(spark, sf_dir))
    return _pruned(spark, sf_dir, held)


@query(f"WITH {_BM25.strip().replace('FROM documents)', "FROM documents WHERE lang <> 'de' OR lang IS NULL)")} SELECT query_id, id, round(score, 6) AS score, rank FROM bm25 WHERE rank <= 5")
def bm25_topk_deltas(spark, sf_dir):
    """bm25_topk without the German documents, from an index that got half of all, then others' texts, then all again, and lost those."""
    held, docs = _postings(spark), docs_of(spark, sf_dir)
    held.add(docs.where("doc_id % 2 = 0"))
    held.add(docs.where("doc_id % 3 = 0").withColumn("text", F.lit("an older text")))
    held.delete(docs.where("lang = 'de'"))
    held.add(docs.where("doc_id % 2 = 1 or doc_id % 3 = 0"))
    held.delete(docs.where("lang = 'de'"))
    return _pruned(spark, sf_dir, held)


@query(f"WITH {_vectors('documents', 'doc_id', 'd').strip()} SELECT id, gram, w FROM dgrams")
def ngram_weights(spark, sf_dir):
    return S.gram_weights(docs_of(spark, sf_dir))


@query(f"WITH {_vectors('documents', 'doc_id', 'd').strip()} SELECT id, bucket, round(value, 6) AS value FROM dvec")
def hash_embedding(spark, sf_dir):
    return S.hashed_vectors(docs_of(spark, sf_dir)).select("id", "bucket", F.round("value", 6).alias("value"))


_KNN = "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings{0}), s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(greatest(0, least(1, list_cosine_similarity(q.e, v.e))), 9) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0) q, v), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 20"


def _knn(spark, sf_dir, where=None):
    rows = table(spark, sf_dir, "embeddings")
    return S.knn(rows, rows.where("vec_id % 50 = 0"), 20, where=where).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_KNN.format(""))
def vector_topk(spark, sf_dir):
    return _knn(spark, sf_dir)


@query(_KNN.format(" WHERE label = 3"))
def vector_topk_filtered(spark, sf_dir):
    return _knn(spark, sf_dir, M.where_equal(label=3))


@query(_KNN.format(""))
def ann_topk_exact(spark, sf_dir):
    """vector_topk by the inverted file, whose bounds rule out the cells and rows that it doesn't read."""
    rows = table(spark, sf_dir, "embeddings")
    hits = ann.search(ann.build(rows, ann.fit(rows)), rows.where("vec_id % 50 = 0"), 20, exact=True)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_KNN.format("").replace("SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 20", "SELECT count(*) AS wanted, true AS enough FROM r WHERE rank <= 10"))
def ann_recall(spark, sf_dir):
    """Pairs of the exact top ten, and whether the approximate search, with as many probes as it tunes itself to, finds nine tenths of them."""
    rows = table(spark, sf_dir, "embeddings")
    asked, index = rows.where("vec_id % 50 = 0"), ann.build(rows, ann.fit(rows))
    found = ann.recall(ann.search(index, asked, 10, probes=ann.tune(index)), S.knn(rows, asked, 10))
    return found.select("wanted", (F.col("recall") >= 0.9).alias("enough"))


_FUSED = f"""WITH RECURSIVE {_BM25.strip()}, {_vectors("documents", "doc_id", "d").strip()}, {_vectors("benchmark", "item_id", "q").strip()},
dn AS (SELECT q.id AS query_id, d.id, greatest(0, least(1, sum(d.value * q.value))) AS score FROM dvec d JOIN qvec q USING (bucket) GROUP BY ALL),
dense AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM dn) WHERE rank <= 20),
f AS (SELECT query_id, id, a.rank AS vr, b.rank AS br, coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + b.rank), 0) AS rrf FROM dense a FULL JOIN bm25 b USING (query_id, id))"""


@query(_FUSED + " SELECT query_id, id, round(rrf, 6) AS rrf, round(least(1, rrf / (2 / 61.0)), 6) AS final, coalesce(vr, -1) AS vector_rank, coalesce(br, -1) AS bm25_rank FROM f")
def rrf_fusion(spark, sf_dir):
    docs, asked = docs_of(spark, sf_dir), questions_of(spark, sf_dir)
    out = S.fuse(*qa.hits(qa.corpus(docs), asked))
    return out.select("query_id", "id", F.round("rrf", 6).alias("rrf"), F.round("final", 6).alias("final"), F.col("vector_rank").cast("long").alias("vector_rank"), F.col("bm25_rank").cast("long").alias("bm25_rank"))


@query("SELECT doc_id, round(CASE WHEN r < 0.2 THEN 0.2 WHEN r < 0.5 THEN 0.2 + (r - 0.2) / 0.3 * 0.8 WHEN r <= 1.5 THEN 1.0 ELSE greatest(0.3, 1 - (r - 1.5) / 3) END::DOUBLE, 6) AS score FROM (SELECT doc_id, length(text) / 500.0::DOUBLE AS r FROM documents)")
def length_score(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.round(S.length_score(F.length("text")), 6).alias("score"))


def _grams(lengths: str, text: str) -> str:
    """Substrings of the lengths that aren't blank, in order."""
    return f"list_filter(flatten(list_transform({lengths}, lambda n: list_transform(range(1, greatest(length({text}) - n + 2, 1)), lambda i: substr({text}, i, n)))), lambda s: {_STRIP.format('s')} <> '')"


def _share(values: str, test: str, weight: str) -> str:
    part = lambda l: f"coalesce(list_sum(list_transform({l}, lambda v: {weight})), 0)"
    return f"coalesce({part(f'list_filter({values}, lambda v: {test})')} / nullif({part(values)}, 0), 0)"


def _numbers(text: str, some: float) -> str:
    return f"CASE WHEN len(numbers) > 0 THEN len(list_intersect({_NUMBERS.format(text)}, numbers)) / len(numbers) WHEN regexp_matches({text}, '\\p{{Nd}}') THEN {some} ELSE 0 END"


def _terms(rows: str, name: str) -> str:
    """CTEs that end in `name`: query_id, terms, weights (list of structs) over the question's own rows(query_id, tokens)."""
    return f"""
{name}t AS (SELECT query_id, unnest(terms) AS term FROM asked),
{name}n AS (SELECT query_id, count(*) AS n FROM {rows} GROUP BY 1),
{name}d AS (SELECT query_id, term, count(*) AS df FROM (SELECT query_id, unnest(tokens) AS term FROM {rows}) GROUP BY ALL),
{name} AS MATERIALIZED (SELECT query_id, list({{'t': term, 'w': ln((1 + n) / (1 + coalesce(df, 0))) + 1}}) AS weights FROM {name}t JOIN {name}n USING (query_id) LEFT JOIN {name}d USING (query_id, term) GROUP BY query_id)"""


_LENGTH = "CASE WHEN r < 0.2 THEN 0.2 WHEN r < 0.5 THEN 0.2 + (r - 0.2) / 0.3 * 0.8 WHEN r <= 1.5 THEN 1.0 ELSE greatest(0.3, 1 - (r - 1.5) / 3) END::DOUBLE"
_ASKED = f"""
named AS (SELECT item_id AS query_id, {_STRIP.format("text")} AS question FROM benchmark),
words AS MATERIALIZED (SELECT *, list_distinct({TOKENS.format("question")}) AS k, {_grams("[2, 3, 4, 6]", "question")} AS g FROM named),
asked AS MATERIALIZED (SELECT query_id, question, CASE WHEN len(list_filter(k, lambda w: length(w) > 1)) > 0 THEN list_filter(k, lambda w: length(w) > 1) ELSE k END AS terms, list_filter(g, lambda v, i: list_position(g, v) = i)[:40] AS phrases, {_grams("[2, 3, 4]", "question")}[:30] AS short, {_NUMBERS.format("question")} AS numbers FROM words)"""
#: From the fused hits (those of `fused`, in order of `position`) to the five blocks of a question; `score` is what they are ordered by.
_CANDIDATES = f"""
place AS (SELECT *, least(1, rrf / (2 / 61.0)) AS final, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, vr NULLS LAST, br NULLS LAST, id) AS position FROM f),
cand AS MATERIALIZED (SELECT place.*, text, list_distinct({TOKENS.format("coalesce(text, '')")}) AS tokens FROM place JOIN documents ON doc_id = id)"""
_RERANKED = f"""{_terms("cand", "cw")},
scored AS (SELECT *, round(0.40 * {_share("weights", "list_contains(tokens, v.t)", "v.w")} + 0.25 * {_share("phrases", "contains(text, v)", "length(v)::DOUBLE")} + 0.20 * ({_numbers("text", 0.5)}) + 0.15 * {_LENGTH}, 4) AS rerank FROM (SELECT c.*, phrases, numbers, weights, length(text) / 500.0::DOUBLE AS r FROM cand c JOIN asked USING (query_id) LEFT JOIN cw USING (query_id))),
hit AS MATERIALIZED (SELECT query_id, id, text, tokens, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS rank FROM (SELECT *, round(0.4 * final + 0.6 * rerank, 4) AS score FROM scored))"""


def _deduped(hit: str, name: str) -> str:
    """CTEs that end in `name`: query_id, block, id, score of the first five of `hit` that aren't like an earlier one kept."""
    return f"""
{name}near AS MATERIALIZED (SELECT a.query_id, a.rank, list(b.rank) AS l FROM {hit} a JOIN {hit} b ON a.query_id = b.query_id AND b.rank < a.rank AND least(len(a.tokens), len(b.tokens)) > 0.85 * greatest(len(a.tokens), len(b.tokens)) AND len(list_intersect(a.tokens, b.tokens)) / (len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens))) > 0.85 GROUP BY ALL),
{name}walk AS (SELECT query_id, count(*) AS m, 0::BIGINT AS i, []::BIGINT[] AS kept FROM {hit} GROUP BY 1 UNION ALL
  SELECT w.query_id, m, i + 1, CASE WHEN len(list_intersect(coalesce(n.l, []), kept)) > 0 THEN kept ELSE list_append(kept, i + 1) END FROM {name}walk w LEFT JOIN {name}near n ON n.query_id = w.query_id AND n.rank = i + 1 WHERE i < m),
{name} AS MATERIALIZED (SELECT query_id, block, id, score FROM (SELECT query_id, unnest(kept) AS rank, generate_subscripts(kept, 1) AS block FROM {name}walk WHERE i = m) JOIN {hit} USING (query_id, rank) WHERE block <= 5)"""


_HYBRID = f"{_FUSED},{_ASKED},{_CANDIDATES},{_RERANKED},{_deduped('hit', 'found')}"
_SCORED = f"""{_HYBRID},
blocks AS MATERIALIZED (SELECT found.*, text, source, list_distinct({TOKENS.format("coalesce(text, '')")}) AS tokens FROM found JOIN documents ON doc_id = id),
{_terms("blocks", "bw").strip()},
{_sentences("blocks", "query_id, block, id", "sent").strip()},
own AS (SELECT *, {_SOLID.format("sentence")} AS solid, list_distinct({TOKENS.format("sentence")}) AS k FROM sent),
raw2 AS (SELECT own.*, 0.55 * {_share("weights", "list_contains(k, v.t)", "v.w")} + 0.25 * {_share("short", "contains(sentence, v)", "length(v)::DOUBLE")} + 0.20 * ({_numbers("sentence", 0.3)}) AS score, len(list_filter(terms, lambda t: list_contains(k, t))) AS matched FROM own JOIN asked USING (query_id) LEFT JOIN bw USING (query_id) WHERE solid >= 4),
ev AS MATERIALIZED (SELECT *, CASE WHEN solid < 8 THEN greatest(0, score - 0.5) ELSE score END AS key FROM raw2),
gates AS MATERIALIZED (SELECT query_id, coalesce(max(score), 0) AS best, coalesce(max(score) FILTER (matched >= 2), 0) AS corroborated, coalesce(max(score) FILTER (matched < 2), 0) AS lone, corroborated >= 0.08 OR lone >= 0.15 AS passed FROM named LEFT JOIN ev USING (query_id) GROUP BY 1)"""
_ANSWERED = f"""{_SCORED},
pick AS (SELECT *, row_number() OVER (PARTITION BY query_id, block ORDER BY spot) AS nth FROM (SELECT ev.*, row_number() OVER (PARTITION BY query_id ORDER BY round(key, 9) DESC, block, spot) AS n FROM ev JOIN gates USING (query_id) WHERE passed) WHERE n <= 4),
line AS (SELECT *, '- ' || (CASE WHEN regexp_matches(sentence, '[。！？；.!?;]$') THEN sentence ELSE sentence || '。' END)[:220] || '[' || block || ']' AS line FROM pick WHERE nth <= 2),
fit AS (SELECT *, sum(length(line)) OVER (PARTITION BY query_id ORDER BY block, spot) AS used FROM line),
text AS (SELECT query_id, '{T.EXTRACTED}' || E'\\n' || string_agg(line, E'\\n' ORDER BY block, spot) AS answer FROM fit WHERE used <= 900 GROUP BY 1),
answers AS MATERIALIZED (SELECT query_id, coalesce(answer, '{T.NO_ANSWER}') AS answer, answer IS NULL AS refused, CASE WHEN query_id NOT IN (SELECT query_id FROM blocks) THEN 'no_retrieval' WHEN answer IS NULL THEN 'model_refused' END AS reason FROM named LEFT JOIN text USING (query_id)),
mark AS (SELECT query_id, unnest(list_transform(regexp_extract_all(answer, '\\[([0-9]{{1,2}})\\]', 1), lambda m: m::INT)) AS block, generate_subscripts(regexp_extract_all(answer, '\\[([0-9]{{1,2}})\\]', 1), 1) AS i FROM answers WHERE NOT refused),
place2 AS (SELECT query_id, block, min(i) AS i FROM mark GROUP BY ALL),
cite AS (SELECT b.*, i, max(i) OVER (PARTITION BY query_id) IS NULL AS fallback FROM blocks b JOIN answers USING (query_id) LEFT JOIN place2 USING (query_id, block) WHERE NOT refused),
cited AS MATERIALIZED (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY i, block) AS n, block, id, source, round(score, 4) AS score, text, fallback FROM cite WHERE i IS NOT NULL OR (fallback AND block <= 3))"""
_SNIPPET = f"CASE WHEN length(t) <= 180 THEN t ELSE regexp_replace(t[:179], '{_SPACE}+$', '') || '…' END"


@query(_HYBRID + " SELECT query_id, block AS rank, id, score FROM found")
def hybrid_topk(spark, sf_dir):
    """Fused, reranked hits without near-duplicates."""
    out = qa.retrieve(qa.corpus(docs_of(spark, sf_dir)), questions_of(spark, sf_dir))
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(f"{_FUSED}, n AS (SELECT query_id, count(*) FILTER (vr IS NOT NULL) AS vector_hits, count(*) FILTER (br IS NOT NULL) AS bm25_hits, count(*) AS fused FROM f GROUP BY 1),{_ASKED},{_CANDIDATES},{_RERANKED},{_deduped('hit', 'found')} SELECT item_id AS query_id, coalesce(vector_hits, 0) AS vector_hits, coalesce(bm25_hits, 0) AS bm25_hits, coalesce(fused, 0) AS fused, (SELECT count(*) FROM found WHERE found.query_id = item_id) AS kept, (SELECT count(*) FROM found WHERE found.query_id = item_id) AS reranked, {_STRIP.format('text')} <> '' AS used_hybrid, fused IS NOT NULL AS used_rerank, CASE WHEN {_STRIP.format('text')} = '' THEN 'empty_query' WHEN fused IS NULL THEN 'no_hits' END AS note FROM benchmark LEFT JOIN n ON n.query_id = item_id")
def retrieval_counters(spark, sf_dir):
    held, asked = qa.corpus(docs_of(spark, sf_dir)), questions_of(spark, sf_dir)
    found = qa.hits(held, asked)
    return qa.counters(asked, found, qa.ranked(held, asked, found))


def _answered(spark, sf_dir):
    return qa.answer(qa.corpus(docs_of(spark, sf_dir)), questions_of(spark, sf_dir))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(_SCORED + " SELECT query_id, block, id, spot AS \"at\", sentence, round(score, 6) AS score, round(key, 6) AS key, matched FROM ev")
def evidence_scores(spark, sf_dir):
    out = _rounded(_answered(spark, sf_dir).found, "score", "key")
    return out.withColumns({c: F.col(c).cast("long") for c in ("block", "at", "matched")})


@query(_SCORED + " SELECT query_id, round(best, 6) AS best, round(corroborated, 6) AS corroborated, round(lone, 6) AS lone, passed FROM gates")
def evidence_gate(spark, sf_dir):
    return _rounded(_answered(spark, sf_dir).gates, "best", "corroborated", "lone")


@query(_ANSWERED + " SELECT query_id, answer, refused, reason FROM answers")
def extractive_answer(spark, sf_dir):
    return _answered(spark, sf_dir).answers


@query(_ANSWERED + f" SELECT query_id, n, block, id, source, score, {_SNIPPET} AS snippet, fallback FROM (SELECT *, {_STRIP.format('text')} AS t FROM cited)")
def answer_citations(spark, sf_dir):
    out = _answered(spark, sf_dir).citations.drop("page")
    return out.withColumns({c: F.col(c).cast("long") for c in ("n", "block")})


_GOLD = "gold AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b, documents d WHERE contains(d.text, b.text))"
_GRID = f"""{_SCORED}, {_GOLD}, able AS (SELECT gates.*, query_id IN (SELECT query_id FROM gold) AS able FROM gates), pairs AS (SELECT c AS corroborated_at, x AS lone_at FROM (SELECT unnest([0.08, 0.10, 0.12]::DOUBLE[]) AS c), (SELECT unnest([0.12, 0.13, 0.14, 0.15, 0.18]::DOUBLE[]) AS x)),
grid AS (SELECT corroborated_at, lone_at, coalesce(avg((corroborated >= corroborated_at OR lone >= lone_at)::INT) FILTER (able), 0)::DOUBLE AS answerable_pass, coalesce(avg((corroborated >= corroborated_at OR lone >= lone_at)::INT) FILTER (NOT able), 0)::DOUBLE AS refusal_pass FROM able, pairs GROUP BY ALL)"""


def _grid(spark, sf_dir):
    return A.gate_grid(_answered(spark, sf_dir).gates, gold_of(spark, sf_dir))


@query(_GRID + " SELECT corroborated_at, lone_at, round(answerable_pass, 6) AS answerable_pass, round(refusal_pass, 6) AS refusal_pass FROM grid")
def gate_grid(spark, sf_dir):
    return _rounded(_grid(spark, sf_dir), "answerable_pass", "refusal_pass")


@query(_GRID + " SELECT corroborated_at, lone_at FROM grid WHERE answerable_pass = 1 AND refusal_pass = 0 ORDER BY ALL LIMIT 1")
def gate_first_perfect(spark, sf_dir):
    return A.first_perfect(_grid(spark, sf_dir))


_CASES = f"WITH {_BM25.strip()}, {_GOLD}, h AS (SELECT query_id, min(CASE WHEN g.id IS NOT NULL THEN rank END) AS first, count(g.id) AS right, count(*) AS got FROM (SELECT * FROM bm25 WHERE rank <= 5) b LEFT JOIN gold g USING (query_id, id) GROUP BY 1), cases AS (SELECT item_id AS query_id, coalesce(n, 0) AS gold, first IS NOT NULL AS hit, coalesce(1 / first, 0)::DOUBLE AS rr, coalesce(\"right\" / greatest(got, 1), 0)::DOUBLE AS precision FROM benchmark LEFT JOIN (SELECT query_id AS item_id, count(*) AS n FROM gold GROUP BY 1) USING (item_id) LEFT JOIN (SELECT query_id AS item_id, first, \"right\", got FROM h) USING (item_id))".replace("AS right,", 'AS "right",')


def _cases(spark, sf_dir):
    asked = questions_of(spark, sf_dir)
    return A.metrics(S.bm25(asked, S.index(docs_of(spark, sf_dir)), 5), gold_of(spark, sf_dir), asked)


@query(_CASES + " SELECT query_id, gold, hit, round(rr, 6) AS rr, round(precision, 6) AS precision FROM cases")
def eval_recall_mrr(spark, sf_dir):
    return _cases(spark, sf_dir).select("query_id", "gold", "hit", F.round("rr", 6).alias("rr"), F.round("precision", 6).alias("precision"))


@query(_CASES + " SELECT count(*) AS cases, count(CASE WHEN gold > 0 THEN 1 END) AS answerable, round(avg(CASE WHEN gold > 0 THEN hit::INT END), 6) AS recall, round(avg(CASE WHEN gold > 0 THEN rr END), 6) AS mrr, round(avg(CASE WHEN gold > 0 THEN precision END), 6) AS precision FROM cases")
def eval_summary(spark, sf_dir):
    out = A.summarise(_cases(spark, sf_dir))
    return out.select("cases", "answerable", *(F.round(c, 6).alias(c) for c in ("recall", "mrr", "precision")))


_DENSE_ONLY = "dplace AS (SELECT query_id, id, rank AS position, rank FROM dense), donly AS (SELECT query_id, rank, id, list_distinct(" + TOKENS.format("coalesce(text, '')") + ") AS tokens, 0 AS score FROM dplace JOIN documents ON doc_id = id)"
_FOUND_BY = "SELECT '{0}' AS config, query_id, block, id FROM {1}"


@query(f"""{_FUSED},{_ASKED},{_CANDIDATES},{_RERANKED},{_deduped("hit", "found")}, {_DENSE_ONLY},{_deduped("donly", "dfound")},
fhit AS (SELECT query_id, position AS rank, id, tokens, final AS score FROM cand),{_deduped("fhit", "ffound")}, {_GOLD},
every AS ({_FOUND_BY.format("dense", "dfound")} UNION ALL {_FOUND_BY.format("dense_bm25", "ffound")} UNION ALL {_FOUND_BY.format("dense_bm25_rerank", "found")}),
per AS (SELECT config, query_id, min(block) FILTER (g.id IS NOT NULL) AS first, count(g.id) AS good, count(*) AS got FROM every LEFT JOIN gold g USING (query_id, id) GROUP BY ALL),
cs AS (SELECT config, item_id, item_id IN (SELECT query_id FROM gold) AS able, first, coalesce(good / greatest(got, 1), 0) AS precision FROM benchmark CROSS JOIN (SELECT unnest(['dense', 'dense_bm25', 'dense_bm25_rerank']) AS config) c LEFT JOIN per ON per.query_id = item_id AND per.config = c.config)
SELECT config, count(*) AS cases, count(*) FILTER (able) AS answerable, round(coalesce(avg((first IS NOT NULL)::INT) FILTER (able), 0), 6) AS recall, round(coalesce(avg(coalesce(1 / first, 0)) FILTER (able), 0), 6) AS mrr, round(coalesce(avg(precision) FILTER (able), 0), 6) AS precision FROM cs GROUP BY config""".replace("SELECT config, item_id,", "SELECT c.config, item_id,"))
def eval_ablation(spark, sf_dir):
    """Summary for dense hits alone, fused hits and reranked hits, from one index and one search."""
    asked, gold = questions_of(spark, sf_dir), written(gold_of(spark, sf_dir), "gold")
    held = qa.corpus(docs_of(spark, sf_dir))
    both = qa.hits(held, asked)
    out = None
    for name, found, reranked in (("dense", (both[0], both[1].limit(0)), False), ("dense_bm25", both, False), ("dense_bm25_rerank", both, True)):
        row = A.summarise(A.metrics(qa.ranked(held, asked, found, reranked=reranked), gold, asked)).withColumn("config", F.lit(name))
        out = row if out is None else out.union(row)
    return _rounded(out, "recall", "mrr", "precision")


@query()
def document_chunks(spark, sf_dir):
    """Conversations as documents of one page a turn."""
    units = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text", F.col("role").alias("source"))
    return ingest.chunks_of(units, near=0.9)


@query(f"WITH {_WINDOWS}, u AS (SELECT doc_id, text, trim(coalesce(text, ''), E' \\t\\n\\r') <> '' AS good FROM documents) SELECT count(DISTINCT CASE WHEN good THEN doc_id END) AS documents, count(CASE WHEN NOT good THEN 1 END) AS failed, coalesce(sum(CASE WHEN good THEN length(text) END), 0)::BIGINT AS chars, (SELECT count(*) FROM chunks) AS chunks FROM u")
def ingest_totals(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    blank = T.strip(F.coalesce("text", F.lit(""))) == ""
    return M.ingest_totals(docs.withColumn("error", F.when(blank, "empty document")), M.windows(docs))


@query(f"WITH {_BM25.strip()} SELECT query_id, string_agg('[' || rank || '] 来源：' || coalesce(source, '未知来源') || E'\\n' || trim(coalesce(text, ''), E' \\t\\n\\r'), E'\\n\\n' ORDER BY rank) AS context FROM bm25 JOIN documents ON doc_id = id WHERE rank <= 5 GROUP BY query_id")
def context_format(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    hits = S.bm25(questions_of(spark, sf_dir), S.index(docs), 5)
    found = hits.join(docs.select(F.col("doc_id").alias("id"), "source", "text"), "id")
    return M.context(found.select("query_id", F.col("rank").alias("block"), "source", F.lit(None).cast("int").alias("page"), "text"))


@query("SELECT count(DISTINCT conv_id) AS sessions, count(*) AS turns FROM conversations WHERE conv_id IS NOT NULL")
def session_stats(spark, sf_dir):
    return M.session_stats(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, CASE WHEN length(t) BETWEEN 2 AND 200 AND NOT starts_with(t, '改写') AND NOT starts_with(t, '好的') AND NOT starts_with(t, '根据') THEN t ELSE role END AS question FROM (SELECT *, trim(coalesce(text, ''), E' \\t\\n\\r') AS t FROM conversations)")
def rewrite_validation(spark, sf_dir):
    """Each turn as a rewrite of its role's name."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", M.rewritten_or(F.col("role"), F.col("text")).alias("question"))


@query(_SCORED + """, b AS (SELECT query_id, count(*) AS sentences, max(matched) AS max_matched, arg_max(matched, {'s': round(score, 9), 'k': round(key, 9), 'b': -block, 'a': -spot}) AS best_matched FROM ev GROUP BY 1)
SELECT query_id, round(best, 4) AS best_score, round(corroborated, 4) AS corroborated_score, round(lone, 4) AS lone_score, coalesce(best_matched, 0) AS best_matched, coalesce(max_matched, 0) AS max_matched, CASE WHEN corroborated >= 0.08 THEN 0.08 ELSE 0.15 END::DOUBLE AS required, passed AS gate_pass, coalesce(sentences, 0) AS sentences FROM gates LEFT JOIN b USING (query_id)""")
def evidence_report(spark, sf_dir):
    held = _answered(spark, sf_dir)
    out = A.report(held.found, questions_of(spark, sf_dir))
    return out.withColumns({c: F.col(c).cast("long") for c in ("best_matched", "max_matched")})


@query(_ANSWERED + " SELECT coalesce(reason, 'answered') AS reason, count(*) AS questions FROM answers GROUP BY 1")
def answer_outcome(spark, sf_dir):
    """How many questions are answered, and how many are refused for each reason."""
    rows = _answered(spark, sf_dir).answers
    return rows.groupBy(F.coalesce("reason", F.lit("answered")).alias("reason")).agg(F.count("*").alias("questions"))


_FOLD = "lower(regexp_replace({0}, '\\s', '', 'g'))"


@query(f"WITH {_BM25.strip()}, f AS (SELECT query_id, min(rank) AS r FROM bm25 JOIN documents d ON d.doc_id = id JOIN benchmark b ON item_id = query_id WHERE rank <= 5 AND {_FOLD.format('b.text')} <> '' AND contains({_FOLD.format('d.text')}, {_FOLD.format('b.text')}) GROUP BY 1) SELECT item_id AS query_id, coalesce(r, 0) AS answer_rank, r IS NOT NULL AS answer_hit, round(coalesce(1 / r, 0)::DOUBLE, 6) AS answer_rr FROM benchmark LEFT JOIN f ON query_id = item_id")
def eval_answer_hits(spark, sf_dir):
    """Whether one of the top five documents holds the question's whole text."""
    docs, asked = docs_of(spark, sf_dir), questions_of(spark, sf_dir)
    out = A.answer_hits(qa.blocks(S.bm25(asked, S.index(docs), 5), docs.withColumnRenamed("doc_id", "id")), asked.select("query_id", F.array("text").alias("gold_keywords")))
    return out.select("query_id", F.col("answer_rank").cast("long").alias("answer_rank"), "answer_hit", F.round("answer_rr", 6).alias("answer_rr"))


@query(_CASES + ", b AS (SELECT query_id, max(score) AS score FROM bm25 GROUP BY 1), s AS (SELECT gold > 0 AS able, coalesce(score, 0) AS score FROM cases LEFT JOIN b USING (query_id)) SELECT round(coalesce(min(score) FILTER (able), 0), 6) AS answerable_min, round(coalesce(avg(score) FILTER (able), 0), 6) AS answerable_avg, round(coalesce(max(score) FILTER (able), 0), 6) AS answerable_max, round(coalesce(min(score) FILTER (NOT able), 0), 6) AS refusal_min, round(coalesce(avg(score) FILTER (NOT able), 0), 6) AS refusal_avg, round(coalesce(max(score) FILTER (NOT able), 0), 6) AS refusal_max, round(coalesce(min(score) FILTER (able), 0) - coalesce(max(score) FILTER (NOT able), 0), 6) AS gap FROM s")
def score_separation(spark, sf_dir):
    """How far the best BM25 scores of questions with and without gold documents are apart."""
    asked = questions_of(spark, sf_dir)
    best = S.bm25(asked, S.index(docs_of(spark, sf_dir)), 1).select("query_id", "score")
    able = gold_of(spark, sf_dir).select("query_id").distinct().withColumn("able", F.lit(True))
    out = A.separation(asked.select("query_id").join(best, "query_id", "left").join(able, "query_id", "left").fillna({"score": 0.0, "able": False}))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


_EVAL = f"""{_ANSWERED}, {_GOLD}, first AS (SELECT query_id, min(id) AS id, count(*) AS n FROM gold GROUP BY 1),
ac AS (SELECT a.query_id, first.id IS NULL AS expect_refusal, EXISTS (SELECT 1 FROM cited c WHERE c.query_id = a.query_id AND c.id = first.id) AS citation_hit, contains(answer, question) AS keyword_hit, refused FROM answers a JOIN named n USING (query_id) LEFT JOIN first USING (query_id)),
per AS (SELECT query_id, min(block) FILTER (g.id IS NOT NULL) AS first, count(g.id) AS good, count(*) AS got FROM found LEFT JOIN gold g USING (query_id, id) GROUP BY 1),
held AS (SELECT query_id, min(block) AS r FROM blocks JOIN named USING (query_id) WHERE {_FOLD.format('question')} <> '' AND contains({_FOLD.format('text')}, {_FOLD.format('question')}) GROUP BY 1),
ec AS (SELECT ac.*, first, good, got, r FROM ac LEFT JOIN per USING (query_id) LEFT JOIN held USING (query_id))"""


def _eval_cases(spark, sf_dir):
    """Answers, cases, and blocks; the gold source is the smallest gold document, the keyword the question itself."""
    held, gold = _answered(spark, sf_dir), written(gold_of(spark, sf_dir), "gold")
    named = qa.asked_of(questions_of(spark, sf_dir))
    source = gold.groupBy("query_id").agg(F.min("id").cast("string").alias("gold_source"))
    cases = named.join(source, "query_id", "left").select("query_id", F.coalesce("gold_source", F.lit("")).alias("gold_source"), F.array("question").alias("gold_keywords"), F.col("gold_source").isNull().alias("expect_refusal"))
    cited = held.citations.select("query_id", F.col("id").cast("string").alias("source"))
    return A.answer_cases(held.answers, cited, cases), cases, held, gold, named


@query(_EVAL + " SELECT round(coalesce(avg(citation_hit::INT) FILTER (NOT expect_refusal), 0), 6) AS citation_accuracy, round(coalesce(avg(keyword_hit::INT) FILTER (NOT expect_refusal), 0), 6) AS keyword_hit_rate, round(coalesce(avg(refused::INT) FILTER (expect_refusal), 0), 6) AS refusal_accuracy FROM ac")
def eval_answers(spark, sf_dir):
    """Citation accuracy, keyword hits and refusals."""
    out = A.answer_summary(_eval_cases(spark, sf_dir)[0])
    return _rounded(out, *out.columns)


@query(_EVAL + """ SELECT *, recall >= 0.6 AND (refusals = 0 OR refusal_accuracy >= 0.6) AS passed FROM (SELECT count(*) AS cases, count(*) FILTER (NOT expect_refusal) AS answerable, count(*) FILTER (expect_refusal) AS refusals, round(coalesce(avg((first IS NOT NULL)::INT) FILTER (NOT expect_refusal), 0), 6) AS recall, round(coalesce(avg(coalesce(good / got, 0)) FILTER (NOT expect_refusal), 0), 6) AS precision, round(coalesce(avg(coalesce(1 / first, 0)) FILTER (NOT expect_refusal), 0), 6) AS mrr,
round(coalesce(avg((r IS NOT NULL)::INT) FILTER (NOT expect_refusal), 0), 6) AS answer_hit, round(coalesce(avg(coalesce(1 / r, 0)) FILTER (NOT expect_refusal), 0), 6) AS answer_mrr, round(coalesce(avg(citation_hit::INT) FILTER (NOT expect_refusal), 0), 6) AS citation_accuracy, round(coalesce(avg(keyword_hit::INT) FILTER (NOT expect_refusal), 0), 6) AS keyword_hit_rate, round(coalesce(avg(refused::INT) FILTER (expect_refusal), 0), 6) AS refusal_accuracy, 0::BIGINT AS errors FROM ec)""")
def eval_full(spark, sf_dir):
    """All measures of an evaluation in one row."""
    answered, cases, held, gold, named = _eval_cases(spark, sf_dir)
    ranked = held.blocks.withColumnRenamed("block", "rank")
    out = A.evaluation(A.metrics(ranked, gold, named), A.answer_hits(held.blocks, cases), answered, named)
    return _rounded(out, *(c for c, t in out.dtypes if t == "double"))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
