"""Queries over documents, benchmark items, embeddings, pages and labels, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import vectors as V
from skein.operators import calibration as C
from skein.operators import chunking as K
from skein.operators import control as A
from skein.operators import filters as P
from skein.operators import fusion as X
from skein.operators import lexical as L
from skein.operators import metrics as M
from skein.operators import routing as R
from skein.operators import vectorsearch as S
from skein.streaming.serving import scratch

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"
WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def questions(spark: SparkSession, d: str) -> DataFrame:
    """The first 60 characters of every fourth benchmark item are a query."""
    return table(spark, d, "benchmark").where("item_id % 4 = 0").select(F.col("item_id").alias("query_id"), F.substring("text", 1, 60).alias("text"))


Q_SQL = "questions AS (SELECT item_id AS query_id, substr(text, 1, 60) AS text FROM benchmark WHERE item_id % 4 = 0)"


_indexes: dict[tuple, L.Index] = {}


def stored(spark: SparkSession, d: str) -> L.Index:
    """The index of documents, built once for each session and state of the table, in the shared checkpoint folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
    key = spark.sparkContext.applicationId, d, status.getModificationTime(), status.getLen()
    if key not in _indexes:
        _indexes[key] = L.Index(docs(spark, d), scratch(spark))
    return _indexes[key]


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


# --- text -------------------------------------------------------------------


@query("tokenize_counts", f"SELECT term, count(*) AS n FROM (SELECT unnest({TOK}) AS term FROM documents) GROUP BY term ORDER BY n DESC, term LIMIT 100")
def tokenize_counts(spark, d):
    return docs(spark, d).select(F.explode(T.tokens("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(100)


@query("word_counts", f"SELECT doc_id, CAST(len({WORDS}) AS INT) AS n_words FROM documents")
def word_counts(spark, d):
    return docs(spark, d).select("doc_id", T.word_count("text").alias("n_words"))


@query("bigram_top", f"SELECT gram, count(*) AS n FROM (SELECT t[i] || '_' || t[i + 1] AS gram FROM (SELECT t, unnest(range(1, len(t))) AS i FROM (SELECT {TOK} AS t FROM documents))) GROUP BY gram ORDER BY n DESC, gram LIMIT 100")
def bigram_top(spark, d):
    return L.bigram_counts(docs(spark, d)).orderBy(F.desc("n"), "gram").limit(100)


@query("sentence_counts", r"SELECT doc_id, CAST(CASE WHEN c = '' THEN 0 ELSE len(regexp_extract_all(c, '[.!?] ')) + 1 END AS INT) AS n_sentences FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents)")
def sentence_counts(spark, d):
    return docs(spark, d).select("doc_id", F.size(T.sentences("text")).alias("n_sentences"))


@query("fixed_chunks", f"""
SELECT doc_id || '::chunk-' || i AS chunk_id, doc_id, CAST(i * 70 AS INT) AS start_word, CAST(least(len(w), i * 70 + 80) AS INT) AS end_word, md5(array_to_string(w[i * 70 + 1 : i * 70 + 80], ' ')) AS text_md5
FROM (SELECT doc_id, w, unnest(range(0, CAST(1 + ceil(greatest(0, len(w) - 80) / 70.0) AS BIGINT))) AS i FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE len(w) > 0)""")
def fixed_chunks(spark, d):
    return K.fixed(docs(spark, d), 80, 10).withColumn("text_md5", F.md5("text")).drop("text")


@query("sentence_chunks")
def sentence_chunks(spark, d):
    return K.sentence(docs(spark, d), 80)


@query("sentence_chunks_overlap")
def sentence_chunks_overlap(spark, d):
    return K.sentence(docs(spark, d).where("doc_id % 10 = 0"), 60, 1)


@query("paragraph_chunks")
def paragraph_chunks(spark, d):
    return K.paragraph(docs(spark, d), 160)


@query("semantic_chunks")
def semantic_chunks(spark, d):
    return K.semantic(docs(spark, d), 100)


@query("enriched_chunks", f"""
SELECT doc_id || '::chunk-' || i AS chunk_id, doc_id, md5('lang: ' || lang || ' | source: ' || source || chr(10) || array_to_string(w[i * 70 + 1 : i * 70 + 80], ' ')) AS text_md5
FROM (SELECT doc_id, lang, source, w, unnest(range(0, CAST(1 + ceil(greatest(0, len(w) - 80) / 70.0) AS BIGINT))) AS i FROM (SELECT doc_id, lang, source, {WORDS} AS w FROM documents) WHERE len(w) > 0)""")
def enriched_chunks(spark, d):
    meta = table(spark, d, "documents").select("doc_id", "lang", "source")
    chunks = K.fixed(docs(spark, d), 80, 10).join(meta, "doc_id")
    return K.enriched(chunks, {"lang": F.col("lang"), "source": F.col("source")}).select("chunk_id", "doc_id", F.md5("text").alias("text_md5"))


@query("parent_child_search")
def parent_child_search(spark, d):
    return r6(K.parent_child_search(docs(spark, d), questions(spark, d)), "score")


@query("hierarchical_search")
def hierarchical_search(spark, d):
    return r6(K.hierarchical_search(docs(spark, d), questions(spark, d)), "score")


# --- lexical ranking --------------------------------------------------------

TF = f"tok AS (SELECT doc_id, unnest({TOK}) AS term FROM {{docs}}), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2), dl AS (SELECT doc_id, len({TOK}) AS dl FROM {{docs}}), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOK}) AS term FROM questions) GROUP BY 1, 2)"
BM25 = "bm AS (SELECT query_id, doc_id, sum(qtf * ln((n + 1) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN qt USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY 1, 2)"
TFIDF = "wd AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((n + 1) / (df + 1)::DOUBLE) + 1) AS w FROM tf JOIN df USING (term), st), wq AS (SELECT query_id, term, (1 + ln(qtf)) * (ln((n + 1) / (coalesce(df, 0) + 1)::DOUBLE) + 1) AS w FROM qt LEFT JOIN df USING (term), st), ti AS (SELECT query_id, doc_id, sum(wd.w * wq.w) / (any_value(dn) * any_value(qn)) AS score FROM wd JOIN wq USING (term) JOIN (SELECT doc_id, sqrt(sum(w * w)) AS dn FROM wd GROUP BY 1) USING (doc_id) JOIN (SELECT query_id, sqrt(sum(w * w)) AS qn FROM wq GROUP BY 1) USING (query_id) GROUP BY 1, 2)"


def ranked(source: str, k: int, positive: bool = True) -> str:
    return f"(SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INT) AS rank FROM {source} {'WHERE score > 0' if positive else ''} QUALIFY rank <= {k})"


def _sql(rest: str, of: str = "documents", more: str = "") -> str:
    return f"WITH {Q_SQL}, {TF.format(docs=of)}, {BM25}{more} {rest}"


@query("term_df", f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TOK}) AS term FROM documents) GROUP BY term ORDER BY df DESC, term LIMIT 200")
def term_df(spark, d):
    return L.document_frequency(docs(spark, d)).orderBy(F.desc("df"), "term").limit(200)


@query("postings_size", f"SELECT count(*) AS postings, CAST(sum(tf) AS BIGINT) AS tokens FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK}) AS term FROM documents) GROUP BY 1, 2)")
def postings_size(spark, d):
    return L.postings(docs(spark, d)).agg(F.count("*").alias("postings"), F.sum("tf").alias("tokens"))


@query("bm25_topk", _sql(f"SELECT query_id, doc_id, round(score, 6) AS score, rank FROM {ranked('bm', 10)}"))
def bm25_topk(spark, d):
    return r6(stored(spark, d).bm25(questions(spark, d), 10), "score")


@query("tfidf_topk", _sql(f"SELECT query_id, doc_id, round(score, 6) AS score, rank FROM {ranked('ti', 10)}", more=", " + TFIDF))
def tfidf_topk(spark, d):
    return r6(stored(spark, d).tfidf(questions(spark, d), 10), "score")


_BINARY = f"b AS (SELECT query_id, doc_id, sum(qtf * ln(1 + (n + 1.0) / (df + 1.0))) AS score, count(*) AS found, any_value(terms) AS terms FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS terms FROM qt) JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2)"


@query("binary_rank", _sql(f"SELECT query_id, doc_id, round(score, 6) AS score, rank FROM {ranked('b', 5)}", more=", " + _BINARY))
def binary_rank(spark, d):
    return r6(L.binary_rank(docs(spark, d), questions(spark, d), 5), "score")


@query("binary_rank_all_terms", _sql(f"SELECT query_id, doc_id, round(score, 6) AS score, rank FROM {ranked('(SELECT * FROM b WHERE found = terms)', 5)}", more=", " + _BINARY))
def binary_rank_all_terms(spark, d):
    return r6(L.binary_rank(docs(spark, d), questions(spark, d), 5, require_all_terms=True), "score")


@query("bm25_prefilter", _sql(f"SELECT query_id, doc_id, round(score, 6) AS score, rank FROM {ranked('bm', 3)}", "(SELECT * FROM documents WHERE lang = 'en' AND source < 'src5')"))
def bm25_prefilter(spark, d):
    t = table(spark, d, "documents")
    return r6(P.search(t, questions(spark, d), (F.col("lang") == "en") & (F.col("source") < "src5"), "prefilter"), "score")


@query("bm25_postfilter", _sql(f"SELECT query_id, doc_id, round(score, 6) AS score, rank FROM {ranked('(SELECT x.query_id, x.doc_id, x.score FROM ' + ranked('bm', 20) + " x JOIN documents d ON d.doc_id = x.doc_id WHERE d.lang = 'en' AND d.source < 'src5')", 3)}"))
def bm25_postfilter(spark, d):
    t = table(spark, d, "documents")
    return r6(P.search(t, questions(spark, d), (F.col("lang") == "en") & (F.col("source") < "src5"), "postfilter", candidates=20), "score")


# --- fusion, selection ------------------------------------------------------

_LISTS = f"lists AS (SELECT 'bm25' AS list, * FROM {ranked('bm', 20)} UNION ALL SELECT 'tfidf', * FROM {ranked('ti', 20)})"


def _lists(spark, d):
    index = stored(spark, d)
    a = index.bm25(questions(spark, d), 20).withColumn("list", F.lit("bm25"))
    return a.unionByName(index.tfidf(questions(spark, d), 20).withColumn("list", F.lit("tfidf")))


@query("rrf", _sql(f"SELECT query_id, doc_id, round(score, 6) AS score, rank FROM {ranked('(SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM lists GROUP BY 1, 2)', 10)}", more=f", {TFIDF}, {_LISTS}"))
def rrf(spark, d):
    return r6(X.reciprocal_rank_fusion(_lists(spark, d)), "score")


_NORM = "nm AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS s FROM lists WINDOW w AS (PARTITION BY query_id, list))"


@query("weighted_fusion", _sql(f"SELECT query_id, doc_id, round(score, 6) AS score, rank FROM {ranked('(SELECT query_id, doc_id, sum(CASE list WHEN ' + "'bm25'" + ' THEN 0.7 ELSE 0.3 END * s)::DOUBLE AS score FROM nm GROUP BY 1, 2)', 10, False)}", more=f", {TFIDF}, {_LISTS}, {_NORM}"))
def weighted_fusion(spark, d):
    return r6(X.weighted_fusion(_lists(spark, d), {"bm25": 0.7, "tfidf": 0.3}), "score")


@query("jaccard_pairs", f"WITH s AS (SELECT item_id, list_distinct({TOK}) AS t FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))::DOUBLE, 6) AS jaccard FROM s a JOIN s b ON a.item_id < b.item_id WHERE jaccard >= 0.2")
def jaccard_pairs(spark, d):
    s = table(spark, d, "benchmark").select("item_id", T.token_set("text").alias("t"))
    a, b = s.select(F.col("item_id").alias("a"), F.col("t").alias("ta")), s.select(F.col("item_id").alias("b"), F.col("t").alias("tb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(T.jaccard(F.col("ta"), F.col("tb")), 6).alias("jaccard")).where("jaccard >= 0.2")


def _candidates(spark, d, k=20):
    return L.bm25(docs(spark, d), questions(spark, d), k).join(docs(spark, d), "doc_id")


@query("mmr")
def mmr(spark, d):
    return X.mmr(_candidates(spark, d), 5)


@query("pack_context")
def pack_context(spark, d):
    return X.pack_context(_candidates(spark, d).withColumn("words", T.word_count("text")), 2000)


@query("edge_biased_order", _sql(f"SELECT query_id, doc_id, rank, CAST(CASE WHEN n <= 2 THEN rank - 1 WHEN (rank - 1) % 2 = 0 THEN (rank - 1) // 2 ELSE n - 1 - (rank - 1) // 2 END AS INT) AS position FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM {ranked('bm', 9)})"))
def edge_biased_order(spark, d):
    return X.edge_biased(L.bm25(docs(spark, d), questions(spark, d), 9)).select("query_id", "doc_id", "rank", "position")


_CHUNKS = f"ck AS (SELECT doc_id, i * 70 AS s, least(len(w), i * 70 + 80) AS e FROM (SELECT doc_id, w, unnest(range(0, CAST(1 + ceil(greatest(0, len(w) - 80) / 70.0) AS BIGINT))) AS i FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE len(w) > 0))"


@query("source_utilization", f"WITH {_CHUNKS} SELECT doc_id, round(count(DISTINCT p) / any_value(total)::DOUBLE, 6) AS utilization FROM (SELECT doc_id, unnest(range(s, e)) AS p, total FROM (SELECT *, sum(e - s) OVER (PARTITION BY doc_id) AS total FROM ck)) GROUP BY doc_id")
def source_utilization(spark, d):
    c = K.fixed(docs(spark, d), 80, 10).withColumn("words", F.col("end_word") - F.col("start_word")).withColumn("query_id", F.col("doc_id"))
    return r6(X.utilization(c), "utilization").withColumnRenamed("query_id", "doc_id")


@query("web_rerank", f"""
WITH questions AS (SELECT * FROM (VALUES (0, 'latest that the'), (1, 'that onesen the'), (2, 'der die und')) q(query_id, text)),
pg AS (SELECT page_id AS doc_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text, url FROM pages),
{TF.format(docs='pg')}, {BM25},
h AS (SELECT query_id, x.doc_id, score AS lex0, (x.doc_id % 11) / 10.0::DOUBLE AS authority, CAST((x.doc_id * 37) % 500 AS INT) AS age, regexp_replace(regexp_replace(lower(url), '^https?://(www\\.)?|[?#].*$', '', 'g'), '/+$', '') AS canonical FROM {ranked('bm', 20)} x JOIN pg USING (doc_id)),
s AS (SELECT *, CASE WHEN max(lex0) OVER w > min(lex0) OVER w THEN (lex0 - min(lex0) OVER w) / (max(lex0) OVER w - min(lex0) OVER w) ELSE 1 END AS lex FROM h WINDOW w AS (PARTITION BY query_id)),
z AS (SELECT query_id, doc_id, canonical, CASE WHEN query_id = 0 THEN 0.35 * lex + 0.45 * authority + 0.2 * greatest(0, 1 - age / 365.0::DOUBLE) ELSE 0.65 * lex + 0.35 * authority END::DOUBLE AS score FROM s),
u AS (SELECT query_id, doc_id, score FROM z QUALIFY row_number() OVER (PARTITION BY query_id, canonical ORDER BY round(score, 9) DESC, doc_id) = 1)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM {ranked('u', 3, False)}""")
def web_rerank(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), T.strip_html("html").alias("text"), "url")
    q = spark.createDataFrame([(0, "latest that the"), (1, "that onesen the"), (2, "der die und")], "query_id int, text string")
    hits = L.bm25(pages, q, 20).join(pages.select("doc_id", "url"), "doc_id").join(q.withColumnRenamed("text", "query"), "query_id")
    hits = hits.select("query_id", "query", "doc_id", F.col("score").alias("lexical"), ((F.col("doc_id") % 11) / 10.0).alias("authority"), F.date_sub(F.lit("2026-01-01").cast("date"), ((F.col("doc_id") * 37) % 500).cast("int")).alias("updated_at"), T.canonical_url("url").alias("canonical"))
    return r6(X.web_rerank(hits, F.lit("2026-01-01").cast("date")), "score")


# --- vectors ----------------------------------------------------------------

_DOT = "list_inner_product(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"


@query("cosine_topk", "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM " + ranked("(SELECT q.vec_id AS query_id, v.vec_id AS doc_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings v WHERE q.vec_id < 20)", 5, False))
def cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    return r6(S.top_k(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), e.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 5), "score")


@query("label_centroid", "SELECT label, dim, round(avg(x), 6) AS mean FROM (SELECT label, CAST(unnest(range(0, len(embedding))) AS INT) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2")
def label_centroid(spark, d):
    return r6(table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean")), "mean")


@query("maxsim", f"SELECT query_id, doc_id, round(sum(best), 6) AS score FROM (SELECT q.vec_id // 4 AS query_id, q.vec_id, v.label AS doc_id, max({_DOT.format('q.embedding', 'v.embedding')}) AS best FROM embeddings q, embeddings v WHERE q.vec_id < 16 GROUP BY 1, 2, 3) GROUP BY 1, 2")
def maxsim(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id < 16").groupBy(F.floor(F.col("vec_id") / 4).alias("query_id")).agg(F.collect_list("embedding").alias("q"))
    v = e.groupBy(F.col("label").alias("doc_id")).agg(F.collect_list("embedding").alias("v"))
    return q.crossJoin(v).select("query_id", "doc_id", F.round(V.maxsim(F.col("q"), F.col("v")), 6).alias("score"))


@query("hashing_embed")
def hashing_embed(spark, d):
    return docs(spark, d).select("doc_id", V.hashing_embed("text", 64).alias("vector"))


@query("vector_rag")
def vector_rag(spark, d):
    """The naive RAG path: chunks of all documents, hashed vectors, the best chunk of each question as answer and citation."""
    top = A.naive_rag(docs(spark, d), questions(spark, d), 80, 10, 64, 1)
    return r6(top.select("query_id", "chunk_id", F.col("doc_id").alias("cited"), F.col("text").alias("answer"), "score", "rank"), "score")


# --- metrics ----------------------------------------------------------------

_RANK = f"rk AS {ranked('bm', 10)}, ql AS (SELECT query_id, doc_id, 1.0::DOUBLE + doc_id % 3 AS grade FROM {ranked('bm', 30)} WHERE doc_id % 4 = 0), allq AS (SELECT DISTINCT query_id FROM ql)"


def _judged(spark, d):
    s = L.bm25(docs(spark, d), questions(spark, d), 30)
    return s.where("rank <= 10"), s.where("doc_id % 4 = 0").select("query_id", "doc_id", (F.lit(1.0) + F.col("doc_id") % 3).alias("grade"))


_METRICS = f"""
, {_RANK}, h AS (SELECT rk.*, ql.grade FROM rk JOIN ql USING (query_id, doc_id)), i AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS i FROM ql),
a AS (SELECT query_id, sum(seen / rank::DOUBLE) AS ap FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM h) GROUP BY 1),
pq AS (SELECT query_id, coalesce((SELECT count(*) FROM h WHERE h.query_id = q.query_id AND rank <= 5), 0) / 5.0::DOUBLE AS precision_5,
  (SELECT count(*) FROM h WHERE h.query_id = q.query_id AND rank <= 5) / (SELECT count(*) FROM ql WHERE ql.query_id = q.query_id)::DOUBLE AS recall_5,
  coalesce((SELECT sum((2 ** grade - 1) / log2(rank + 1)) FROM h WHERE h.query_id = q.query_id AND rank <= 5), 0) / (SELECT sum((2 ** grade - 1) / log2(i + 1)) FROM i WHERE i.query_id = q.query_id AND i <= 5) AS ndcg_5,
  coalesce((SELECT 1.0::DOUBLE / min(rank) FROM h WHERE h.query_id = q.query_id), 0) AS rr,
  coalesce((SELECT ap FROM a WHERE a.query_id = q.query_id), 0) / (SELECT count(*) FROM ql WHERE ql.query_id = q.query_id) AS ap FROM allq q)"""


@query("ranking_metrics", _sql("SELECT query_id, round(precision_5, 6) AS precision_5, round(recall_5, 6) AS recall_5, round(ndcg_5, 6) AS ndcg_5, round(rr, 6) AS rr, round(ap, 6) AS ap FROM pq", more=_METRICS))
def ranking_metrics(spark, d):
    m = M.ranking_metrics(*_judged(spark, d))
    return r6(m.select("query_id", "precision_5", "recall_5", "ndcg_5", "rr", "ap"), "precision_5", "recall_5", "ndcg_5", "rr", "ap")


@query("metrics_by_class", _sql("SELECT CASE WHEN grouping(c) = 1 THEN 'all' ELSE c END AS class, round(avg(recall_5), 6) AS recall_5, round(avg(rr), 6) AS mrr, round(avg(ap), 6) AS map, count(*) AS n_queries FROM (SELECT *, CASE WHEN query_id % 8 = 0 THEN 'even' ELSE 'odd' END AS c FROM pq) GROUP BY ROLLUP (c)", more=_METRICS))
def metrics_by_class(spark, d):
    m = M.ranking_metrics(*_judged(spark, d)).select("query_id", "recall_5", F.col("rr").alias("mrr"), F.col("ap").alias("map"))
    classes = questions(spark, d).select("query_id", F.when(F.col("query_id") % 8 == 0, "even").otherwise("odd").alias("class"))
    return r6(M.mean_metrics(m, classes), "recall_5", "mrr", "map")


@query("token_f1", f"""
WITH p AS (SELECT a.item_id, {TOK.replace('text', 'a.text')} AS x, {TOK.replace('text', 'b.text')} AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
c AS (SELECT item_id, sum(least(cx, cy)) AS s FROM (SELECT item_id, t, count(*) AS cx FROM (SELECT item_id, unnest(x) AS t FROM p) GROUP BY 1, 2) JOIN (SELECT item_id, t, count(*) AS cy FROM (SELECT item_id, unnest(y) AS t FROM p) GROUP BY 1, 2) USING (item_id, t) GROUP BY 1)
SELECT item_id, round(2.0::DOUBLE * coalesce(s, 0) / (len(x) + len(y)), 6) AS f1 FROM p LEFT JOIN c USING (item_id)""")
def token_f1(spark, d):
    b = table(spark, d, "benchmark")
    n = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next"))
    return b.join(n, "item_id").select("item_id", F.round(M.token_f1(F.col("text"), F.col("next")), 6).alias("f1"))


_CONF = "rows_ AS (SELECT doc_id AS id, ((doc_id * 7919) % 1000) / 1000.0::DOUBLE AS confidence, quality AS correct FROM labels)"


def _confidences(spark, d):
    return table(spark, d, "labels").select(F.col("doc_id").alias("id"), (((F.col("doc_id") * 7919) % 1000) / 1000.0).alias("confidence"), F.col("quality").alias("correct"))


@query("calibration_metrics", f"""
WITH {_CONF}, r AS (SELECT *, avg(1 - correct) OVER (ORDER BY confidence DESC, id ROWS UNBOUNDED PRECEDING) AS risk FROM rows_),
g AS (SELECT sum(gap) AS gap FROM (SELECT count(*) * abs(avg(confidence) - avg(correct)) AS gap FROM rows_ GROUP BY least(floor(confidence * 5), 4)))
SELECT count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg((confidence - correct) ** 2), 6) AS brier, round(avg(-(correct * ln(least(1 - 1e-6, greatest(1e-6, confidence))) + (1 - correct) * ln(least(1 - 1e-6, greatest(1e-6, 1 - confidence))))), 6) AS log_loss,
 round(avg(CAST(confidence >= 0.5 AS INT)), 6) AS coverage, round(avg(CASE WHEN confidence >= 0.5 THEN 1 - correct END), 6) AS selective_risk, round(avg(risk), 6) AS aurc, round(any_value(gap) / count(*), 6) AS ece FROM r, g""")
def calibration_metrics(spark, d):
    m = M.calibration_metrics(_confidences(spark, d))
    return r6(m, "accuracy", "brier", "log_loss", "coverage", "selective_risk", "aurc", "ece")


@query("reliability_bins", f"WITH {_CONF} SELECT CAST(b AS INT) AS bin, count(id) AS count, round(coalesce(avg(confidence), 0), 6) AS mean_confidence, round(coalesce(avg(correct), 0), 6) AS accuracy FROM range(5) t(b) LEFT JOIN rows_ ON least(floor(confidence * 5), 4) = b GROUP BY b")
def reliability_bins(spark, d):
    return r6(M.reliability(_confidences(spark, d)), "mean_confidence", "accuracy")


@query("choose_threshold", f"WITH {_CONF} SELECT threshold, coverage, risk FROM (SELECT t / 20.0::DOUBLE AS threshold, round(avg(CAST(confidence >= t / 20.0 AS INT)), 6) AS coverage, round(coalesce(avg(CASE WHEN confidence >= t / 20.0 THEN 1 - correct END), 0), 6) AS risk FROM range(21) x(t), rows_ GROUP BY t) WHERE coverage >= 0.6 ORDER BY risk, coverage DESC, threshold DESC LIMIT 1")
def choose_threshold(spark, d):
    return r6(M.choose_threshold(_confidences(spark, d)), "coverage", "risk")


@query("logistic_calibration")
def logistic_calibration(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.log1p("n_chars").alias("x1"), T.overlap(F.array(F.lit("the")), T.tokens("text")).alias("x2"))
    f = x.join(table(spark, d, "labels"), "doc_id").select("doc_id", "toxic", "quality", "x1", "x2")  # numbers are joined, not texts
    model = C.LogisticCalibrator(["x1", "x2"]).fit(f, "quality")
    return f.select("doc_id", F.round(model.predict(), 6).alias("confidence"))


# --- filters, routing, changes ---------------------------------------------


@query("acl_filter", "SELECT doc_id FROM documents WHERE (source IN ('src1', 'src0')) AND (doc_id % 5 = 0 OR doc_id % 3 = 1)")
def acl_filter(spark, d):
    t = table(spark, d, "documents").withColumn("tenant", F.when(F.col("source") == "src0", "shared").otherwise(F.col("source")))
    roles = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 3 == 1, F.array(F.lit("analyst"), F.lit("ops"))).otherwise(F.array(F.lit("ops")))
    return t.withColumn("roles", roles).where(P.tenant_allowed(F.col("tenant"), F.col("roles"), F.lit("src1"), F.lit("analyst"))).select("doc_id")


@query("first_fail_reason", "SELECT count(*) FILTER (a AND f AND t) AS candidates, count(*) FILTER (NOT a) AS acl_filtered, count(*) FILTER (a AND NOT f) AS stale_filtered, count(*) FILTER (a AND f AND NOT t) AS untrusted_filtered FROM (SELECT lang IN ('en', 'de') AS a, n_chars > 500 AS f, source <> 'src3' AS t FROM documents)")
def first_fail_reason(spark, d):
    t = table(spark, d, "documents")
    return P.reason_counts(P.first_failing(t, F.col("lang").isin("en", "de"), F.col("n_chars") > 500, F.col("source") != "src3"))


@query("guarded_search", _sql("SELECT query_id, doc_id, round(score, 6) AS score, rank FROM " + ranked("(SELECT b.* FROM b JOIN documents d USING (doc_id) WHERE found = terms AND lang IN ('en', 'de') AND n_chars > 500 AND source <> 'src3')", 2), more=", " + _BINARY))
def guarded_search(spark, d):
    t = table(spark, d, "documents")
    return r6(P.guarded_search(t, questions(spark, d), F.col("lang").isin("en", "de"), F.col("n_chars") > 500, F.col("source") != "src3", 2), "score")


@query("canonical_dedupe", r"SELECT page_id, regexp_replace(regexp_replace(lower(url), '^https?://(www\.)?|[?#].*$', '', 'g'), '/+$', '') AS canonical FROM pages QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY page_id DESC) = 1")
def canonical_dedupe(spark, d):
    p = table(spark, d, "pages").withColumn("canonical", T.canonical_url("url"))
    return P.canonical_dedupe(p, F.col("canonical"), F.desc("page_id")).select("page_id", "canonical")


_ROUTE = "CASE WHEN regexp_matches(lower(text), 'return the word|answer only the number|uppercase|repeat the token| plus | minus ') THEN 'no_retrieval' WHEN regexp_matches(lower(text), 'city where|language used by|database behind|data store used by|country where|company that|article linked from') THEN 'iterative' ELSE 'single' END"


@query("keyword_route", f"SELECT route, count(*) AS n FROM (SELECT {_ROUTE} AS route FROM documents) GROUP BY 1")
def keyword_route(spark, d):
    return docs(spark, d).select(R.keyword_route("text").alias("route")).groupBy("route").agg(F.count("*").alias("n"))


@query("naive_bayes_route", f"""
WITH ex AS (SELECT doc_id, lang AS label, t || list_transform(range(1, len(t)), lambda i: t[i] || '__' || t[i + 1]) AS f FROM (SELECT doc_id, lang, {TOK} AS t FROM documents WHERE doc_id % 10 = 0)),
c AS (SELECT label, f, count(*) AS c FROM (SELECT label, unnest(f) AS f FROM ex) GROUP BY 1, 2), v AS (SELECT count(DISTINCT f) AS v FROM c), tot AS (SELECT label, sum(c) AS total FROM c GROUP BY 1),
pr AS (SELECT label, ln(count(*) / (SELECT count(*) FROM ex)::DOUBLE) AS prior FROM ex GROUP BY 1),
q AS (SELECT query_id, f, count(*) AS tf FROM (SELECT item_id AS query_id, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || '__' || t[i + 1])) AS f FROM (SELECT item_id, {TOK} AS t FROM benchmark)) GROUP BY 1, 2),
s AS (SELECT query_id, label, any_value(prior) + sum(tf * ln((coalesce(c, 0) + 1) / (total + v)::DOUBLE)) AS score FROM q CROSS JOIN pr JOIN tot USING (label) CROSS JOIN v LEFT JOIN c USING (label, f) GROUP BY 1, 2)
SELECT query_id, label FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, label) = 1""")
def naive_bayes_route(spark, d):
    train = table(spark, d, "documents").where("doc_id % 10 = 0").withColumn("label", F.col("lang"))
    return R.NaiveBayes(train).classify(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), ("de", "en", "es", "fr"))


@query("retrieval_judge", f"""
WITH {Q_SQL}, w AS (SELECT query_id, list_filter(list_distinct({TOK}), lambda x: NOT list_contains({list(T.STOPWORDS)}, x)) AS q FROM questions),
x AS (SELECT query_id, doc_id, q, len(list_intersect(q, list_distinct({TOK}))) AS o FROM w, documents WHERE doc_id < 50)
SELECT assessment, count(*) AS n FROM (SELECT CASE WHEN len(q) = 0 OR o / len(q)::DOUBLE < 0.12 THEN 'ambiguous' ELSE 'correct' END AS assessment FROM x) GROUP BY 1""")
def retrieval_judge(spark, d):
    q = questions(spark, d).withColumnRenamed("text", "question")
    return q.crossJoin(docs(spark, d).where("doc_id < 50")).select(R.assess(F.col("question"), F.col("text")).alias("assessment")).groupBy("assessment").agg(F.count("*").alias("n"))


@query("corrective_search")
def corrective_search(spark, d):
    t = table(spark, d, "documents")
    return R.corrective_search(questions(spark, d), t.where("lang = 'de'").select("doc_id", "text"), t.where("lang <> 'de'").select("doc_id", "text"))


@query("reflection")
def reflection(spark, d):
    top = L.bm25(docs(spark, d), questions(spark, d), 3).join(docs(spark, d), "doc_id").groupBy("query_id").agg(F.sort_array(F.collect_list("text")).alias("contexts"))
    return questions(spark, d).join(top, "query_id").select("query_id", R.reflect(F.col("text"), F.substring("text", 1, 30), F.col("contexts"), F.lit(0.5)).alias("r")).select("query_id", "r.*")


@query("apply_changes", "SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN 'changed' ELSE lang END AS lang FROM documents WHERE doc_id % 7 <> 0")
def apply_changes(spark, d):
    base = table(spark, d, "documents").select("doc_id", "lang")
    up = base.where("doc_id % 7 < 2").select("doc_id", F.lit("changed").alias("lang"), F.lit("upsert").alias("op"), F.lit(1).cast("long").alias("generation"))
    gone = base.where("doc_id % 7 = 0").select("doc_id", "lang", F.lit("delete").alias("op"), F.lit(2).cast("long").alias("generation"))
    return L.apply_changes(base, up.unionByName(gone))


@query("generation_count", "SELECT count(*) FILTER (doc_id % 7 < 2) + count(*) FILTER (doc_id % 7 = 0) AS generation FROM documents")
def generation_count(spark, d):
    base = table(spark, d, "documents").select("doc_id")
    up = base.where("doc_id % 7 < 2").select("doc_id", F.lit("upsert").alias("op"), F.col("doc_id").alias("generation"))
    gone = base.where("doc_id % 7 = 0").select("doc_id", F.lit("delete").alias("op"), (F.col("doc_id") + 1000000).alias("generation"))
    again = base.where("doc_id % 7 = 0").select("doc_id", F.lit("delete").alias("op"), (F.col("doc_id") + 2000000).alias("generation"))
    return L.generation_count(base, up.unionByName(gone).unionByName(again))
