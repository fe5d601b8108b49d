"""Routing, retrieval control and reflection as column expressions, and the naive Bayes route classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import lexical as L

ROUTES = ("no_retrieval", "single", "iterative")
DIRECT = ("answer only the number", "return the word", "uppercase", "repeat the token", " plus ", " minus ")
BRIDGE = ("article linked from", "city where", "company that", "country where", "data store used by", "database behind", "language used by")


def _any(text: Column, markers: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(text, F.lit(m))
    return out


def keyword_route(text: Column | str) -> Column:
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.when(_any(t, DIRECT), "no_retrieval").when(_any(t, BRIDGE), "iterative").otherwise("single")


def long_context_route(question: Column, words: Column, threshold: int, markers: tuple[str, ...]) -> Column:
    """direct for a short bundle, or a question with a marker (in lower case) of asking about all of it; else retrieve."""
    return F.when((words <= threshold) | _any(F.lower(question), markers), "direct").otherwise("retrieve")


class NaiveBayes:
    """Multinomial naive Bayes over tokens and bigrams of rows (text, label), smoothed by alpha; counts stay a table."""

    def __init__(self, examples: DataFrame, alpha: float = 1.0, label: str = "label", text: str = "text"):
        if alpha <= 0:
            raise ValueError("alpha must be positive")
        f = examples.select(F.col(label).alias("label"), F.explode(T.features(text)).alias("f"))
        self.alpha, self.counts = alpha, f.groupBy("label", "f").agg(F.count("*").alias("c"))
        self.vocabulary = self.counts.agg(F.count_distinct("f").alias("v"))
        totals = self.counts.groupBy("label").agg(F.sum("c").alias("total"))
        prior = examples.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
        whole = examples.agg(F.count("*").alias("all"))
        self.classes = prior.crossJoin(whole).join(totals, "label", "left").select("label", F.log(F.col("n") / F.col("all")).alias("prior"), F.coalesce("total", F.lit(0)).alias("total"))

    def log_scores(self, queries: DataFrame, query: str = "query_id") -> DataFrame:
        """query, label, score; features that training lacks are smoothed like others."""
        a = self.alpha
        f = queries.select(F.col(query), F.explode_outer(T.features("text")).alias("f")).groupBy(query, "f").agg(F.count("*").alias("tf"))
        grid = f.crossJoin(F.broadcast(self.classes)).crossJoin(self.vocabulary).join(self.counts, ["label", "f"], "left")
        part = F.when(F.col("f").isNull(), 0.0).otherwise(F.col("tf") * F.log((F.coalesce("c", F.lit(0)) + a) / (F.col("total") + a * F.col("v"))))
        return grid.groupBy(query, "label").agg((F.first("prior") + F.sum(part)).alias("score"))

    def classify(self, queries: DataFrame, order: tuple[str, ...], query: str = "query_id") -> DataFrame:
        """query, label: the best class, the first of order among equals."""
        s = self.log_scores(queries, query).withColumn("o", F.array_position(F.array(*map(F.lit, order)), F.col("label")))
        w = Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), "o")
        return s.withColumn("n", F.row_number().over(w)).where("n = 1").select(query, "label")


def assess(query: Column, text: Column, least: float = 0.12) -> Column:
    """incorrect for a text marked as stale, ambiguous for little overlap with the query's content words, else correct."""
    q = T.content_tokens(query)
    stale = F.startswith(F.upper(F.ltrim(text)), F.lit("STALE:"))
    return F.when(stale, "incorrect").when((F.size(q) == 0) | (T.overlap(q, T.tokens(text)) < least), "ambiguous").otherwise("correct")


_NO_ENTITY = ("CURRENT", "How", "Project", "STALE", "The", "What", "Where", "Which", "Who")


def bridge_query(question: Column, evidence: Column, most: int = 4) -> Column:
    """The first capitalised name in evidence that the question lacks, and up to most content words of the question that evidence lacks; null without a name."""
    names = F.regexp_extract_all(evidence, F.lit(r"\b[A-Z][-0-9A-Za-z]+\b"), F.lit(0))
    q, e = T.token_set(question), T.token_set(evidence)
    new = F.filter(names, lambda n: ~n.isin(*_NO_ENTITY) & ~F.array_contains(q, F.lower(n)))
    rest = F.slice(F.array_except(T.content_tokens(question), e), 1, most)
    return F.when(F.size(new) > 0, F.trim(F.concat_ws(" ", F.element_at(new, 1), F.array_join(rest, " "))))


def corrective_search(queries: DataFrame, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """query_id, source, doc_id, assessment: the best document of primary, or that of fallback where the first isn't judged correct."""
    best = lambda d: L.bm25(d, queries, 1).join(d.select("doc_id", F.col("text").alias("body")), "doc_id")
    q = queries.select("query_id", "text")
    p = q.join(best(primary), "query_id", "left").select("query_id", "text", F.col("doc_id").alias("p_doc"), F.coalesce(assess(F.col("text"), F.col("body")), F.lit("missing")).alias("p"))
    f = best(fallback).select("query_id", F.col("doc_id").alias("f_doc"), F.col("body").alias("f_body"))
    j = p.join(f, "query_id", "left")
    use = (F.col("p") != "correct") & F.col("f_doc").isNotNull()
    return j.select("query_id", F.when(use, "fallback").otherwise("primary").alias("source"), F.when(use, F.col("f_doc")).otherwise(F.col("p_doc")).alias("doc_id"), F.when(use, assess(F.col("text"), F.col("f_body"))).otherwise(F.col("p")).alias("assessment"))


def reflect(question: Column, answer: Column, contexts: Column, confidence: Column, relevance: float = 0.15, support: float = 0.8, retrieve_below: float = 0.6) -> Column:
    """struct(retrieve, relevant, supported, utility) of an answer from an array of contexts."""
    n = F.size(contexts)
    rel = F.coalesce(F.try_divide(F.aggregate(F.transform(contexts, lambda c: T.overlap(T.tokens(question), T.tokens(c))), F.lit(0.0), lambda s, x: s + x), n.cast("double")), F.lit(0.0))
    a = F.transform(T.tokens(answer), T.support_token)
    known = F.transform(T.tokens(F.array_join(contexts, " ")), T.support_token)
    sup = F.coalesce(F.try_divide(F.size(F.filter(a, lambda x: F.array_contains(known, x))).cast("double"), F.size(a).cast("double")), F.lit(0.0))
    ok, yes = rel >= relevance, sup >= support
    return F.struct((confidence < retrieve_below).alias("retrieve"), ok.alias("relevant"), yes.alias("supported"), ((ok.cast("double") + yes.cast("double") + sup) / 3).alias("utility"))
