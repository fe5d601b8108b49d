"""Learned reranking: features of first-stage candidates, a linear model on pairs, and hard negatives."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import lexical as L
from skein.operators.graph import use_checkpoints

FEATURES = ("dense", "bm25", "overlap", "reciprocal_rank")


def rescore(candidates: DataFrame, scores: DataFrame, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """query, doc, score, rank: candidates ordered anew by scores (query, doc, score); one without keeps its own, and none is added."""
    s = candidates.select(query, doc, F.col("score").alias("first")).join(scores.select(query, doc, "score"), [query, doc], "left")
    return L.top_k(s.select(query, doc, F.coalesce("score", "first").alias("score")), 1 << 30, query, doc, positive=False)


def features(candidates: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id and FEATURES of candidates (query_id, doc_id, score, rank): first-stage score, BM25, share of the query's words, 1/rank."""
    use_checkpoints(docs.sparkSession)
    candidates = candidates.checkpoint()
    near = docs.select("doc_id", "text").join(F.broadcast(candidates.select("doc_id").distinct()), "doc_id", "left_semi").checkpoint()
    words = candidates.join(queries.select("query_id", T.token_set("text").alias("q")), "query_id").join(near.select("doc_id", T.token_set("text").alias("t")), "doc_id")
    lex = L.bm25_scores(docs, queries, among=near).select("query_id", "doc_id", F.col("score").alias("bm25"))
    j = words.join(lex, ["query_id", "doc_id"], "left")
    share = F.when(F.size("q") > 0, F.size(F.array_intersect("q", "t")) / F.size("q")).otherwise(0.0)
    return j.select("query_id", "doc_id", F.col("score").cast("double").alias("dense"), F.coalesce("bm25", F.lit(0.0)).alias("bm25"), share.alias("overlap"), (1.0 / F.col("rank")).alias("reciprocal_rank"))


def pairs(rows: DataFrame, qrels: DataFrame) -> DataFrame:
    """FEATURES of a relevant candidate less those of another of its query, a row for each such pair."""
    good = rows.join(qrels.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")
    bad = rows.join(qrels.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_anti")
    return good.alias("g").join(bad.alias("b"), "query_id").select(*[(F.col(f"g.{f}") - F.col(f"b.{f}")).alias(f) for f in FEATURES])


def hard_negatives(rankings: DataFrame, qrels: DataFrame, k: int = 1) -> DataFrame:
    """query_id, doc_id, score, rank: the k best-ranked documents of each query that aren't relevant; a query without a relevant one has none."""
    known = rankings.join(qrels.select("query_id").distinct(), "query_id", "left_semi").join(qrels.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("rank")
    return known.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class PairwiseLinear:
    """A weight for each feature, fitted on pairs with a softplus loss by Adam; each step is one aggregation of the pairs, of which the driver gets a row."""

    def __init__(self, steps: int = 60, rate: float = 0.05, decay: float = 0.0):
        self.steps, self.rate, self.decay = steps, rate, decay
        self.weights, self.losses, self.n_pairs = np.zeros(len(FEATURES)), [], 0

    def fit(self, differences: DataFrame) -> PairwiseLinear:
        d = differences.persist()
        try:
            self.n_pairs = d.count()
            if not self.n_pairs:
                raise ValueError("no pair of a relevant and another candidate")
            m, v = np.zeros_like(self.weights), np.zeros_like(self.weights)
            for i in range(1, self.steps + 1):
                z = sum(float(w) * F.col(f) for w, f in zip(self.weights, FEATURES))
                pull = -1 / (1 + F.exp(z))
                row = d.agg(F.avg(F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))), *[F.avg(pull * F.col(f)) for f in FEATURES]).first()
                self.losses.append(row[0])
                g = np.array(row[1:]) + self.decay * self.weights
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                self.weights = self.weights - self.rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        finally:
            d.unpersist()
        return self

    def rank(self, rows: DataFrame, k: int = 1 << 30) -> DataFrame:
        """query_id, doc_id, score, rank of rows with FEATURES."""
        return L.top_k(rows.select("query_id", "doc_id", sum(float(w) * F.col(f) for w, f in zip(self.weights, FEATURES)).alias("score")), k, positive=False)

    def parameters(self) -> dict[str, float]:
        return dict(zip(FEATURES, self.weights.tolist()))
