"""Fusion of rankings, reranking and selection of context."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import lexical as L


def reciprocal_rank_fusion(rankings: DataFrame, k: int = 60, limit: int = 10, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """query, doc, score, rank from query, list, doc, rank: sum of 1 / (k + rank), a list's first rank of a document."""
    first = rankings.groupBy(query, "list", doc).agg(F.min("rank").alias("r"))
    return L.top_k(first.groupBy(query, doc).agg(F.sum(1.0 / (k + F.col("r"))).alias("score")), limit, query, doc)


def min_max(score: Column, window: Window, constant: float = 0.0) -> Column:
    """Scores scaled to 0..1 within a window; constant if all are equal (0 in fusion, 1 in selection and web ranking)."""
    low, high = F.min(score).over(window), F.max(score).over(window)
    return F.when(high > low, (score - low) / (high - low)).otherwise(F.lit(constant))


def weighted_fusion(scores: DataFrame, weights: dict[str, float], limit: int = 10, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """query, doc, score, rank from query, list, doc, score: weighted mean of the lists' min-max scores, 0 where a list lacks the document."""
    if not weights or min(weights.values()) < 0 or not sum(weights.values()):
        raise ValueError("weights must not be negative, nor all 0")
    total = sum(weights.values())
    w = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])[F.col("list")], F.lit(0.0))
    n = scores.withColumn("s", min_max(F.col("score"), Window.partitionBy(query, "list")))
    return L.top_k(n.groupBy(query, doc).agg((F.sum(F.col("s") * w) / total).alias("score")), limit, query, doc, positive=False)


def mmr(candidates: DataFrame, limit: int = 5, relevance_weight: float = 0.7, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """query, doc, position of the candidates (query, doc, text, score) chosen greedily by relevance less similarity to those chosen.

    Similarity is token Jaccard; ties go to the more relevant, then to the larger id. A choice depends
    on all before it, so each query's candidates are folded in one call, with sets from the JVM.
    """
    if not 0 <= relevance_weight <= 1:
        raise ValueError("relevance_weight must be in [0, 1]")
    kind = candidates.schema[doc].dataType.simpleString()
    qkind = candidates.schema[query].dataType.simpleString()
    c = candidates.withColumn("rel", min_max(F.col("score"), Window.partitionBy(query), 1.0)).select(query, doc, "rel", T.token_set("text").alias("t"))

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        sets, rel, ids = [set(x) for x in g["t"]], g["rel"].tolist(), g[doc].tolist()
        worst, left, out = [0.0] * len(g), set(range(len(g))), []
        while left and len(out) < limit:
            best = max(left, key=lambda i: (relevance_weight * rel[i] - (1 - relevance_weight) * worst[i], rel[i], ids[i]))
            left.remove(best)
            out.append(best)
            for i in left:
                union = len(sets[i] | sets[best])
                worst[i] = max(worst[i], len(sets[i] & sets[best]) / union if union else 1.0)
        return pd.DataFrame({query: g[query].iloc[:1].tolist() * len(out), doc: [ids[i] for i in out], "position": range(1, len(out) + 1)})

    return c.groupBy(query).applyInPandas(pick, f"{query} {qkind}, {doc} {kind}, position int")


def pack_context(candidates: DataFrame, budget: int, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """query, doc, rank, words of the candidates (query, doc, rank, words) taken in order of rank while they fit in budget words; one that doesn't fit is skipped."""
    if budget < 0:
        raise ValueError("budget must not be negative")
    item = f"array<struct<rank:int,{doc}:{candidates.schema[doc].dataType.simpleString()},words:int>>"
    g = candidates.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), F.col(doc), F.col("words").cast("int").alias("words")))).alias("c"))
    state = f"struct<used:int,kept:{item}>"
    start = F.from_json(F.lit('{"used":0,"kept":[]}'), state)
    fold = F.aggregate("c", start, lambda s, x: F.when(s["used"] + x["words"] <= budget, F.struct((s["used"] + x["words"]).alias("used"), F.concat(s["kept"], F.array(x)).alias("kept")).cast(state)).otherwise(s), lambda s: s["kept"])
    return g.select(query, F.explode(fold).alias("x")).select(query, f"x.{doc}", "x.rank", "x.words")


def utilization(chunks: DataFrame, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """query, utilization: distinct source positions of the chunks (start_word, end_word, words) per word of context; an empty span stands for its first words."""
    end = F.when(F.col("end_word") > F.col("start_word"), F.col("end_word")).otherwise(F.col("words"))
    begin = F.when(F.col("end_word") > F.col("start_word"), F.col("start_word")).otherwise(F.lit(0))
    c = chunks.withColumn("b", begin).withColumn("e", end)
    # merged intervals: no position is exploded
    w = Window.partitionBy(query, doc).orderBy("b", "e")
    seen = F.coalesce(F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = F.greatest(F.lit(0), F.col("e") - F.greatest("b", seen))
    return c.withColumn("new", new).groupBy(query).agg(F.coalesce(F.try_divide(F.sum("new").cast("double"), F.sum("words").cast("double")), F.lit(0.0)).alias("utilization"))


def edge_biased(items: DataFrame, query: str = "query_id") -> DataFrame:
    """items with position: rank 1 first, 2 last, 3 second, 4 last but one, and so on."""
    w = Window.partitionBy(query)
    i, n = F.col("rank") - 1, F.count("*").over(w)
    return items.withColumn("position", F.when((n <= 2) | (i % 2 == 0), F.when(n <= 2, i).otherwise((i / 2).cast("int"))).otherwise(n - 1 - (i / 2).cast("int")).cast("int"))


FRESH = tuple("now today newest latest recent current currently".split())


def web_rerank(hits: DataFrame, as_of: Column, limit: int = 3, horizon: int = 365, weights: tuple[float, ...] = (0.35, 0.45, 0.20, 0.65, 0.35)) -> DataFrame:
    """query_id, doc_id, score, rank of hits (query_id, query, doc_id, lexical, authority, updated_at, canonical).

    Lexical score (min-max; 1 if constant), authority and, for queries that ask for
    the present, freshness are weighed (lexical, authority, freshness; lexical, authority else); of pages with one canonical address the best stays.
    """
    if abs(sum(weights[:3]) - 1) > 1e-9 or abs(sum(weights[3:]) - 1) > 1e-9 or horizon <= 0:
        raise ValueError("weights of each intent must sum to 1, the horizon be positive")
    fresh = F.arrays_overlap(T.tokens("query"), F.array(*map(F.lit, FRESH)))
    age = F.greatest(F.lit(0), F.datediff(as_of, F.col("updated_at")))
    lex = min_max(F.col("lexical"), Window.partitionBy("query_id"), 1.0)
    a, b, c, d, e = weights
    s = hits.withColumn("lex", lex).withColumn("f", F.greatest(F.lit(0.0), 1 - age / F.lit(float(horizon))))
    s = s.withColumn("score", F.when(fresh, a * F.col("lex") + b * F.col("authority") + c * F.col("f")).otherwise(d * F.col("lex") + e * F.col("authority")))
    best = Window.partitionBy("query_id", "canonical").orderBy(F.desc(F.round("score", 9)), "doc_id")
    s = s.withColumn("n", F.row_number().over(best)).where("n = 1")
    return L.top_k(s.select("query_id", "doc_id", "score"), limit, positive=False)
