"""Evaluation of rankings, answers and confidences: aggregations that keep every judged query."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T


def ranking_metrics(rankings: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 3, 5), query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """One row a judged query: precision, recall, hit rate and nDCG at each k, reciprocal rank, average precision, complete recall.

    qrels: query, doc, grade (> 0 is relevant). A query without a ranking scores 0; precision divides by k
    even where the list is shorter; repeated documents count for precision and DCG, but once for recall and average precision.
    """
    rel = qrels.where("grade > 0").groupBy(query, doc).agg(F.max("grade").cast("double").alias("grade"))
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1.0)
    w = Window.partitionBy(query)
    ideal = rel.withColumn("i", F.row_number().over(w.orderBy(F.desc("grade")))).groupBy(query).agg(F.count("*").alias("n_rel"), *[F.sum(F.when(F.col("i") <= k, gain(F.col("grade"), F.col("i")))).alias(f"ideal_{k}") for k in ks])
    hit = rankings.join(rel, [query, doc])
    first = Window.partitionBy(query, doc).orderBy("rank")
    hit = hit.withColumn("first", F.row_number().over(first) == 1)
    order = Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = hit.withColumn("seen", F.sum(F.col("first").cast("int")).over(order))
    aggs = [F.min("rank").alias("first_rank"), F.sum(F.when(F.col("first"), F.col("seen") / F.col("rank"))).alias("ap")]
    for k in ks:
        top = F.col("rank") <= k
        aggs += [F.count_if(top).alias(f"h_{k}"), F.count_if(top & F.col("first")).alias(f"d_{k}"), F.sum(F.when(top, gain(F.col("grade"), F.col("rank")))).alias(f"dcg_{k}")]
    got = ideal.join(hit.groupBy(query).agg(*aggs), query, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = [F.col(query)]
    for k in ks:
        out += [
            zero(F.col(f"h_{k}") / F.lit(float(k))).alias(f"precision_{k}"), zero(F.col(f"d_{k}") / F.col("n_rel")).alias(f"recall_{k}"), zero((F.col(f"d_{k}") > 0).cast("double")).alias(f"hit_{k}"),
            zero(F.try_divide(F.col(f"dcg_{k}"), F.col(f"ideal_{k}"))).alias(f"ndcg_{k}"), zero((F.col(f"d_{k}") == F.col("n_rel")).cast("double")).alias(f"complete_{k}"),
        ]
    return got.select(*out, zero(1 / F.col("first_rank")).alias("rr"), zero(F.col("ap") / F.col("n_rel")).alias("ap"))


def mean_metrics(per_query: DataFrame, classes: DataFrame | None = None, query: str = "query_id") -> DataFrame:
    """Means over all queries, class "all", and over those of each class (query, class)."""
    names = [c for c in per_query.columns if c != query]
    aggs = [F.avg(n).alias(n) for n in names] + [F.count("*").alias("n_queries")]
    if classes is None:
        return per_query.agg(F.lit("all").alias("class"), *aggs)
    r = per_query.join(classes, query).rollup("class").agg(F.grouping("class").alias("g"), *aggs)
    return r.select(F.when(F.col("g") == 1, "all").otherwise(F.col("class")).alias("class"), *names, "n_queries")


def token_f1(prediction: Column, reference: Column) -> Column:
    """F1 of two texts' multisets of tokens; 1 if both are empty, 0 if one is."""
    a, b = T.tokens(prediction), T.tokens(reference)
    count = lambda t, x: F.size(F.filter(t, lambda y: y == x))
    shared = F.aggregate(F.transform(F.array_distinct(a), lambda x: F.least(count(a, x), count(b, x))), F.lit(0), lambda s, x: s + x)
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * shared / F.greatest(both, F.lit(1)))


def contains_reference(prediction: Column, reference: Column) -> Column:
    norm = lambda c: F.array_join(T.tokens(c), " ")
    return F.contains(norm(prediction), norm(reference)).cast("double")


def grounded_recall(answer: Column, context: Column) -> Column:
    """Share of the answer's tokens that the context has; 1 for an answer without tokens."""
    a, c = T.tokens(answer), T.token_set(context)
    return F.coalesce(F.try_divide(F.size(F.filter(a, lambda x: F.array_contains(c, x))).cast("double"), F.size(a).cast("double")), F.lit(1.0))


def calibration_metrics(rows: DataFrame, threshold: float = 0.5, bins: int = 5, by: tuple[str, ...] = (), idcol: str = "id") -> DataFrame:
    """Brier score, log loss, ECE, coverage, selective risk, AURC and accuracy of rows (id, confidence, correct) in each group."""
    p, y = F.col("confidence"), F.col("correct").cast("double")
    clip = lambda c: F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), c))
    order = Window.partitionBy(*by).orderBy(F.desc("confidence"), idcol)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = rows.withColumn("risk", F.avg(1 - y).over(upto)).withColumn("bin", F.least(F.floor(p * bins), F.lit(bins - 1)))
    base = r.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(y).alias("accuracy"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(-(y * F.log(clip(p)) + (1 - y) * F.log(clip(1 - p)))).alias("log_loss"),
        F.avg((p >= threshold).cast("double")).alias("coverage"), F.coalesce(F.avg(F.when(p >= threshold, 1 - y)), F.lit(0.0)).alias("selective_risk"), F.avg("risk").alias("aurc"),
    )
    gap = r.groupBy(*by, "bin").agg((F.count("*") * F.abs(F.avg(p) - F.avg(y))).alias("gap")).groupBy(*by).agg(F.sum("gap").alias("gap"))
    joined = base.join(gap, list(by)) if by else base.crossJoin(gap)
    return joined.withColumn("ece", F.col("gap") / F.col("n")).drop("gap")


def reliability(rows: DataFrame, bins: int = 5) -> DataFrame:
    """bin, count, mean confidence and accuracy; empty bins are rows of zeros, the last bin includes 1."""
    r = rows.withColumn("bin", F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")).groupBy("bin").agg(F.count("*").alias("count"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    zero = lambda n: F.coalesce(F.col(n), F.lit(0)).alias(n)
    return rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(r, "bin", "left").select("bin", zero("count"), zero("mean_confidence"), zero("accuracy"))


def choose_threshold(rows: DataFrame, steps: int = 20, least_coverage: float = 0.6) -> DataFrame:
    """The threshold i / steps with the lowest risk, then highest coverage, then the highest, among those with enough coverage."""
    t = rows.sparkSession.range(steps + 1).select((F.col("id") / F.lit(float(steps))).alias("threshold"))
    s = t.crossJoin(rows).groupBy("threshold").agg(F.avg((F.col("confidence") >= F.col("threshold")).cast("double")).alias("coverage"), F.coalesce(F.avg(F.when(F.col("confidence") >= F.col("threshold"), 1 - F.col("correct").cast("double"))), F.lit(0.0)).alias("risk"))
    return s.where(F.col("coverage") >= least_coverage).orderBy("risk", F.desc("coverage"), F.desc("threshold")).limit(1)


def percentile(values: DataFrame, column: str, *qs: float) -> DataFrame:
    """Exact percentiles, interpolated linearly; NaN is the largest number.

    The bits of a number, put in order, are found 16 at a time: a pass over the column counts what
    follows the bits found so far, 65,536 numbers a percentile at most, so no task holds the values.
    """
    v = values.select(F.col(column).cast("double").alias("v")).where("v is not null")

    def counts(known: list[int], level: int) -> dict[int, dict[int, int]]:
        def run(batches):
            total = np.zeros((len(known), 1 << 16), np.int64)
            for batch in batches:
                key = _ordered(batch.column("v").to_numpy(zero_copy_only=False))
                for i, prefix in enumerate(known):
                    k = key[key >> np.uint64(64 - 16 * level) == np.uint64(prefix)] if level else key
                    total[i] += np.bincount(((k >> np.uint64(48 - 16 * level)) & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
            i, at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(at), pa.array(total[i, at])], names=["i", "at", "n"])

        out: dict[int, dict[int, int]] = {p: {} for p in known}
        for r in v.mapInArrow(run, "i bigint, at bigint, n bigint").groupBy("i", "at").agg(F.sum("n").alias("n")).collect():
            out[known[r["i"]]][r["at"]] = r["n"]
        return out

    first = counts([0], 0)[0]
    n = sum(first.values())
    places = [q * (n - 1) for q in qs] if n else []
    state = {i: (0, i) for p in places for i in (math.floor(p), math.ceil(p))}  # bits found, and the place among what has them
    for level in range(4 if n else 0):
        by = {0: first} if not level else counts(sorted({x for x, _ in state.values()}), level)
        for i, (prefix, left) in state.items():
            for at in sorted(by[prefix]):
                if left < by[prefix][at]:
                    state[i] = (prefix << 16 | at, left)
                    break
                left -= by[prefix][at]
    value = {i: _number(x) for i, (x, _) in state.items()}
    found = [value[lo] if value[lo] == value[hi] or lo == hi else (hi - p) * value[lo] + (p - lo) * value[hi] for p in places for lo, hi in [(math.floor(p), math.ceil(p))]] or [None] * len(qs)
    return values.sparkSession.createDataFrame([tuple(found)], ", ".join(f"p{round(q * 100)} double" for q in qs))


_SIGN = np.uint64(1 << 63)


def _ordered(v: np.ndarray) -> np.ndarray:
    """Numbers as integers of the same order."""
    bits = np.where(np.isnan(v), np.nan, v + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def _number(key: int) -> float:
    k = np.array([key], np.uint64)
    return float(np.where(k & _SIGN, k ^ _SIGN, ~k).view(np.float64)[0])


def duplicate_rate(rankings: DataFrame, canonical: DataFrame, k: int, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """query, duplicate_rate: the share of the k best whose canonical address another has."""
    r = rankings.where(F.col("rank") <= k).join(canonical, doc)
    return r.groupBy(query).agg((1 - F.count_distinct("canonical") / F.count("*")).alias("duplicate_rate"))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays as multisets."""
    count = lambda t, x: F.size(F.filter(t, lambda y: y == x))
    return F.aggregate(F.transform(F.array_distinct(a), lambda x: F.least(count(a, x), count(b, x))), F.lit(0), lambda s, x: s + x)


def field_accuracy(expected: Column, actual: Column) -> Column:
    """Share of the expected map's fields that actual has with the same value, case aside; 1 if nothing is expected."""
    hits = F.size(F.filter(F.map_keys(expected), lambda k: F.coalesce(F.lower(expected[k]) == F.lower(F.try_element_at(actual, k)), F.lit(False))))
    return F.coalesce(F.try_divide(hits.cast("double"), F.size(expected).cast("double")), F.lit(1.0))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def citation_precision(cited: Column, relevant: Column) -> Column:
    """Share of the distinct cited documents that are relevant; 0 without a citation."""
    c = F.array_distinct(cited)
    return F.when(F.size(c) > 0, F.size(F.array_intersect(c, relevant)) / F.size(c)).otherwise(0.0)


def citation_recall(cited: Column, relevant: Column) -> Column:
    """Share of the distinct relevant documents that are cited; 0 where none is relevant."""
    r = F.array_distinct(relevant)
    return F.when(F.size(r) > 0, F.size(F.array_intersect(r, cited)) / F.size(r)).otherwise(0.0)


def recall_at_budget(found: Column, relevant: Column, budget: int) -> Column:
    """Share of the relevant documents among the first budget ones found; 1 where none is relevant."""
    r = F.array_distinct(relevant)
    return F.when(F.size(r) > 0, F.size(F.array_intersect(r, F.slice(found, 1, budget))) / F.size(r)).otherwise(1.0)


def complete_at_budget(found: Column, relevant: Column, budget: int) -> Column:
    return F.size(F.array_except(relevant, F.slice(found, 1, budget))) == 0


def score_margin(rankings: DataFrame, qrels: DataFrame, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """query, margin: the best score of a relevant document less that of any other; null if either is missing."""
    j = rankings.join(qrels.select(query, doc, F.lit(True).alias("good")), [query, doc], "left")
    return j.groupBy(query).agg((F.max(F.when(F.col("good"), F.col("score"))) - F.max(F.when(F.col("good").isNull(), F.col("score")))).alias("margin"))


def summarize(rows: DataFrame, by: str | None = None, **measures: Column) -> DataFrame:
    """Means of measures (booleans count as 0 and 1) and n over all rows (class "all"), and over each value of by."""
    num = {k: F.avg(c.cast("double")).alias(k) for k, c in measures.items()}
    if by is None:
        return rows.agg(F.lit("all").alias("class"), *num.values(), F.count("*").alias("n"))
    one = rows.select(F.col(by).cast("string").alias("class"), *[c.cast("double").alias(k) for k, c in measures.items()])
    g = one.rollup("class").agg(F.grouping("class").alias("top"), *[F.avg(k).alias(k) for k in measures], F.count("*").alias("n"))
    return g.select(F.when(F.col("top") == 1, "all").otherwise(F.col("class")).alias("class"), *measures, "n")


def action_counts(expected: DataFrame, actual: DataFrame, task: str = "task_id") -> DataFrame:
    """task, expected, actual, matched: actions (task, tool, argument) as multisets."""
    e = expected.groupBy(task, "tool", "argument").agg(F.count("*").alias("e"))
    a = actual.groupBy(task, "tool", "argument").agg(F.count("*").alias("a"))
    j = e.join(a, [task, "tool", "argument"], "full").fillna(0, ["e", "a"])
    return j.groupBy(task).agg(F.sum("e").alias("expected"), F.sum("a").alias("actual"), F.sum(F.least("e", "a")).alias("matched"))


def evidence_metrics(found: DataFrame, expected: DataFrame, query: str = "query_id", item: str = "record_id") -> DataFrame:
    """query, recall, precision, complete of the records found for a query against those expected."""
    f, e = found.select(query, item).distinct().withColumn("f", F.lit(1)), expected.select(query, item).distinct().withColumn("e", F.lit(1))
    j = f.join(e, [query, item], "full").fillna(0, ["f", "e"]).groupBy(query).agg(F.sum("f").alias("f"), F.sum("e").alias("e"), F.sum(F.col("f") * F.col("e")).alias("both"))
    share = lambda n: F.when(F.col(n) > 0, F.col("both") / F.col(n)).otherwise(1.0)
    return j.select(query, share("e").alias("recall"), share("f").alias("precision"), (F.col("both") == F.col("e")).alias("complete"))
