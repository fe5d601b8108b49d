"""Toxicity: linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import _text as X
from skein.llm.langid import features

BITS = 20
ORDERS = (4, 5)
#: Labelled rows of each class that a model is fitted on, about.
PER_CLASS = 4000
THRESHOLD = 0.5
#: A bucket whose log-count ratio is nearer to 0, or which fewer labelled documents have, is no feature: it bounds what the driver fits on.
LEAST_RATIO, LEAST_ROWS = 1.0, 5


def present(texts: list[str | None], use: np.ndarray | None = None):
    """(first row, row after the last, documents, buckets): each n-gram once a document; of the buckets in use only, if given."""
    for lo, hi, cp, bounds in X.chunks(texts):
        f, b = features(cp, bounds, ORDERS, BITS)
        doc = np.repeat(np.arange(hi - lo), np.diff(b))
        keys = []
        for row in f:
            pick = row < 1 << BITS if use is None else use[row]
            keys.append((doc[pick] << BITS) | row[pick])
        key = np.unique(np.concatenate(keys))
        yield lo, hi, key >> BITS, key & (1 << BITS) - 1


def ratios(p: np.ndarray, q: np.ndarray, toxic: int, clean: int, least: float = LEAST_RATIO, rows: int = LEAST_ROWS) -> np.ndarray:
    """Naive Bayes log-count ratio of each bucket that is in p toxic and q clean documents; 0 within least of 0, and for buckets in fewer than rows documents."""
    ratio = np.log((p + 1) / (toxic + 1)) - np.log((q + 1) / (clean + 1))
    return np.where((np.abs(ratio) >= least) & (p + q >= rows), ratio, 0)


def fit(buckets: list[np.ndarray], toxic: np.ndarray, ratio: np.ndarray, l2: float = 1e-3, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights of all buckets, the last for none, and the intercept: logistic regression on presence times ratio."""
    y = toxic.astype(np.float64)
    weight = np.zeros((1 << BITS) + 1, np.float32)
    if not len(y) or y.min() == y.max():
        return weight, 20.0 if len(y) and y.min() else -20.0
    used = np.flatnonzero(ratio)
    index = np.zeros(1 << BITS, np.int32)
    index[used] = np.arange(len(used))
    row = np.repeat(np.arange(len(y), dtype=np.int32), [len(b) for b in buckets])
    column = index[np.concatenate(buckets)] if len(used) else np.zeros(0, np.int32)
    value = ratio[used]
    w, b = np.zeros(len(used)), 0.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    class_weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    for k in range(1, steps + 1):
        z = np.bincount(row, (w * value)[column], len(y)) + b
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * class_weight
        g = np.concatenate((np.bincount(column, e[row], len(used)) * value + l2 * w, [e.sum()]))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    weight[used] = w * value
    return weight, float(b)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, least_ratio: float = LEAST_RATIO, least_rows: int = LEAST_ROWS) -> tuple[np.ndarray, float]:
    """Weights and intercept, fitted on about per_class labelled documents of each class, chosen by a hash of doc_id.

    A document with several labels is toxic if one says so; a null label says nothing.
    Executors count the buckets; the driver gets two numbers for each, and then the documents' buckets that have a ratio.
    """
    spark = docs.sparkSession
    known = X.need(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    chosen = F.lit(False)
    for c, n in sizes.items():
        chosen = chosen | ((F.col("toxic") == c) & (draw < min(1_000_000, 1_000_000 * per_class // n)))
    sample = X.need(docs, "doc_id", "text").where("text is not null").join(F.broadcast(known.where(chosen)), "doc_id")  # the sample is of bounded size

    def counts(batches):
        n = np.zeros((2, (1 << BITS) + 1), np.int32)
        for batch in batches:
            toxic = batch.column("toxic").to_numpy() > 0
            n[:, -1] += (toxic.sum(), (~toxic).sum())
            for lo, hi, doc, bucket in present(batch.column("text").to_pylist()):
                own = toxic[lo:hi][doc]
                n[0] += np.bincount(bucket[own], minlength=n.shape[1]).astype(np.int32)
                n[1] += np.bincount(bucket[~own], minlength=n.shape[1]).astype(np.int32)
        at = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[0, at]), pa.array(n[1, at])], names=["bucket", "p", "q"])

    found = sample.mapInArrow(counts, "bucket int, p int, q int").groupBy("bucket").agg(F.sum("p").cast("int").alias("p"), F.sum("q").cast("int").alias("q")).toArrow()
    n = np.zeros((2, (1 << BITS) + 1), np.int64)
    n[:, found.column("bucket").to_numpy()] = found.column("p").to_numpy(), found.column("q").to_numpy()
    ratio = ratios(n[0, :-1], n[1, :-1], n[0, -1], n[1, -1], least_ratio, least_rows)
    held = spark.sparkContext.broadcast(np.append(ratio != 0, False))

    def chosen_buckets(batches):
        for batch in batches:
            toxic = batch.column("toxic").to_pylist()
            for lo, hi, doc, bucket in present(batch.column("text").to_pylist(), held.value):
                at = np.searchsorted(doc, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([pa.array(toxic[lo:hi], pa.int32()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(bucket, pa.int32()))], names=["toxic", "buckets"])

    rows = sample.mapInArrow(chosen_buckets, "toxic int, buckets array<int>").toArrow()
    if not len(rows):
        return fit([], np.zeros(0), ratio)
    flat = rows.column("buckets").combine_chunks()
    values, offsets = flat.flatten().to_numpy(), np.concatenate(([0], np.cumsum(flat.value_lengths().to_numpy())))
    return fit([values[s:e] for s, e in zip(offsets, offsets[1:])], rows.column("toxic").to_numpy() > 0, ratio)


def scores(texts: list[str | None], weight: np.ndarray, intercept: float) -> np.ndarray:
    """Probability of each text to be toxic; 0 for one without an n-gram that has a weight, of which the model knows nothing."""
    out = np.zeros(len(texts))
    use = weight != 0
    for lo, hi, doc, bucket in present(texts, use):
        z = np.bincount(doc, weight[bucket], hi - lo) + intercept
        out[lo:hi] = np.where(np.bincount(doc, minlength=hi - lo) > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0)
    return out


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD, least_ratio: float = LEAST_RATIO, least_rows: int = LEAST_ROWS) -> DataFrame:
    """doc_id, score: the rows of docs with a probability of threshold or more to be toxic.

    Every text is scored whole; the broadcast model has 2 ** 20 weights, whatever the data.
    Null and empty texts, and those without an n-gram that is a feature, are never toxic. Repeated rows are scored each on its own;
    a null doc_id is kept. Without labels, with those of one class only, or with so few that no n-gram is in least_rows
    labelled documents, nothing is toxic. An empty table has no row.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class, least_ratio, least_rows))

    def run(batches):
        weight, intercept = held.value
        for batch in batches:
            s = scores(batch.column("text").to_pylist(), weight, intercept)
            pick = pa.array(s >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(pick), pa.array(s.round(6)).filter(pick)], names=["doc_id", "score"])

    return X.need(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
