"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import _text as X

BITS = 16
ORDERS = (2, 3)
UNKNOWN = "und"


def features(cp: np.ndarray, bounds: np.ndarray, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of a chunk, a row for each order, and the bounds of its documents.

    Letters are lowered, every run of other characters becomes one space; an
    n-gram that leaves its document has the bucket 2 ** bits, which no model scores.
    """
    low = X.lower(cp)
    letter = X.flags(low, "alpha")
    c = np.where(letter, low, np.uint32(32)).astype(np.uint32)
    first = np.zeros(len(c) + 1, bool)
    first[bounds] = True
    keep = letter | np.concatenate(([True], letter[:-1])) | first[:-1] if len(c) else letter
    b = np.concatenate(([0], np.cumsum(keep)))[bounds]
    c = c[keep]
    n, room = len(c), np.repeat(b[1:], np.diff(b)) - np.arange(len(c))
    out = np.full((len(orders), n), 1 << bits, np.int32)
    code = c * np.uint32(0x9E3779B1)
    for k, order in enumerate(orders):
        if n < order:
            continue
        h = code[: n - order + 1].copy()
        for j in range(1, order):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + code[j : n - order + 1 + j]
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE35)
        out[k, : n - order + 1] = np.where(room[: n - order + 1] >= order, h >> np.uint32(32 - bits), 1 << bits)
    return out, b


def _counts(batches):
    for batch in batches:
        frame = []
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for lang in sorted({x for x in langs if x}):
            own, count = [t for t, x in zip(texts, langs) if x == lang], np.zeros((1 << BITS) + 1, np.int64)
            for _, _, cp, bounds in X.chunks(own):
                count += np.bincount(features(cp, bounds)[0].ravel(), minlength=len(count))
            at = np.flatnonzero(count[:-1])
            frame.append(pd.DataFrame({"lang": lang, "bucket": at, "n": count[at]}))
        if frame:
            yield pa.RecordBatch.from_pandas(pd.concat(frame), preserve_index=False, schema=pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("n", pa.int64())]))


def train(docs: DataFrame, per_lang: int = 2000, alpha: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Log-probability matrix (2 ** BITS + 1, languages + 1) from the rows' lang.

    Fitted on about per_lang labelled rows of each language, chosen by a hash of
    doc_id. The last column is the uniform distribution, which stands for "none
    of these languages"; the last row, of n-grams that don't count, is 0.
    """
    rows = X.need(docs, "doc_id", "lang", "text").where("lang is not null and text is not null and lang <> ''")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros(((1 << BITS) + 1, 1), np.float32)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    share = F.create_map(*[F.lit(v) for x in langs for v in (x, max(1, min(1_000_000, 1_000_000 * per_lang // sizes[x])))])
    sample = rows.where(draw < share[F.col("lang")]).select("lang", "text")
    found = sample.mapInArrow(_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    count = np.zeros((1 << BITS, len(langs)))
    count[found["bucket"].to_numpy(np.int64), found["lang"].map(langs.index).to_numpy(np.int64)] = found["n"]
    model = np.zeros(((1 << BITS) + 1, len(langs) + 1), np.float32)
    model[:-1, :-1] = np.log(count + alpha) - np.log(count.sum(0) + alpha * (1 << BITS))
    model[:-1, -1] = -BITS * np.log(2)
    return langs, model


def score(texts: list[str | None], langs: list[str], model: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The language of each text and its posterior probability; UNKNOWN where it has no n-gram, or none fits."""
    names, best, prob = np.array([*langs, UNKNOWN], object), [], []
    for lo, hi, cp, bounds in X.chunks(texts):
        f, b = features(cp, bounds)
        total = np.zeros((hi - lo, model.shape[1]))
        some = np.flatnonzero(np.diff(b))
        if len(some):
            for row in f:
                total[some] += np.add.reduceat(model[row], b[some], axis=0, dtype=np.float64)
        top = np.where(total.any(1), total.argmax(1), len(langs))
        e = np.exp(total - total.max(1, keepdims=True))
        best += names[top].tolist()
        prob.append((e[np.arange(len(top)), top] / e.sum(1)).round(6))
    return best, np.concatenate(prob) if prob else np.zeros(0)


def identify(docs: DataFrame, per_lang: int = 2000) -> DataFrame:
    """doc_id, lang_pred, confidence, keep: one row for each row of docs.

    Every text is scored whole against a broadcast matrix of 2 ** 16 buckets,
    whose size does not depend on the data. keep is false where the language is
    unknown: a null or empty text, one without any two letters in sequence, or one that the
    uniform distribution explains better than any language. A table without
    labelled rows has no model: all is unknown. Repeated rows are scored each on
    its own, a null doc_id is kept as it is, ties take the first language by name.
    """
    spark = docs.sparkSession
    langs, model = train(docs, per_lang)
    held = spark.sparkContext.broadcast((langs, model))

    def run(batches):
        langs, model = held.value
        for batch in batches:
            best, prob = score(batch.column("text").to_pylist(), langs, model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(best, pa.string()), pa.array(prob, pa.float64()), pa.array([x != UNKNOWN for x in best], pa.bool_())],
                names=["doc_id", "lang_pred", "confidence", "keep"],
            )

    return X.need(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, confidence double, keep boolean")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the documents whose language is unknown; same columns."""
    langs, model = train(docs)
    held = spark.sparkContext.broadcast((langs, model))
    at = docs.columns.index("text")

    def run(batches):
        langs, model = held.value
        for batch in batches:
            best, _ = score(batch.column(at).to_pylist(), langs, model)
            yield batch.filter(pa.array([x != UNKNOWN for x in best], pa.bool_()))

    return X.map_rows(docs, run)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
