"""Substring dedup by recompression: equal word strings get equal symbols inside, which reveal repeats that are then verified word by word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import _text as X
from skein.llm.decontam import cut

ROUNDS = 8
CAP = 12
WINDOW = 20
#: Words of the shortest passage that is reported.
LEAST = 50


def _salt(r: int, k: int) -> np.uint64:
    return np.uint64((0xD1B54A32D192ED03 * (2 * r + k + 1)) & (1 << 64) - 1)


def recompress(sym: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS, cap: int = CAP) -> tuple[np.ndarray, np.ndarray]:
    """Names and first words of the phrases into which some rounds parse the words.

    A round names every run of one symbol, then every pair whose left symbol
    falls on the left and whose right symbol on the right side of a partition of all
    symbols. Names and sides are hashes of what they stand for, so they are the
    same in every task and document without exchange; phrases grow to cap words.
    """
    first, size = np.arange(len(sym)), np.ones(len(sym), np.int64)
    for r in range(rounds):
        if not len(sym):
            break
        new = np.concatenate(([True], (sym[1:] != sym[:-1]) | (doc[first[1:]] != doc[first[:-1]])))
        at = np.flatnonzero(new)
        times = np.diff(np.concatenate((at, [len(sym)])))
        whole = (times > 1) & (times * size[at] <= cap)
        drop = np.repeat(whole, times) & ~new
        sym[at[whole]] = X.mix(sym[at[whole]] * np.uint64(3) + times[whole].astype(np.uint64) * _salt(r, 0))
        size[at[whole]] *= times[whole]
        sym, first, size = sym[~drop], first[~drop], size[~drop]
        side = (X.mix(sym + _salt(r, 1)) & np.uint64(1)).astype(bool)
        pair = np.flatnonzero(~side[:-1] & side[1:] & (doc[first[:-1]] == doc[first[1:]]) & (size[:-1] + size[1:] <= cap))
        sym[pair] = X.mix(sym[pair] * np.uint64(0x9E3779B97F4A7C15) + X.mix(sym[pair + 1]) + _salt(r, 0))
        size[pair] += size[pair + 1]
        keep = np.ones(len(sym), bool)
        keep[pair + 1] = False
        sym, first, size = sym[keep], first[keep], size[keep]
    return sym, first


def windows(w: X.Words, window: int = WINDOW, rounds: int = ROUNDS, cap: int = CAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each phrase with enough words after it: a name of the phrases that cover the next window words, the first of these words and the one after the last."""
    doc = w.docs()
    sym, first = recompress(w.hash.copy(), doc, rounds, cap)
    n = len(first)
    if not n:
        return np.zeros(0, np.uint64), first, first
    ends = np.concatenate((first, [len(w)]))
    stop = w.bounds[1:][doc[first]]
    j = np.searchsorted(ends, first + window, "left")
    j = np.minimum(j, n)
    last = ends[j]
    ok = np.flatnonzero((first + window <= last) & (last <= stop))
    pw, inv = X.powers(n)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(sym * pw[:n], dtype=np.uint64)))
    key = X.mix((total[j[ok]] - total[ok]) * inv[ok] + (j[ok] - ok).astype(np.uint64))
    return key, first[ok], last[ok]


def _rows(batches, window, rounds, cap):
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for lo, _, cp, bounds in X.chunks(batch.column("text").to_pylist()):
            w = X.Words(cp, bounds)
            key, a, b = windows(w, window, rounds, cap)
            d = w.docs()[a] if len(a) else a
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[lo + d].astype(np.int64)), pa.array((a - w.bounds[d]).astype(np.int32)), pa.array((b - a).astype(np.int32))], names=["key", "doc_id", "at", "n"])


def runs(own: np.ndarray, other: np.ndarray, at: np.ndarray, source: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(first word, word after the last, first word in the other document) of the maximal equal runs of at least so many words around the places at, which seem to be at source in other.

    own, other: hashes of the words. What a run covers isn't looked at again.
    """
    out, done = [], 0
    for i, j in sorted(zip(at.tolist(), source.tolist())):
        if i < done:
            continue
        shift = i - j
        lo, hi = max(0, shift), min(len(own), len(other) + shift)
        if not lo <= i < hi:
            continue
        differ = np.flatnonzero(own[lo:hi] != other[lo - shift : hi - shift]) + lo
        k = int(np.searchsorted(differ, i))
        s, e = int(differ[k - 1]) + 1 if k else lo, int(differ[k]) if k < len(differ) else hi
        if e - s >= least:
            out.append((s, e, s - shift))
            done = e
    return out


def _verified(batches, least):
    """Pairs of documents with the places that have equal names: spans of the words that are equal indeed."""
    for whole in batches:
        for begin in range(0, whole.num_rows, 64):
            batch = whole.slice(begin, 64)
            texts, sources, places = (batch.column(c).to_pylist() for c in ("text", "source_text", "places"))
            out = []
            for first, last, cp, bounds in X.chunks([x for pair in zip(texts, sources) for x in pair], 1 << 62):
                w = X.Words(cp, bounds)
                for k in range(first, last, 2):
                    (a, b), (c, d) = w.bounds[k : k + 2], w.bounds[k + 1 : k + 3]
                    at, source = (np.array([x[n] for x in places[k // 2]]) for n in ("at", "source_at"))
                    for s, e, f in runs(w.hash[a:b], w.hash[c:d], at, source, least):
                        out.append((k // 2, int(w.start[a + s] - bounds[k]), int(w.end[a + e - 1] - bounds[k]), int(w.start[c + f] - bounds[k + 1]), e - s))
            rows = pa.array([r[0] for r in out], pa.int64())
            own = [batch.column(c).take(rows) for c in ("doc_id", "source_doc_id")]
            start, end, source_start, n = (pa.array([r[i] for r in out], pa.int32()) for i in range(1, 5))
            yield pa.RecordBatch.from_arrays([own[0], start, end, own[1], source_start, n], names=["doc_id", "start", "end", "source_doc_id", "source_start", "n_words"])


def repeats(docs: DataFrame, least: int = LEAST, window: int = WINDOW, rounds: int = ROUNDS, cap: int = CAP) -> DataFrame:
    """doc_id, start, end, source_doc_id, source_start, n_words: passages of docs that occur earlier.

    Earlier means at a smaller doc_id, or further left in the same document.
    Phrases from recompression are strung together to windows of at least window words; a window whose name occurred before
    reveals a repeat. The two documents are then brought together, and their words compared to the left and to the right, so
    a passage is a maximal run of equal words, verified word by word (64-bit hashes of the words), and has at least least words.
    Passages that overlap in a document are one (character offsets, n_words of the longest). A passage whose windows of 20 words all have their first
    occurrences in documents that share fewer than least words with it is missed, as is one in about 500 of 50 words, in which no window is whole.
    Words are runs of letters and digits in lower case.
    Null doc_ids and null, empty or short texts have no row, nor has an empty table; of rows that
    repeat a doc_id the text that is first in order counts.
    """
    one = X.need(docs, "doc_id", "text").where("doc_id is not null and text is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    keys = one.mapInArrow(lambda b: _rows(b, window, rounds, cap), "key long, doc_id long, at int, n int")
    order = Window.partitionBy("key").orderBy("doc_id", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = keys.withColumn("source", F.first(F.struct("doc_id", "at")).over(order)).where((F.col("doc_id") != F.col("source.doc_id")) | (F.col("at") != F.col("source.at")))
    pairs = seen.groupBy("doc_id", F.col("source.doc_id").alias("source_doc_id")).agg(F.collect_list(F.struct("at", F.col("source.at").alias("source_at"))).alias("places"))
    held = pairs.join(one, "doc_id").join(one.select(F.col("doc_id").alias("source_doc_id"), F.col("text").alias("source_text")), "source_doc_id")
    found = held.mapInArrow(lambda b: _verified(b, least), "doc_id long, start int, end int, source_doc_id long, source_start int, n_words int")
    by_doc = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    return (
        found.withColumn("fresh", F.when(before >= F.col("start"), 0).otherwise(1))
        .withColumn("island", F.sum("fresh").over(by_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy("doc_id", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("source_doc_id", "source_start")).alias("source"), F.max("n_words").alias("n_words"))
        .select("doc_id", "start", "end", "source.source_doc_id", "source.source_start", "n_words")
    )


def remove(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the passages of repeats() cut from their text; same rows and columns.

    Rows with a null doc_id or text, or without a passage, stay as they are; other columns may have any name.
    """
    key, found = X.fresh(docs, "key"), X.fresh(docs, "found")
    held = spans.groupBy(F.col("doc_id").alias(key)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(found))
    joined = docs.join(held, docs["doc_id"] == F.col(key), "left").drop(key)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts, spans = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            columns = list(batch.columns)
            columns[at] = pa.array([cut(t, [(s["start"], s["end"]) for s in f]) if f and t else t for t, f in zip(texts, spans)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return X.map_rows(joined, run).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
