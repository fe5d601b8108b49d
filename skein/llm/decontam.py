"""Benchmark decontamination: broadcast hash set of normalised test n-grams, whole texts scanned and hits verified."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import _text as X

N = 8
DROP_SHARE = 0.5
#: Characters of the benchmark whose n-grams are one broadcast; a larger benchmark is broadcast in parts, all of which a worker holds.
BROADCAST_CHARS = 1 << 26
SPAN = "array<struct<start:int,end:int>>"


class Grams:
    """Sorted hashes of the test n-grams, a bitmap that dismisses most windows, and the words to verify hits with."""

    def __init__(self, items: list[tuple[int, str]], n: int = N):
        self.n, by_len, self.words = n, {}, {}
        for item, text in items:
            for _, _, cp, bounds in X.chunks([text]):
                w = X.Words(cp, bounds)
                if not len(w):
                    continue
                size = min(n, len(w))
                low = [w.low[s:e].astype("<u4").tobytes() for s, e in zip(w.start, w.end)]
                at, h = w.ngrams(size)
                for p, x in zip(at.tolist(), h.tolist()):
                    self.words.setdefault(x, {}).setdefault(tuple(low[p : p + size]), set()).add(item)
                    by_len.setdefault(size, set()).add(x)
        self.sets = {k: np.array(sorted(v), np.uint64) for k, v in by_len.items()}
        self.maps = {}
        for k, v in self.sets.items():
            self.maps[k] = np.zeros(1 << 20, bool)
            self.maps[k][(v >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, w: X.Words):
        """(first word, number of words, items) of each verified window."""
        for size, found in self.sets.items():
            at, h = w.ngrams(size)
            near = np.flatnonzero(self.maps[size][(h >> np.uint64(44)).astype(np.int64)])
            near = near[found[np.minimum(np.searchsorted(found, h[near]), len(found) - 1)] == h[near]]
            for p, x in zip(at[near].tolist(), h[near].tolist()):
                words = tuple(w.low[w.start[i] : w.end[i]].astype("<u4").tobytes() for i in range(p, p + size))
                if words in self.words[x]:
                    yield p, size, self.words[x][words]


def scan(texts: list[str | None], *parts: Grams):
    """For each text with a verified hit in any part of the set: (row, items, [(start, end)], share of its words covered)."""
    for lo, _, cp, bounds in X.chunks(texts):
        w = X.Words(cp, bounds)
        covered, items = np.zeros(len(w) + 1, np.int32), {}
        for p, size, found in (hit for grams in parts for hit in grams.hits(w)):
            covered[p] += 1
            covered[p + size] -= 1
            items.setdefault(int(np.searchsorted(w.bounds, p, "right")) - 1, set()).update(found)
        covered = np.cumsum(covered[:-1]) > 0
        for d, found in items.items():
            a, b = w.bounds[d], w.bounds[d + 1]
            edge = np.diff(np.concatenate(([0], covered[a:b].view(np.int8), [0])))
            s, e = np.flatnonzero(edge == 1) + a, np.flatnonzero(edge == -1) + a - 1
            spans = [(int(w.start[i] - bounds[d]), int(w.end[j] - bounds[d])) for i, j in zip(s, e)]
            yield lo + d, sorted(found), spans, float(covered[a:b].mean())


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:s])
        at = e
    return "".join([*out, text[at:]])


def grams_of(benchmark: DataFrame, n: int) -> list:
    """Broadcasts of the test n-grams, in as many parts as their size, which is counted first, asks for."""
    sc = benchmark.sparkSession.sparkContext
    items = X.need(benchmark, "item_id", "text").where("item_id is not null and text is not null").distinct()
    parts = -(-(items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0) // BROADCAST_CHARS) or 1
    part = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    return [sc.broadcast(Grams(sorted((r["item_id"], r["text"]) for r in items.where(part == k).collect()), n)) for k in range(parts)]


def _found(texts, held):
    """scan() over all parts of the set at once, so that words which several parts cover count once."""
    return {row: (items, spans, share) for row, items, spans, share in scan(texts, *(part.value for part in held))}


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, drop_share: float = DROP_SHARE) -> DataFrame:
    """doc_id, item_ids, spans, share, action, clean_text: one row for each contaminated row of docs.

    Words are runs of letters and digits in lower case. Every window of n words
    of every text is looked up; a hit is compared word by word. Hits that touch
    are one span (character offsets). The document is to go ("drop") when spans
    cover more than drop_share of its words, else its spans are cut ("cut", clean_text).
    A benchmark text shorter than n words counts as one n-gram of its own length;
    one without words, a null text or a null item_id matches nothing. Null, empty and clean
    documents have no row, nor has an empty table; repeated rows and repeated benchmark rows change nothing else.
    """
    held = grams_of(benchmark, n)
    schema = pa.schema([("doc_id", pa.int64()), ("item_ids", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("share", pa.float64()), ("action", pa.string()), ("clean_text", pa.string())])

    def run(batches):
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            rows = [
                {"doc_id": ids[r].as_py(), "item_ids": items, "spans": [{"start": s, "end": e} for s, e in spans], "share": round(share, 6), "action": "drop" if share > drop_share else "cut", "clean_text": None if share > drop_share else cut(texts[r], spans)}
                for r, (items, spans, share) in sorted(_found(texts, held).items())
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return X.need(docs, "doc_id", "text").mapInArrow(run, f"doc_id long, item_ids array<long>, spans {SPAN}, share double, action string, clean_text string")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the spans cut, and without the documents that are mostly benchmark text; n_chars follows the text.

    Same columns, whatever their names. Null and empty texts stay, as do null doc_ids; repeated rows are cut each on its own, an empty
    table stays empty, and of an empty benchmark nothing is found.
    """
    held = grams_of(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), N)
    names = docs.columns

    def run(batches):
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            rows = _found(texts, held)
            keep = np.ones(len(texts), bool)
            for r, (_, spans, share) in rows.items():
                keep[r] = share <= DROP_SHARE
                texts[r] = cut(texts[r], spans)
            if rows:
                batch = replace_text(batch, names, texts)
            yield batch.filter(pa.array(keep))

    return X.map_rows(docs, run)


def replace_text(batch: pa.RecordBatch, names: list[str], texts: list[str | None]) -> pa.RecordBatch:
    columns = list(batch.columns)
    at = names.index("text")
    columns[at] = pa.array(texts, columns[at].type)
    if "n_chars" in names:
        k = names.index("n_chars")
        columns[k] = pa.array([None if t is None else len(t) for t in texts], columns[k].type)
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
