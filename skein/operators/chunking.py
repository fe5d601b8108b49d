"""Chunkers. Fixed windows are arithmetic on positions; greedy packing is a fold over a document's units."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import vectors as V
from skein.functions.batches import slices
from skein.operators import lexical as L
from skein.operators.graph import use_checkpoints

_SPACE, _SENTENCE, _PARAGRAPH = re.compile(r"\s+", re.A), re.compile(r"(?<=[!?.])\s+", re.A), re.compile(r"\n\s*\n", re.A)


def windows(text: str, size: int, overlap: int) -> list[list[str]]:
    """The words of each window of a text."""
    w, step = [x for x in _SPACE.split(text) if x], size - overlap
    return [w[i * step : i * step + size] for i in range(1 + -(-max(0, len(w) - size) // step) if w else 0)]


def fixed(docs: DataFrame, size: int = 80, overlap: int = 10, doc: str = "doc_id") -> DataFrame:
    """chunk_id, doc, start_word, end_word, text of word windows; the first that reaches the end is the last."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive, overlap less than size")
    kind, step = docs.schema[doc].dataType.simpleString(), size - overlap

    def run(batches):
        for batch in batches:
            for lo, texts in slices(batch.column("text")):
                at, nth, end, out = [], [], [], []
                for row, text in enumerate(texts):
                    for i, w in enumerate(windows(text, size, overlap)):
                        at.append(lo + row)
                        nth.append(i)
                        end.append(i * step + len(w))
                        out.append(" ".join(w))
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(at, pa.int64())), *[pa.array(x, pa.int32()) for x in (nth, end)], pa.array(out, pa.string())], names=["doc", "i", "e", "text"])

    c = docs.select(F.col(doc).alias("doc"), "text").mapInArrow(run, f"doc {kind}, i int, e int, text string")
    return c.select(F.concat(F.col("doc").cast("string"), F.lit("::chunk-"), F.col("i").cast("string")).alias("chunk_id"), F.col("doc").alias(doc), (F.col("i") * step).alias("start_word"), F.col("e").alias("end_word"), "text")


def pack(counts: list[int], limit: int, overlap: int = 0, cuts: list[bool] | None = None) -> list[tuple[int, int]]:
    """Greedy packing of units with word counts: (first unit, one past the last) of each chunk.

    A unit goes to the current chunk unless the limit is passed (a larger unit alone is a chunk) or cuts says so
    before it. A chunk begins overlap units before the end of the last, at least one after its beginning.
    """
    out, lo, n = [], 0, len(counts)
    while lo < n:
        hi, words = lo, 0
        while hi < n and (hi == lo or (words + counts[hi] <= limit and not (cuts is not None and cuts[hi]))):
            words += counts[hi]
            hi += 1
            if words >= limit and cuts is None:
                break
        out.append((lo, hi))
        if hi >= n:
            break
        lo = max(lo + 1, hi - overlap)
    return out


def _clean(text: str) -> str:
    return _SPACE.sub(" ", text).strip(" ")


def sentences(text: str) -> list[str]:
    """As text.sentences()."""
    return [x for x in _SENTENCE.split(_clean(text)) if x]


def paragraphs(text: str) -> list[str]:
    """As text.paragraphs()."""
    return [x for x in map(_clean, _PARAGRAPH.split(text)) if x]


def _chunks(docs: DataFrame, prefix: str, units: Callable, limit: int, overlap: int, doc: str, cuts: Callable | None = None) -> DataFrame:
    """chunk_id, doc, start_word, end_word, text: packed units of each text. cuts gets the units of some texts, one after the other, and tells before which of them a chunk may end.

    A pack depends on all before it, so Python folds; it has the text in slices and gives back chunks as Arrow arrays.
    """
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo, texts in slices(batch.column("text")):
                every = [units(x) for x in texts]
                cut = cuts([u for x in every for u in x]) if cuts else None
                at, nth, start, end, out, first = [], [], [], [], [], 0
                for row, u in enumerate(every):
                    counts = [x.count(" ") + 1 for x in u]
                    ends = [0]
                    for n in counts:
                        ends.append(ends[-1] + n)
                    for i, (a, b) in enumerate(pack(counts, limit, overlap, cut[first : first + len(u)] if cuts else None)):
                        at.append(lo + row)
                        nth.append(i)
                        start.append(ends[a])
                        end.append(ends[b])
                        out.append(" ".join(u[a:b]))
                    first += len(u)
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(at, pa.int64())), *[pa.array(x, pa.int32()) for x in (nth, start, end)], pa.array(out, pa.string())], names=["doc", "i", "s", "e", "text"])

    c = docs.select(F.col(doc).alias("doc"), "text").mapInArrow(run, f"doc {kind}, i int, s int, e int, text string")
    return c.select(F.concat(F.col("doc").cast("string"), F.lit(f"::{prefix}-"), F.col("i").cast("string")).alias("chunk_id"), F.col("doc").alias(doc), F.col("s").alias("start_word"), F.col("e").alias("end_word"), "text")


def document_of(chunk_id: str, docs: DataFrame, doc: str = "doc_id") -> Column:
    """The document that a chunk's id begins with, of the type it has in docs."""
    return F.regexp_extract(chunk_id, r"(?s)^(.*)::[a-z]+-[0-9]+$", 1).cast(docs.schema[doc].dataType)


def sentence(docs: DataFrame, max_words: int = 80, overlap: int = 0, doc: str = "doc_id") -> DataFrame:
    """Chunks of whole sentences of max_words at most, a longer sentence alone."""
    return _chunks(docs, "sentence", sentences, max_words, overlap, doc)


def paragraph(docs: DataFrame, max_words: int = 160, overlap: int = 0, doc: str = "doc_id") -> DataFrame:
    """Chunks of whole paragraphs."""
    return _chunks(docs, "paragraph", paragraphs, max_words, overlap, doc)


def semantic(docs: DataFrame, max_words: int = 100, threshold: float = 0.08, dimensions: int = 256, doc: str = "doc_id") -> DataFrame:
    """Chunks of sentences, split where the limit is passed or the hashed vectors of neighbours are less similar than threshold."""
    if max_words <= 0 or not -1 <= threshold <= 1:
        raise ValueError("max_words must be positive, threshold in [-1, 1]")
    held: list[V.Hashes] = []

    def cuts(units: list[str], rows: int = 2048) -> list[bool]:
        if not held:
            held.append(V.Hashes(dimensions))
        out = []
        for lo in range(0, len(units), rows):  # each with the unit before it; a cut before a text's first unit means nothing
            v = held[0].vectors([x.lower() for x in units[max(lo - 1, 0) : lo + rows]])
            p, same = v[:-1] * v[1:], np.zeros(len(v) - 1)
            for j in range(dimensions):  # in order, as a fold adds
                same += p[:, j]
            out += ([False] if lo == 0 else []) + (same < threshold).tolist()
        return out

    return _chunks(docs, "semantic", sentences, max_words, 0, doc, cuts)


def enriched(chunks: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """chunks whose text begins with a line "field: value | ..." of the fields that aren't null or empty."""
    parts = [F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{k}: "), v)) for k, v in fields.items()]
    head = F.concat_ws(" | ", *parts)
    return chunks.withColumn("text", F.when(head == "", F.col("text")).otherwise(F.concat(head, F.lit("\n"), F.col("text"))))


def parents(children: DataFrame, parent: DataFrame, doc: str = "doc_id") -> DataFrame:
    """child_id, parent_id: for each child chunk the parent chunk that it overlaps most, the first of equals."""
    c = children.select(doc, F.col("chunk_id").alias("child_id"), F.col("start_word").alias("cs"), F.col("end_word").alias("ce"))
    p = parent.select(doc, F.col("chunk_id").alias("parent_id"), F.col("start_word").alias("ps"), F.col("end_word").alias("pe"))
    o = c.join(p, doc).withColumn("o", F.least("ce", "pe") - F.greatest("cs", "ps")).where("o > 0")
    w = Window.partitionBy("child_id").orderBy(F.desc("o"), "ps")
    return o.withColumn("r", F.row_number().over(w)).where("r = 1").select("child_id", "parent_id")


def parent_child_search(docs: DataFrame, queries: DataFrame, k: int = 3, child_k: int = 8, child_words: int = 35, parent_words: int = 160) -> DataFrame:
    """query_id, parent_id, score, rank: BM25 over child chunks; the scores of the max(k, child_k) best are summed by parent."""
    use_checkpoints(docs.sparkSession)
    child = sentence(docs, child_words)
    hits = L.bm25(child.drop("doc_id").withColumnRenamed("chunk_id", "doc_id"), queries, max(k, child_k)).checkpoint()
    found = docs.join(F.broadcast(hits.select(document_of("doc_id", docs).alias("doc_id")).distinct()), "doc_id", "left_semi").checkpoint()
    link = parents(sentence(found, child_words), paragraph(found, parent_words))
    s = hits.join(link, hits["doc_id"] == link["child_id"]).groupBy("query_id", "parent_id").agg(F.sum("score").alias("score"))
    return L.top_k(s, k, doc="parent_id")


def hierarchical_search(docs: DataFrame, queries: DataFrame, k: int = 3, route_k: int = 2, head: Column | None = None, leaf_words: int = 35) -> DataFrame:
    """query_id, chunk_id, score, rank: BM25 of leaves plus that of their document, for the route_k best documents only."""
    use_checkpoints(docs.sparkSession)
    root = docs.withColumn("text", F.concat_ws(" ", head, "text")) if head is not None else docs
    route = L.bm25(root, queries, route_k).select("query_id", "doc_id", F.col("score").alias("route")).checkpoint()
    near = docs.join(F.broadcast(route.select("doc_id").distinct()), "doc_id", "left_semi")
    s = L.bm25_scores(sentence(docs, leaf_words), queries, doc="chunk_id", among=sentence(near, leaf_words))
    s = s.withColumn("doc_id", document_of("chunk_id", docs)).join(route, ["query_id", "doc_id"])
    return L.top_k(s.select("query_id", "chunk_id", (F.col("score") + F.col("route")).alias("score")), k, doc="chunk_id")
