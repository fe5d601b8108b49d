"""Exact vector search: blocks of vectors against all queries as matrix products, so that only each block's best leave Python."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import lexical as L

#: Numbers of the queries' matrix that are broadcast at once; more queries are searched in several passes.
BROADCAST_NUMBERS = 1 << 22


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, cosine: bool = True, doc: str = "doc_id", query: str = "query_id", rows: Callable | None = None, kind: str | None = None) -> DataFrame:
    """query, doc, score, rank: the k vectors (doc, vector) with the largest dot product, or cosine, with each query's (query, vector); ties, to nine digits, go to the smaller id.

    A vector of length 0 has the cosine 0. Null vectors are left out. rows: makes names, of a type kind, and vectors of the batches of any other
    table vectors where they are searched, so that these never leave the worker.
    """
    if rows is None:
        vectors = vectors.where("vector is not null").select(F.col(doc).alias("doc"), F.col("vector").cast("array<double>").alias("vector"))
        kind, rows = vectors.schema["doc"].dataType.simpleString(), lambda batch: [(batch.column("doc"), _rows(batch.column("vector"), False))] if batch.num_rows else []
    queries = queries.where("vector is not null").select(F.col(query).alias("query"), F.col("vector").cast("array<double>").alias("vector"))
    kinds = f"query {queries.schema['query'].dataType.simpleString()}, doc {kind}, score double"
    size = queries.agg(F.sum(F.size("vector").cast("long"))).first()[0] or 0
    passes = -(-size // BROADCAST_NUMBERS) or 1
    part, found = F.pmod(F.xxhash64("query"), F.lit(passes)), None
    for p in range(passes):
        q = queries.where(part == p).toArrow().combine_chunks()
        if not len(q):
            continue
        names, matrix = q.column("query").combine_chunks(), _rows(q.column("vector"), cosine)
        held = vectors.sparkSession.sparkContext.broadcast((names, matrix))

        def run(batches, held=held):
            names, matrix = held.value
            for batch in batches:
                for ids, m in rows(batch):
                    score = matrix @ (_unit(m) if cosine else m).T
                    rounded = score.round(9)
                    least = np.partition(rounded, -min(k, score.shape[1]), axis=1)[:, -min(k, score.shape[1])][:, None] if k > 0 else np.inf
                    i, j = np.nonzero(rounded >= least)  # with all that tie with the last
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), ids.take(pa.array(j)), pa.array(score[i, j])], names=["query", "doc", "score"])

        hits = vectors.mapInArrow(run, kinds)
        found = hits if found is None else found.union(hits)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], kinds)
    return L.top_k(found.select(F.col("query").alias(query), F.col("doc").alias(doc), "score"), k, query, doc, positive=False)


def _rows(column, cosine: bool) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return _unit(m) if cosine else m


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)
