"""Access control, metadata filters and read-only SQL. Where a filter stands decides the scores, so each place is its own plan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import lexical as L


def tenant_allowed(tenant: Column, roles: Column, of_tenant: Column, of_role: Column) -> Column:
    """Own or shared tenant, and a role that is listed; an empty list is open to all."""
    open_ = F.size(F.coalesce(roles, F.array().cast("array<string>"))) == 0
    return (tenant.isin("shared") | (tenant == of_tenant)) & (open_ | F.coalesce(F.array_contains(roles, of_role), F.lit(False)))


def within(value: Column, low: Column | None, high: Column | None) -> Column:
    """Inclusive bounds; a bound that is None or null doesn't bind."""
    out = F.lit(True)
    if low is not None:
        out = out & (low.isNull() | (value >= low))
    if high is not None:
        out = out & (high.isNull() | (value <= high))
    return out


def search(docs: DataFrame, queries: DataFrame, allowed: Column, strategy: str, limit: int = 3, candidates: int | None = None) -> DataFrame:
    """query_id, doc_id, score, rank by BM25, unfiltered, filtered before or after ranking.

    prefilter: corpus statistics are those of the allowed documents. postfilter: the best candidates of
    the whole corpus are filtered; the limit between them keeps the optimizer from moving the filter down.
    """
    if strategy == "unfiltered":
        return L.bm25(docs, queries, limit)
    if strategy == "prefilter":
        return L.bm25(docs.where(allowed), queries, limit)
    if strategy != "postfilter":
        raise ValueError("strategy must be unfiltered, prefilter or postfilter")
    ranked = L.bm25(docs, queries, candidates or 2 * limit).select("query_id", "doc_id", "score")
    return L.top_k(ranked.join(docs.where(allowed).select("doc_id"), "doc_id", "left_semi"), limit)


def first_failing(docs: DataFrame, acl: Column, fresh: Column, trusted: Column) -> DataFrame:
    """docs with reason: acl, stale or untrusted, the first test that a document fails, or ok."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return docs.withColumn("reason", F.when(no(acl), "acl").when(no(fresh), "stale").when(no(trusted), "untrusted").otherwise("ok"))


def reason_counts(docs: DataFrame) -> DataFrame:
    return docs.agg(*[F.count_if(F.col("reason") == r).alias(n) for r, n in (("ok", "candidates"), ("acl", "acl_filtered"), ("stale", "stale_filtered"), ("untrusted", "untrusted_filtered"))])


def guarded_search(docs: DataFrame, queries: DataFrame, acl: Column, fresh: Column, trusted: Column, k: int = 1) -> DataFrame:
    """query_id, doc_id, score, rank among the documents that pass, by binary term weights of the whole index; all terms must occur."""
    ok = first_failing(docs, acl, fresh, trusted).where("reason = 'ok'")
    return L.top_k(L.binary_scores(docs, queries, True, among=ok, best=max(k, 1)), k)


def canonical_dedupe(pages: DataFrame, canonical: Column, *order: Column) -> DataFrame:
    """The first page, in the order given, of each canonical address."""
    w = Window.partitionBy("_canonical").orderBy(*order)
    return pages.withColumn("_canonical", canonical).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_canonical")


_VERBS = ("alter", "attach", "create", "delete", "detach", "drop", "grant", "insert", "merge", "pragma", "replace", "truncate", "update", "vacuum")
_FORBIDDEN = re.compile(rf"\b(?:{'|'.join(_VERBS)})\b", re.I)


def read_only(sql: str, tables: set[str], known: set[str]) -> tuple[bool, str]:
    """Whether a statement may run, and why not: one SELECT or WITH over known tables."""
    text = sql.strip()
    if text == "":
        return False, "no statement"
    if ";" in text.rstrip(";") or text.count(";") > 1:
        return False, "multiple statements"
    if text.split(None, 1)[0].lower() not in ("select", "with"):
        return False, "not a SELECT"
    if _FORBIDDEN.search(text):
        return False, "mutating or administrative SQL"
    unknown = sorted(tables - known)
    return (False, "unknown tables: " + ", ".join(unknown)) if unknown else (True, "")
