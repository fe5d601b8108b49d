"""Guarded serving: policy before ranking, results cached by everything they depend on, and the unguarded baseline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators import filters as P
from skein.operators import lexical as L


def roles_allowed(of_document: Column, roles: Column) -> Column:
    """Whether a document lists one of the roles; one that lists none is denied to all."""
    return F.coalesce(F.arrays_overlap(of_document, roles), F.lit(False))


@dataclass(frozen=True)
class Trace:
    cache_hit: bool
    generation: int
    candidates: int
    acl_filtered: int
    stale_filtered: int
    untrusted_filtered: int
    returned: tuple


class Guarded:
    """An index of docs (doc_id, text, roles, updated_at, trusted), kept current by upserts and deletes.

    A query's policy is applied in the order access, age, trust, and ranking then sees the documents that are left, with the term
    weights of the whole index. Results are cached by query, roles, generation and policy, so that a change or another role never meets a stale entry.
    """

    def __init__(self, docs: DataFrame, clock: str, max_age_days: int, require_trusted: bool = True):
        self.docs, self.clock, self.max_age_days, self.require_trusted = docs, clock, max_age_days, require_trusted
        self.generation, self.cache = 0, {}

    def key(self, query: str, roles: list[str], k: int) -> tuple:
        return query, tuple(sorted(roles)), k, self.generation, self.max_age_days, self.require_trusted

    def upsert(self, docs: DataFrame) -> None:
        ids = docs.select("doc_id").distinct()
        self.docs = self.docs.join(F.broadcast(ids) if ids.count() <= L.HELD_TERMS else ids, "doc_id", "left_anti").unionByName(docs)
        self.generation += 1

    def delete(self, doc_id) -> bool:
        """Whether there was such a document; only then the generation moves on."""
        if self.docs.where(F.col("doc_id") == doc_id).isEmpty():
            return False
        self.docs = self.docs.where(F.col("doc_id") != doc_id)
        self.generation += 1
        return True

    def judged(self, roles: list[str]) -> DataFrame:
        """docs with the reason of the first test each fails, or ok."""
        held = F.array(*map(F.lit, roles)).cast("array<string>")
        fresh = F.col("updated_at") >= F.lit(self.clock).cast("timestamp") - F.expr(f"INTERVAL {int(self.max_age_days)} DAYS")
        return P.first_failing(self.docs, roles_allowed(F.col("roles"), held), fresh, F.col("trusted") if self.require_trusted else F.lit(True))

    def query(self, query: str, roles: list[str], k: int = 1) -> Trace:
        key = self.key(query, roles, k)
        hit = key in self.cache
        if not hit:
            judged = self.judged(roles)
            counts = P.reason_counts(judged).first()
            q = self.docs.sparkSession.createDataFrame([(0, query)], "query_id int, text string")
            best = L.top_k(L.binary_scores(self.docs, q, True, among=judged.where("reason = 'ok'"), best=max(k, 1)), k)
            self.cache[key] = (*counts, tuple(r["doc_id"] for r in best.orderBy("rank").collect()))
        ok, acl, stale, untrusted, returned = self.cache[key]
        return Trace(hit, self.generation, ok, acl, stale, untrusted, returned)


class Unguarded(Guarded):
    """The baseline that shows what the guard is for: no policy, and a cache by query alone, which no change empties."""

    def key(self, query: str, roles: list[str], k: int) -> tuple:
        return (query,)

    def judged(self, roles: list[str]) -> DataFrame:
        return self.docs.withColumn("reason", F.lit("ok"))
