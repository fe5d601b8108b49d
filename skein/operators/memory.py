"""Versioned records: latest and previous versions, as-of joins, temporal memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import lexical as L


def version(events: DataFrame, key: str, *order: str, back: int = 0) -> DataFrame:
    """The last row of each key by the columns of order, or one that lies back before it; a key without has none."""
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return events.withColumn("_v", F.row_number().over(w)).where(F.col("_v") == back + 1).drop("_v")


def memory_search(events: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """query_id, event_id, score, rank over events (event_id, memory_key, sequence, text).

    Keys are ranked by their best event; of a key the last version counts, or
    the one before it, where there is one, if the query says "before" or "previous".
    """
    hits = L.bm25_scores(events, queries, doc="event_id").join(events.select("event_id", "memory_key"), "event_id")
    keys = hits.groupBy("query_id", "memory_key").agg(F.max("score").alias("score"))
    past = queries.select("query_id", F.arrays_overlap(T.tokens("text"), F.array(F.lit("before"), F.lit("previous"))).alias("past"))
    w = Window.partitionBy("memory_key").orderBy(F.desc("sequence"), F.desc("event_id"))
    v = events.select("memory_key", "event_id", F.row_number().over(w).alias("v"), F.count("*").over(Window.partitionBy("memory_key")).alias("n"))
    s = keys.join(past, "query_id").join(v, "memory_key").where(F.col("v") == F.when(F.col("past") & (F.col("n") > 1), 2).otherwise(1))
    return L.top_k(s.select("query_id", "event_id", "score"), k, doc="event_id")


def as_of(facts: DataFrame, versions: DataFrame, key: str, at: str, start: str = "valid_from", end: str = "valid_to", *order: str) -> DataFrame:
    """facts with the version of their key that is valid at column at (both ends included, a null end is open), the newest by start and order.

    Versions are joined on the key and filtered by interval, so a key's versions only meet its own facts. Facts without a valid version are left out.
    """
    f = facts.withColumn("_fact", F.monotonically_increasing_id())
    j = f.join(versions, key).where((F.col(start) <= F.col(at)) & (F.col(end).isNull() | (F.col(at) <= F.col(end))))
    w = Window.partitionBy("_fact").orderBy(F.desc(start), *[F.desc(o) for o in order])
    return j.withColumn("_v", F.row_number().over(w)).where("_v = 1").drop("_v", "_fact")


def as_of_last(facts: DataFrame, events: DataFrame, key: str, fact_time: str, event_time: str, *carry: str) -> DataFrame:
    """facts with the columns carry of the last event of their key at or before their time; null if there is none.

    Facts and events are united and swept once in time order: one shuffle on the key, no range join, so a key with many events stays linear.
    """
    cols = facts.columns
    f = facts.select(F.col(key), F.col(fact_time).alias("_t"), F.lit(1).alias("_kind"), F.struct(*cols).alias("_fact"), *[F.lit(None).cast(events.schema[c].dataType).alias(f"_{c}") for c in carry])
    e = events.select(F.col(key), F.col(event_time).alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast(f.schema["_fact"].dataType).alias("_fact"), *[F.col(c).alias(f"_{c}") for c in carry])
    w = Window.partitionBy(key).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    packed = F.when(F.col("_kind") == 0, F.struct(*[F.col(f"_{c}").alias(c) for c in carry]))
    s = f.unionByName(e).withColumn("_last", F.last(packed, ignorenulls=True).over(w)).where("_kind = 1")
    return s.select("_fact.*", *[F.col(f"_last.{c}").alias(c) for c in carry])


def effective(start: Column, end: Column, at: Column) -> Column:
    return (start <= at) & (end.isNull() | (at <= end))


def breached(reported: Column, at: Column, hours: Column) -> Column:
    """Whether more than so many hours passed; null if anything is unknown."""
    return (F.unix_timestamp(at) - F.unix_timestamp(reported)) > hours * 3600
