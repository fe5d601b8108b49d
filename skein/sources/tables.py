"""Relational sources: schema with keys, rows as records with provenance, guarded SQL and its evidence."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import filters
from skein.operators import lexical as L

#: Bytes of the tables of a spread statement for each of its partitions.
SPREAD_BYTES = 4 << 20
KEYS = {"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",)}


@dataclass(frozen=True)
class TableInfo:
    """A table's name, its key columns, which give its rows their provenance, and all its columns."""

    name: str
    key: tuple[str, ...]
    columns: tuple[str, ...]


class Tables:
    """Parquet tables of a folder, registered as views and read-only by construction; Spark has no keys, so they are kept here."""

    def __init__(self, spark: SparkSession, folder: str, keys: dict[str, tuple[str, ...]] | None = None):
        self.spark, self.folder, self.keys = spark, folder, keys or KEYS

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def schema(self) -> dict[str, TableInfo]:
        return {n: TableInfo(n, k, tuple(self.read(n).columns)) for n, k in sorted(self.keys.items())}

    def row_counts(self) -> DataFrame:
        return reduce(DataFrame.union, [self.read(n).agg(F.lit(n).alias("table"), F.count("*").alias("n_rows")) for n in sorted(self.keys)])

    def records(self, *names: str) -> DataFrame:
        """record_id (table:key[:key]), content (column=value ...; a null is None)."""
        parts = []
        for n in names or sorted(self.keys):
            t = self.read(n)
            content = F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in t.columns])
            key = self.keys[n] or (t.columns[0],)
            parts.append(t.select(F.concat_ws(":", F.lit(n), *key).alias("record_id"), content.alias("content")))
        return reduce(DataFrame.union, parts)

    def spread(self, tables: tuple[str, ...]) -> dict[str, DataFrame]:
        """The tables dealt by their first keys to partitions in number of their size, so that no task of a join grows with them; as they are if they are small."""
        read = {n: self.read(n) for n in tables}
        parts = -(-sum(int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in read.values()) // SPREAD_BYTES)
        return {n: t.repartition(min(parts, 20_000), self.keys[n][0]) if parts > 32 and self.keys[n] else t for n, t in read.items()}

    def execute(self, sql: str, tables: tuple[str, ...], args: list | None = None, spread: bool = False) -> DataFrame:
        """One SELECT over known tables, with positional parameters; anything else is refused. spread: for statements that join whole tables and return their rows."""
        ok, reason = filters.read_only(sql, set(tables) | self.named(sql), set(self.keys))
        if not ok:
            raise ValueError(reason)
        for n, t in (self.spread(tables) if spread else {n: self.read(n) for n in tables}).items():
            t.createOrReplaceTempView(n)
        return self.spark.sql(sql, args=args or [])

    def named(self, sql: str) -> set[str]:
        """The relations that a statement reads, by its parsed plan, but for those it defines itself; empty if it can't be parsed."""
        try:
            plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        except Exception:
            return set()
        found = {m.lower() for m in re.findall(r"'UnresolvedRelation \[([^\]]*)\]", plan.toString())}
        own = {m.lower() for m in re.findall(r"(?:\bwith|,)\s*(?:recursive\s+)?(\w+)\s*(?:\([^()]*\))?\s+as\s*\(", sql, re.I)}
        return {f.replace(", ", ".") for f in found} - own

    def record(self, record_id: str) -> DataFrame:
        """The row of records() with this id, which is one table's; a KeyError if no table has the name."""
        name = record_id.split(":", 1)[0]
        if name not in self.keys:
            raise KeyError(record_id)
        return self.records(name).where(F.col("record_id") == record_id)

    def source_records(self, *names: str) -> DataFrame:
        """record_id, source_type, locator, title, content, metadata: rows as records of a source."""
        r = self.records(*names).withColumn("title", F.substring_index("record_id", ":", 1))
        meta = F.create_map(*[x for n in names or sorted(self.keys) for x in (F.lit(n), F.lit(",".join(self.read(n).columns)))])
        return r.select("record_id", F.lit("table_row").alias("source_type"), F.concat(F.lit("tables://"), F.replace("record_id", F.lit(":"), F.lit("/"))).alias("locator"), "title", "content", F.create_map(F.lit("table"), F.col("title"), F.lit("columns"), meta[F.col("title")]).alias("metadata"))

    def search(self, queries: DataFrame, *names: str, limit: int = 5) -> DataFrame:
        """query_id, record_id, score, rank: BM25 over rows as text."""
        return L.bm25(self.records(*names).select("record_id", F.col("content").alias("text")), queries, limit, doc="record_id")


def format_answer(rows: list[tuple]) -> str:
    """Rows as one string: NO_ROWS, a scalar, values joined by "; ", or rows joined by " | "; whole floats lose their .0."""
    show = lambda v: str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    if not rows:
        return "NO_ROWS"
    if len(rows[0]) == 1:
        return "; ".join(show(r[0]) for r in rows)
    if len(rows[0]) == 2:
        return "; ".join(f"{show(a)}={show(b)}" for a, b in rows)
    return " | ".join(" ".join(map(show, r)) for r in rows)
