"""Queries over the star schema and the event log, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import graph as G
from skein.operators import memory as Y
from skein.operators import metrics as M
from skein.plans.corpus import ORACLE_SQL, QUERIES, r6, table
from skein.sources.tables import Tables
from skein.streaming import serving as S

__all__ = ["ORACLE_SQL", "QUERIES"]


def sql(name: str, text: str, tables: tuple[str, ...], spark_text: str | None = None):
    """A query that is SQL on both sides, behind the read-only gate."""
    QUERIES[name] = lambda spark, d: Tables(spark, d).execute((spark_text or text).strip(), tables)
    ORACLE_SQL[name] = text


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text:
            ORACLE_SQL[name] = text
        return f

    return add


sql("pricing_summary", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
  round(avg(l_discount), 6) AS avg_disc, count(*) AS n_orders
FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""", ("lineitem",))
sql("revenue_by_region", """
SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name, n_name""", ("customer", "orders", "lineitem", "nation", "region"))
sql("customers_by_region", """
SELECT r_name, count(DISTINCT o_custkey) AS n_customers, count(*) AS n_orders
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderstatus = 'F' GROUP BY r_name""", ("orders", "customer", "nation", "region"))
sql("top_customer", """
SELECT c_custkey, c_name, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey
GROUP BY c_custkey, c_name ORDER BY total DESC, c_custkey LIMIT 1""", ("customer", "orders"))
sql("part_revenue_by_brand", """
SELECT p_brand, round(sum(l_quantity * p_retailprice), 2) AS value, count(DISTINCT l_orderkey) AS n_orders
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0 GROUP BY p_brand""", ("lineitem", "part", "supplier"))
sql("orders_in_range", "SELECT o_orderkey, 'orders:' || o_orderkey AS evidence FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate <= DATE '1995-03-31' AND o_orderpriority = '1-URGENT'", ("orders",))


@query("row_records", "SELECT 'nation:' || n_nationkey AS record_id, 'n_nationkey=' || n_nationkey || ' n_name=' || n_name || ' n_regionkey=' || n_regionkey AS content FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'r_regionkey=' || r_regionkey || ' r_name=' || r_name FROM region")
def row_records(spark, d):
    return Tables(spark, d).records("nation", "region")


@query("table_catalog", "SELECT 'customer' AS \"table\", count(*) AS n_rows FROM customer UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'supplier', count(*) FROM supplier")
def table_catalog(spark, d):
    return Tables(spark, d).row_counts()


@query("row_search")
def row_search(spark, d):
    q = spark.createDataFrame([(0, "NATION_3"), (1, "r_name AFRICA"), (2, "n_regionkey 4")], "query_id int, text string")
    return r6(Tables(spark, d).search(q, "nation", "region"), "score")


@query("order_context", """
SELECT o_orderkey, c_name, count(l_linenumber) AS n_lines, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_shipdate, l_linenumber, l_partkey) AS parts, max(l_shipdate) AS last_ship
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, c_name""")
def order_context(spark, d):
    o, c, li = (table(spark, d, n) for n in ("orders", "customer", "lineitem"))
    lines = li.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.max("l_shipdate").alias("last_ship"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_shipdate", "l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"], "left").join(lines, o["o_orderkey"] == lines["l_orderkey"], "left")
    return j.select("o_orderkey", "c_name", F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"), "parts", "last_ship")


@query("asof_last_view", """
SELECT p.event_id, v.event_id AS view_id, round(v.value, 6) AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_last_view(spark, d):
    e = table(spark, d, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    out = Y.as_of_last(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "ts", "view_id", "view_value")
    return r6(out.select("event_id", "view_id", "view_value"), "view_value")


_VERSIONS = "SELECT event_id, user_id, CAST(ts AS DATE) AS valid_from, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(ts AS DATE) + INTERVAL 5 DAY END AS valid_to FROM events WHERE event_type = 'signup'"


@query("asof_valid_version", f"""
SELECT p.event_id, v.event_id AS version_id FROM (SELECT *, CAST(ts AS DATE) AS at FROM events WHERE event_type = 'purchase') p JOIN ({_VERSIONS}) v
ON p.user_id = v.user_id AND v.valid_from <= p.at AND (v.valid_to IS NULL OR p.at <= v.valid_to)
QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY v.valid_from DESC, v.event_id DESC) = 1""")
def asof_valid_version(spark, d):
    e = table(spark, d, "events")
    v = e.where("event_type = 'signup'").select(F.col("event_id").alias("version_id"), "user_id", F.to_date("ts").alias("valid_from"), F.when(F.col("event_id") % 3 != 0, F.date_add(F.to_date("ts"), 5)).alias("valid_to"))
    p = e.where("event_type = 'purchase'").select("event_id", "user_id", F.to_date("ts").alias("at"))
    return Y.as_of(p, v, "user_id", "at", "valid_from", "valid_to", "version_id").select("event_id", "version_id")


@query("latest_version", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_version(spark, d):
    return Y.version(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id")


@query("previous_version", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 2")
def previous_version(spark, d):
    return Y.version(table(spark, d, "events"), "user_id", "ts", "event_id", back=1).select("user_id", "event_id")


@query("memory_search")
def memory_search(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("event_id"), (F.col("doc_id") % 50).alias("memory_key"), F.col("doc_id").alias("sequence"), "text")
    q = table(spark, d, "benchmark").where("item_id < 8").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("before "), F.substring("text", 1, 40))).otherwise(F.substring("text", 1, 40)).alias("text"))
    return r6(Y.memory_search(docs, q), "score")


@query("price_percentiles", "SELECT round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem")
def price_percentiles(spark, d):
    return r6(M.percentile(table(spark, d, "lineitem"), "l_extendedprice", 0.5, 0.95), "p50", "p95")


@query("sla_breach", "SELECT l_orderkey, l_linenumber, epoch(l_shipdate - o_orderdate) > 1440 * 3600 AS breached FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def sla_breach(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select("l_orderkey", "l_linenumber", Y.breached(F.col("o_orderdate"), F.col("l_shipdate"), F.lit(1440)).alias("breached"))


# --- graph ------------------------------------------------------------------

_EDGES = """edges AS (
  SELECT 'c' || c_custkey AS subject, 'located_in' AS relation, 'n' || c_nationkey AS object, CAST(c_custkey AS BIGINT) AS doc_id FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'located_in', 'n' || s_nationkey, CAST(s_suppkey + 100000 AS BIGINT) FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'part_of', 'r' || n_regionkey, CAST(n_nationkey + 200000 AS BIGINT) FROM nation)"""


def edges(spark, d):
    c, s, n = (table(spark, d, x) for x in ("customer", "supplier", "nation"))
    edge = lambda t, a, k, r, b, o, plus: t.select(F.concat(F.lit(a), F.col(k).cast("string")).alias("subject"), F.lit(r).alias("relation"), F.concat(F.lit(b), F.col(o).cast("string")).alias("object"), (F.col(k) + plus).cast("long").alias("doc_id"))
    return edge(c, "c", "c_custkey", "located_in", "n", "c_nationkey", 0).union(edge(s, "s", "s_suppkey", "located_in", "n", "s_nationkey", 100000)).union(edge(n, "n", "n_nationkey", "part_of", "r", "n_regionkey", 200000))


@query("k_hop", f"""
WITH RECURSIVE {_EDGES}, walk(root, node, depth) AS (SELECT subject, subject, 0 FROM edges WHERE doc_id < 10 UNION SELECT root, object, depth + 1 FROM walk JOIN edges ON subject = node WHERE depth < 3)
SELECT DISTINCT root, subject, relation, object, doc_id FROM walk JOIN edges ON subject = node WHERE depth < 3""")
def k_hop(spark, d):
    e = edges(spark, d)
    return G.k_hop(e, e.where("doc_id < 10").select(F.col("subject").alias("node")), 3)


def _paths(spark, d):
    pairs = spark.range(6).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("start"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("goal"))
    return G.bfs(edges(spark, d), pairs, 6)


@query("bfs_path", f"""
WITH RECURSIVE {_EDGES}, und AS (SELECT subject AS src, object AS dst, relation, doc_id FROM edges UNION ALL SELECT object, subject, relation, doc_id FROM edges),
walk(start, node, hops) AS (SELECT 'c' || i, 'c' || i, 0 FROM range(6) t(i) UNION SELECT start, dst, hops + 1 FROM walk JOIN und ON src = node WHERE hops < 6)
SELECT start, node AS goal, CAST(min(hops) AS INT) AS hops FROM walk WHERE node = 's' || substr(start, 2) GROUP BY 1, 2""")
def bfs_path(spark, d):
    return _paths(spark, d).select("start", "goal", F.size("path").alias("hops"))


@query("path_documents")
def path_documents(spark, d):
    return G.path_documents(_paths(spark, d))


@query("pagerank_24", f"""
WITH RECURSIVE {_EDGES}, und AS (SELECT subject AS src, object AS dst FROM edges UNION ALL SELECT object, subject FROM edges),
deg AS (SELECT src, count(*) AS n FROM und GROUP BY 1), tele AS (SELECT node, CASE WHEN node IN ('c1', 's2') THEN 0.5 ELSE 0 END::DOUBLE AS t FROM (SELECT DISTINCT src AS node FROM und)),
walk(i, node, score) AS (
  SELECT 0, node, t FROM tele
  UNION ALL
  SELECT i + 1, node, sum(s)::DOUBLE FROM (
    SELECT i, dst AS node, 0.85 * score / n AS s FROM walk JOIN und ON src = node JOIN deg USING (src) WHERE i < 24
    UNION ALL SELECT w.i, tele.node, 0.15 * t FROM (SELECT DISTINCT i FROM walk WHERE i < 24) w, tele) GROUP BY i, node)
SELECT node, round(score, 6) AS score FROM walk WHERE i = 24""")
def pagerank_24(spark, d):
    seeds = spark.createDataFrame([("c1",), ("s2",)], "node string")
    return r6(G.pagerank(edges(spark, d), seeds), "score")


@query("entity_match", f"WITH {_EDGES}, q AS (SELECT * FROM (VALUES (0, 'where is c12 and n3'), (1, 'r1 r2 c7')) t(query_id, text)) SELECT query_id, node, CAST(row_number() OVER (PARTITION BY query_id ORDER BY node) AS INT) AS position FROM q, (SELECT subject AS node FROM edges UNION SELECT object FROM edges) WHERE list_contains(regexp_extract_all(text, '[a-z0-9]+'), node)")
def entity_match(spark, d):
    q = spark.createDataFrame([(0, "where is c12 and n3"), (1, "r1 r2 c7")], "query_id int, text string")
    return G.match_entities(q, edges(spark, d))


# --- streams ----------------------------------------------------------------


@query("stream_windows", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    e = table(spark, d, "events")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return S.run_to_table(S.windowed(stream.withColumn("ts", F.col("ts").cast("timestamp")))).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("session_windows", """
WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS n FROM g GROUP BY user_id, k""")
def session_windows(spark, d):
    return S.sessions(table(spark, d, "events"))


@query("event_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_type = 'error'")
def event_props(spark, d):
    return table(spark, d, "events").where("event_type = 'error'").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("normalize_answers", r"SELECT c_custkey, lower(trim(regexp_replace(c_name || '  ' || c_mktsegment, '\s+', ' ', 'g'))) AS answer FROM customer")
def normalize_answers(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.normalize_answer(F.concat_ws("  ", "c_name", "c_mktsegment")).alias("answer"))
