"""Queries over whole pipelines: questions to SQL, hierarchies, order-to-cash, guarded serving, adaptive control, reranking, agents; with their SQL."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

import skein
from skein.operators import agent as A
from skein.operators import control as C
from skein.operators import graph as G
from skein.operators import hierarchy as H
from skein.operators import lexical as L
from skein.operators import metrics as M
from skein.operators import ordercash as O
from skein.operators import rerank as RR
from skein.operators import serving as V
from skein.plans import questions as Q
from skein.plans.corpus import TOK, _RANK, _sql, docs, questions, query, r6, table
from skein.plans.warehouse import ORACLE_SQL, QUERIES, edges
from skein.sources import code as K
from skein.streaming import serving as S

__all__ = ["ORACLE_SQL", "QUERIES"]

# --- questions to SQL -------------------------------------------------------

_REV = "CAST(CAST(round(sum(l_extendedprice * (1 - l_discount)), 2) AS DECIMAL(20, 2)) AS VARCHAR)"
_REGIONS = "customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"


@query("sql_rag_answers", f"""
SELECT question_id::INT AS question_id, status, answer, error FROM (
  SELECT 0 AS question_id, 'ok' AS status, (SELECT r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_name = 'Customer#000000007') AS answer, '' AS error
  UNION ALL SELECT 1, 'ok', coalesce((SELECT string_agg(p_name, '; ' ORDER BY p_name) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = 5), 'NO_ROWS'), ''
  UNION ALL SELECT 2, 'ok', (SELECT c_name FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY c_custkey, c_name ORDER BY round(sum(l_extendedprice * (1 - l_discount)), 2) DESC, c_name LIMIT 1), ''
  UNION ALL SELECT 3, 'ok', (SELECT string_agg(r_name || '=' || n, '; ' ORDER BY r_name) FROM (SELECT r_name, count(*) AS n FROM orders JOIN {_REGIONS} WHERE o_orderstatus = 'F' GROUP BY 1)), ''
  UNION ALL SELECT 4, 'ok', 'NO_ROWS', ''
  UNION ALL SELECT 5, 'ok', (SELECT {_REV} FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN {_REGIONS} WHERE r_name = 'EUROPE'), ''
  UNION ALL SELECT 6, 'ok', (SELECT {_REV} FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE year(o_orderdate) = 1995), ''
  UNION ALL SELECT 7, 'rejected', '', 'not a SELECT'
  UNION ALL SELECT 8, 'planning_error', '', 'no rule fits the question')""")
def sql_rag_answers(spark, d):
    return Q.answers(spark, d)


@query("sql_rag_evidence", f"""
SELECT question_id::INT AS question_id, record_id, 'tables://' || replace(record_id, ':', '/') AS locator FROM (
  SELECT 0 AS question_id, 'customer:' || c_custkey AS record_id FROM customer WHERE c_name = 'Customer#000000007'
  UNION ALL SELECT 1, 'lineitem:' || l_orderkey || ':' || l_linenumber FROM lineitem WHERE l_orderkey = 5
  UNION ALL SELECT 2, 'lineitem:' || l_orderkey || ':' || l_linenumber FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT 3, 'orders:' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'
  UNION ALL SELECT 5, 'lineitem:' || l_orderkey || ':' || l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN {_REGIONS} WHERE r_name = 'EUROPE'
  UNION ALL SELECT 6, 'lineitem:' || l_orderkey || ':' || l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE year(o_orderdate) = 1995)""")
def sql_rag_evidence(spark, d):
    return Q.evidence(spark, d)


@query("source_records", "SELECT 'region:' || r_regionkey AS record_id, 'table_row' AS source_type, 'tables://region/' || r_regionkey AS locator, 'region' AS title, 'r_regionkey=' || r_regionkey || ' r_name=' || r_name AS content, 'r_regionkey,r_name' AS columns FROM region")
def source_records(spark, d):
    r = Q.Tables(spark, d).source_records("region")
    return r.select("record_id", "source_type", "locator", "title", "content", r["metadata"]["columns"].alias("columns"))


# --- hierarchy --------------------------------------------------------------

_TREE = """nth AS (SELECT doc_id, source AS collection, text, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 3 AS nth FROM documents),
grp AS (SELECT collection, nth, string_agg(text, ' ' ORDER BY doc_id) AS text, count(*) AS n FROM nth GROUP BY 1, 2),
root AS (SELECT collection, 'collection ' || collection || ' ' || string_agg(text, ' ' ORDER BY nth) AS text, sum(n) AS n FROM grp GROUP BY 1)"""


def _tree(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("collection"), "text")


@query("summary_nodes", f"WITH {_TREE} SELECT collection || ':group:' || nth AS node_id, CAST(1 AS INT) AS level, md5(text) AS text_md5, CAST(n AS INT) AS n_documents FROM grp UNION ALL SELECT collection || ':root', 2, md5(text), CAST(n AS INT) FROM root")
def summary_nodes(spark, d):
    return H.digests(_tree(spark, d))


@query("summary_route", _sql("SELECT query_id, doc_id AS collection, round(score, 6) AS score, rank FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INT) AS rank FROM bm WHERE score > 0 QUALIFY rank <= 2)", of="root_docs").replace("WITH ", f"WITH {_TREE}, root_docs AS (SELECT collection AS doc_id, text FROM root), ", 1))
def summary_route(spark, d):
    return r6(H.route(_tree(spark, d), questions(spark, d)), "score")


@query("summary_search")
def summary_search(spark, d):
    return r6(H.search(_tree(spark, d), questions(spark, d)), "score")


@query("summary_stats", f"WITH {_TREE} SELECT (SELECT count(*) FROM documents) AS leaf_documents, (SELECT count(*) FROM grp) + (SELECT count(*) FROM root) AS summary_nodes, CAST((SELECT sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) FROM (SELECT text FROM grp UNION ALL SELECT text FROM root)) AS BIGINT) AS summary_words")
def summary_stats(spark, d):
    return H.stats(_tree(spark, d))


# --- graphs -----------------------------------------------------------------


@query("path_search")
def path_search(spark, d):
    q = spark.createDataFrame([(0, "from c1 to s2"), (1, "where is c7"), (2, "s1 and s3"), (3, "nothing here")], "query_id int, text string")
    return G.path_search(edges(spark, d), q)


@query("associative_search")
def associative_search(spark, d):
    e = edges(spark, d)
    text = e.select("doc_id", F.concat_ws(" ", "subject", F.replace("relation", F.lit("_"), F.lit(" ")), "object").alias("text"))
    q = spark.createDataFrame([(0, "what links c1 and s2"), (1, "where is c7"), (2, "located in")], "query_id int, text string")
    return r6(G.associative_search(e, text, q), "score")


@query("graph_stats", """WITH e AS (SELECT 'c' || c_custkey AS s, 'n' || c_nationkey AS o FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)
SELECT (SELECT count(*) FROM (SELECT s FROM e UNION SELECT o FROM e)) AS graph_nodes, (SELECT count(*) FROM e) AS graph_edges""")
def graph_stats(spark, d):
    return G.stats(edges(spark, d))


# --- order to cash ----------------------------------------------------------

_CONTRACTS = """contracts AS (SELECT CAST(c_custkey * 2 + v AS BIGINT) AS contract_id, c_custkey AS customer_id, DATE '1995-01-01' + CAST(c_custkey % 700 + v * 400 AS INT) AS effective_from,
  CASE WHEN v = 0 THEN DATE '1995-01-01' + CAST(c_custkey % 700 + 500 AS INT) END AS effective_to, v AS version, (c_custkey + v) % 5 <> 0 AS trusted FROM customer, range(2) r(v))"""


def contracts(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("customer_id"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("version"))
    start = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("customer_id") % 700 + F.col("version") * 400).cast("int"))
    end = F.when(F.col("version") == 0, F.date_add(F.lit("1995-01-01").cast("date"), (F.col("customer_id") % 700 + 500).cast("int")))
    return c.select((F.col("customer_id") * 2 + F.col("version")).cast("long").alias("contract_id"), "customer_id", start.alias("effective_from"), end.alias("effective_to"), "version", ((F.col("customer_id") + F.col("version")) % 5 != 0).alias("trusted"), F.concat(F.lit("Delivery within "), (24 + F.col("customer_id") % 5 * 24).cast("string"), F.lit(" hours")).alias("terms"))


@query("otc_active_contract", f"""WITH {_CONTRACTS}, j AS (SELECT o_orderkey AS request_id, CAST(o_orderdate AS DATE) AS as_of, k.* FROM orders LEFT JOIN contracts k ON customer_id = o_custkey),
e AS (SELECT *, coalesce(trusted, false) AS ok, effective_from <= as_of AND (effective_to IS NULL OR as_of <= effective_to) AS live FROM j)
SELECT request_id, arg_max(contract_id, CASE WHEN ok AND live THEN effective_from END) AS contract_id,
  coalesce(string_agg(CAST(contract_id AS VARCHAR), ',' ORDER BY contract_id) FILTER (WHERE ok AND NOT live), '') AS stale_ids,
  coalesce(string_agg(CAST(contract_id AS VARCHAR), ',' ORDER BY contract_id) FILTER (WHERE NOT ok AND contract_id IS NOT NULL), '') AS untrusted_ids
FROM e GROUP BY request_id""")
def otc_active_contract(spark, d):
    req = table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("customer_id"), F.to_date("o_orderdate").alias("as_of"))
    a = O.active_contract(contracts(spark, d), req)
    return a.select("request_id", "contract_id", F.array_join(F.col("stale_ids").cast("array<string>"), ",").alias("stale_ids"), F.array_join(F.col("untrusted_ids").cast("array<string>"), ",").alias("untrusted_ids"))


def _otc(spark, d):
    """The arguments of investigate(), from the star schema and the event log."""
    o = table(spark, d, "orders")
    ev = table(spark, d, "events").select(F.col("event_id"), (F.col("event_id") % 500).cast("long").alias("shipment_id"), F.col("ts").cast("timestamp").alias("ts"), F.element_at(F.array(*map(F.lit, ["PICKED_UP", "LINEHAUL", "WX_HOLD", "DELAY_NOTICE", "DELIVERED"])), (F.col("event_id") % 5 + 1).cast("int")).alias("code"), (F.col("event_id") % 7 != 0).alias("trusted"))
    return {
        "orders": o.select(F.col("o_orderkey").cast("long").alias("order_id"), F.col("o_custkey").alias("customer_id"), (F.col("o_orderkey") % 700).cast("long").alias("shipment_id"), F.col("o_orderkey").cast("long").alias("invoice_id")),
        "shipments": spark.range(650).select(F.col("id").alias("shipment_id"), F.when(F.col("id") % 3 == 0, "DELIVERED").otherwise("IN_TRANSIT").alias("status")),
        "events": ev,
        "contracts": contracts(spark, d),
        "finance": o.select(F.col("o_orderkey").cast("long").alias("invoice_id"), F.col("o_orderstatus").alias("payment_status"), (F.col("o_totalprice") > 300000).alias("credit_hold")),
        "users": spark.createDataFrame([("u0", ["finance", "ops"]), ("u1", ["ops"]), ("u2", [])], "user_id string, roles array<string>"),
        "access": spark.createDataFrame([("finance", ["finance"])], "family string, allowed_roles array<string>"),
        "policies": spark.createDataFrame([("WX_HOLD", "P1", "CALL_CUSTOMER", True, ["ops"]), ("DELAY_NOTICE", "P2", "ASK_CARRIER", True, ["control"])], "code string, policy_id string, action string, trusted boolean, allowed_roles array<string>"),
    }


@query("otc_finance_access", """
SELECT o_orderkey AS request_id, o_orderkey % 4 = 0 AS authorized, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus END AS payment_status, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice > 300000 END AS credit_hold FROM orders""")
def otc_finance_access(spark, d):
    t = _otc(spark, d)
    req = t["orders"].select(F.col("order_id").alias("request_id"), "order_id", F.concat(F.lit("u"), (F.col("order_id") % 4).cast("string")).alias("user_id"))
    return O.finance_context(req, t["orders"], t["finance"], t["users"], t["access"]).select("request_id", "authorized", "payment_status", "credit_hold")


_ASKED = ("What is the payment status and is there a credit hold?", "Was the SLA of the contract breached?", "What is the status of the shipment?", "Why the delay, and what action is next?")


def _investigation(spark, d):
    t = _otc(spark, d)
    text = F.element_at(F.array(*map(F.lit, _ASKED)), (F.col("order_id") % 4 + 1).cast("int"))
    q = t["orders"].select(F.col("order_id").alias("request_id"), text.alias("text"), F.concat(F.lit("u"), (F.floor(F.col("order_id") / 4) % 3).cast("string")).alias("user_id"), "order_id", F.lit("1999-01-01").cast("timestamp").alias("as_of"))
    return t, q


_MINUTE = "CASE event_id % 5 WHEN 0 THEN 'PICKED_UP' WHEN 1 THEN 'LINEHAUL' WHEN 2 THEN 'WX_HOLD' WHEN 3 THEN 'DELAY_NOTICE' ELSE 'DELIVERED' END"


@query("otc_investigate", f"""WITH {_CONTRACTS},
e AS (SELECT event_id % 500 AS shipment_id, arg_max(code, (ts, event_id)) AS code, min(ts) FILTER (WHERE code = 'PICKED_UP') AS picked, bool_or(code = 'DELIVERED') AS delivered FROM (SELECT *, {_MINUTE} AS code FROM events WHERE event_id % 7 <> 0) GROUP BY 1),
o AS (SELECT o_orderkey AS request_id, o_custkey, o_orderkey % 4 AS kind, (o_orderkey // 4) % 3 AS u, o_orderkey % 700 AS ship, o_orderstatus, o_totalprice FROM orders),
k AS (SELECT o.request_id, arg_max(contract_id, CASE WHEN trusted AND effective_from <= DATE '1999-01-01' AND (effective_to IS NULL OR DATE '1999-01-01' <= effective_to) THEN effective_from END) AS contract_id FROM o JOIN contracts ON customer_id = o_custkey WHERE kind = 1 GROUP BY 1),
j AS (SELECT o.*, e.*, k.contract_id, CASE WHEN ship < 650 THEN CASE WHEN ship % 3 = 0 THEN 'DELIVERED' ELSE 'IN_TRANSIT' END END AS status, CASE WHEN k.contract_id IS NOT NULL THEN CAST(24 + o_custkey % 5 * 24 AS INT) END AS hours,
  kind = 0 AND u <> 0 AS denied, coalesce(e.code NOT IN ('PICKED_UP', 'LINEHAUL'), false) AS confirmed FROM o LEFT JOIN e ON e.shipment_id = o.ship LEFT JOIN k USING (request_id)),
z AS (SELECT *, coalesce(delivered, false) AND coalesce(status <> 'DELIVERED', false) AND kind IN (0, 2) AS conflict,
  CASE WHEN kind = 3 THEN CASE WHEN confirmed AND code <> 'DELAY_NOTICE' THEN code ELSE 'UNKNOWN' END END AS cause,
  CASE WHEN kind = 3 THEN CASE WHEN confirmed AND code = 'WX_HOLD' AND u < 2 THEN 'CALL_CUSTOMER' WHEN NOT confirmed THEN 'NONE_YET' END END AS act FROM j)
SELECT request_id, CASE WHEN denied THEN 'DENIED' WHEN conflict THEN 'CONFLICT' END AS decision, CASE WHEN kind = 0 AND NOT denied THEN o_orderstatus END AS payment_status, CASE WHEN kind = 0 AND NOT denied THEN o_totalprice > 300000 END AS credit_hold,
  contract_id, hours AS commitment_hours, epoch(TIMESTAMP '1999-01-01' - picked) > hours * 3600 AS sla_breached, cause AS root_cause, act AS recommended_action,
  CASE WHEN denied THEN 'authorization_denied' WHEN conflict THEN 'authoritative_source_conflict' WHEN cause = 'UNKNOWN' THEN 'insufficient_confirmed_cause' WHEN kind = 0 OR hours IS NOT NULL OR (kind = 2 AND status IS NOT NULL) OR cause IS NOT NULL OR act IS NOT NULL THEN 'requested_fields_supported' ELSE 'insufficient_evidence' END AS stop_reason
FROM z""")
def otc_investigate(spark, d):
    t, q = _investigation(spark, d)
    return O.investigate(q, **t).drop("stale_ids", "untrusted_ids", "evidence")


@query("otc_baseline")
def otc_baseline(spark, d):
    t, q = _investigation(spark, d)
    return O.baseline("fixed_mixed", q.where("request_id < 200"), t["orders"], t["shipments"], t["events"], t["contracts"])


# --- serving ----------------------------------------------------------------


def _served(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", "text", F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 4 == 1, F.array(F.lit("staff"))).otherwise(F.array(F.lit("staff"), F.lit("guest"))).alias("roles"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") % 100 * 86400).alias("updated_at"), (F.col("doc_id") % 3 != 0).alias("trusted"))


@query("serving_policy", """WITH j AS (SELECT doc_id, doc_id % 4 < 2 AS acl, doc_id % 100 < 40 AS stale, doc_id % 3 = 0 AS bad FROM documents)
SELECT count(*) FILTER (WHERE NOT acl AND NOT stale AND NOT bad) AS candidates, count(*) FILTER (WHERE acl) AS acl_filtered, count(*) FILTER (WHERE NOT acl AND stale) AS stale_filtered, count(*) FILTER (WHERE NOT acl AND NOT stale AND bad) AS untrusted_filtered FROM j""")
def serving_policy(spark, d):
    from skein.operators import filters as P

    clock = "2024-02-21 22:13:20"  # the newest document's time
    return P.reason_counts(V.Guarded(_served(spark, d), clock, 59).judged(["guest"]))


@query("serving_trace")
def serving_trace(spark, d):
    """A query, the same again, an upsert, the query, a delete, the query, and another role's."""
    g = V.Guarded(_served(spark, d), "2024-02-21 22:13:20", 365)
    new = spark.createDataFrame([(-1, "a wholly new zyzzyva", ["guest"], "2024-02-01 00:00:00", True)], "doc_id long, text string, roles array<string>, updated_at string, trusted boolean").withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    out = [g.query("zyzzyva", ["guest"]), g.query("zyzzyva", ["guest"])]
    g.upsert(new)
    out.append(g.query("zyzzyva", ["guest"]))
    g.delete(-1)
    out += [g.query("zyzzyva", ["guest"]), g.query("zyzzyva", ["nobody"])]
    return spark.createDataFrame([(i, x.cache_hit, x.generation, x.candidates, list(x.returned)) for i, x in enumerate(out)], "step int, cache_hit boolean, generation int, candidates long, returned array<long>")


# --- adaptive control -------------------------------------------------------


def _asked(spark, d):
    base = questions(spark, d)
    return base.select("query_id", F.when(F.col("query_id") % 12 == 0, F.concat(F.lit("uppercase "), "text")).when(F.col("query_id") % 12 == 4, F.concat(F.lit("the country where "), "text")).otherwise(F.col("text")).alias("text"))


@query("adaptive_search")
def adaptive_search(spark, d):
    q, t = _asked(spark, d), docs(spark, d)
    return r6(C.adaptive_search(q, t.where("doc_id % 2 = 0"), t.where("doc_id % 2 = 1")), "score")


@query("extract_answer")
def extract_answer(spark, d):
    hits = L.bm25(docs(spark, d), questions(spark, d), 3).join(docs(spark, d), "doc_id").select("query_id", F.col("rank").alias("position"), "doc_id", "text")
    return C.extract_answer(questions(spark, d), hits)


@query("web_answer")
def web_answer(spark, d):
    q = spark.createDataFrame([(0, "latest that the"), (1, "that onesen the"), (2, "der die und")], "query_id int, text string")
    return C.web_answer(C.web_records(table(spark, d, "pages")), q)


_WITHIN = f"""
tok AS (SELECT source, doc_id, unnest({TOK}) AS term FROM documents), tf AS (SELECT source, doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2, 3), dl AS (SELECT source, doc_id, len({TOK}) AS dl FROM documents),
st AS (SELECT source, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY 1), df AS (SELECT source, term, count(*) AS df FROM tf GROUP BY 1, 2),
q AS (SELECT item_id AS query_id, 'src' || (item_id % 3) AS source, substr(text, 1, 60) AS text FROM benchmark WHERE item_id % 4 = 0),
qt AS (SELECT query_id, source, term, count(*) AS qtf FROM (SELECT query_id, source, unnest({TOK}) AS term FROM q) GROUP BY 1, 2, 3),
bm AS (SELECT query_id, doc_id, sum(qtf * ln((n + 1) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN qt USING (source, term) JOIN df USING (source, term) JOIN dl USING (source, doc_id) JOIN st USING (source) GROUP BY 1, 2)"""


@query("select_context", f"WITH {_WITHIN} SELECT query_id, 'retrieve' AS route, doc_id AS section_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INT) AS place, round(score, 6) AS score FROM bm WHERE score > 0 QUALIFY place <= 3")
def select_context(spark, d):
    sections = table(spark, d, "documents").select(F.col("source").alias("bundle_id"), F.col("doc_id").alias("section_id"), F.col("doc_id").alias("position"), "text")
    q = questions(spark, d).select("query_id", F.concat(F.lit("src"), (F.col("query_id") % 3).cast("string")).alias("bundle_id"), "text")
    return r6(C.select_context(sections, q, 10, ("\u0001",)), "score")


# --- reranking, agents ------------------------------------------------------


def _candidates(spark, d):
    return L.bm25(docs(spark, d), questions(spark, d), 10)


@query("rerank_features", _sql(f"""SELECT query_id, doc_id, round(score, 6) AS dense, round(score, 6) AS bm25, round(len(list_intersect(list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9]+')), regexp_extract_all(lower(d.text), '[a-z0-9]+'))) / len(list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9]+')))::DOUBLE, 6) AS overlap, round(1.0::DOUBLE / rank, 6) AS reciprocal_rank
FROM rk JOIN questions q USING (query_id) JOIN documents d USING (doc_id)""", more=f", {_RANK}"))
def rerank_features(spark, d):
    return r6(RR.features(_candidates(spark, d), docs(spark, d), questions(spark, d)), *RR.FEATURES)


@query("hard_negatives", _sql("SELECT query_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS rank FROM rk WHERE doc_id % 4 <> 0 AND query_id IN (SELECT query_id FROM ql) QUALIFY rank <= 2", more=f", {_RANK}").replace("QUALIFY rank <= 2", "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rk.rank) <= 2"))
def hard_negatives(spark, d):
    rank = L.bm25(docs(spark, d), questions(spark, d), 30)
    good = rank.where("doc_id % 4 = 0").select("query_id", "doc_id")
    return r6(RR.hard_negatives(rank.where("rank <= 10"), good, 2), "score")


@query("learned_rerank")
def learned_rerank(spark, d):
    rows = RR.features(_candidates(spark, d), docs(spark, d), questions(spark, d))
    model = RR.PairwiseLinear(20).fit(RR.pairs(rows, rows.where("doc_id % 4 = 0")))
    return r6(model.rank(rows, 5), "score")


@query("agent_runs")
def agent_runs(spark, d):
    p = table(spark, d, "part")
    stock = p.select(F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_size").cast("string").alias("value"))
    text = p.select(F.col("p_partkey").alias("doc_id"), F.concat("p_name", F.lit(" has the key SKU-"), F.col("p_partkey").cast("string")).alias("text"))
    tasks = p.where("p_partkey < 20").select(F.col("p_partkey").alias("task_id"), F.concat(F.lit("How much stock of SKU-"), F.col("p_partkey").cast("string"), F.lit("?")).alias("question"))
    out = A.run(tasks, text, stock, spark.createDataFrame([], "key string, value string"))
    return out.select("task_id", "answer", "n_calls", F.round("cost", 6).alias("cost"))


@query("citation_metrics", _sql("""SELECT query_id, round(len(list_intersect(cited, good)) / len(cited)::DOUBLE, 6) AS precision, round(len(list_intersect(cited, good)) / len(good)::DOUBLE, 6) AS recall, len(list_intersect(cited, good)) = len(good) AS complete
FROM (SELECT query_id, list(doc_id ORDER BY rank) FILTER (WHERE rank <= 3) AS cited FROM rk GROUP BY 1) JOIN (SELECT query_id, list(doc_id) AS good FROM ql GROUP BY 1) USING (query_id)""", more=f", {_RANK}"))
def citation_metrics(spark, d):
    rank = L.bm25(docs(spark, d), questions(spark, d), 30)
    g = rank.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "doc_id")))), lambda x: x["doc_id"]).alias("cited"), F.collect_list(F.when(F.col("doc_id") % 4 == 0, F.col("doc_id"))).alias("good")).where("size(good) > 0")
    return g.select("query_id", F.round(M.citation_precision(F.col("cited"), F.col("good")), 6).alias("precision"), F.round(M.citation_recall(F.col("cited"), F.col("good")), 6).alias("recall"), M.complete_at_budget(F.col("cited"), F.col("good"), 3).alias("complete"))


@query("duplicate_rate", _sql("SELECT query_id, round(1 - count(DISTINCT source) / count(*)::DOUBLE, 6) AS duplicate_rate FROM rk JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY 1", more=f", {_RANK}"))
def duplicate_rate(spark, d):
    canonical = table(spark, d, "documents").select("doc_id", F.col("source").alias("canonical"))
    return r6(M.duplicate_rate(_candidates(spark, d), canonical, 5), "duplicate_rate")


@query("code_search")
def code_search(spark, d):
    found = K.symbols(K.read(spark, os.path.dirname(skein.__file__)))
    q = spark.createDataFrame([(0, "bm25 scores"), (1, "what calls top_k")], "query_id int, text string")
    return r6(K.search(found, q), "score")


# --- streams ----------------------------------------------------------------


@query("stream_sliding", """SELECT window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (
  SELECT time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR * k AS window_start, event_type, value FROM events, range(4) r(k)) GROUP BY 1, 2""")
def stream_sliding(spark, d):
    e = table(spark, d, "events")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return S.run_to_table(S.sliding(stream.withColumn("ts", F.col("ts").cast("timestamp")))).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("clean_lines", "SELECT doc_id, len(list_distinct(list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: trim(trim(regexp_replace(x, '^\\s*([-*]|[0-9]+[.)])\\s*', '')), '\"')), lambda x: x <> '')))::INT AS n FROM documents")
def clean_lines(spark, d):
    return docs(spark, d).select("doc_id", F.size(C.clean_lines(F.col("text"), 1 << 30)).alias("n"))

