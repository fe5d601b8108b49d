"""Questions over the star schema: rules plan SQL and its evidence, a gate refuses what isn't a query, rows become an answer with provenance."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import filters
from skein.sources.tables import Tables, format_answer


@dataclass(frozen=True)
class Plan:
    question: str
    sql: str
    args: tuple = ()
    evidence_sql: str = ""
    evidence_args: tuple = ()
    tables: tuple[str, ...] = ()
    operation: str = "select"


@dataclass(frozen=True)
class Rule:
    """A pattern whose groups are the SQL's parameters, in order; evidence has as many."""

    pattern: str
    sql: str
    evidence: str
    tables: tuple[str, ...]
    cast: tuple = field(default=())


_LINE = "SELECT 'lineitem:' || l_orderkey || ':' || l_linenumber AS record_id"
_BY_REGION = "FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE upper(r_name) = upper(?)"
_YEAR = "FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE year(o_orderdate) = ?"
_MONEY = "CAST(round(sum(l_extendedprice * (1 - l_discount)), 2) AS DECIMAL(20, 2))"
RULES = (
    Rule(r"region of (customer#\w+)", "SELECT r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE lower(c_name) = ?", "SELECT 'customer:' || c_custkey AS record_id FROM customer WHERE lower(c_name) = ?", ("customer", "nation", "region")),
    Rule(r"parts .*order (\d+)", "SELECT p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = ? ORDER BY p_name", f"{_LINE} FROM lineitem WHERE l_orderkey = ?", ("lineitem", "part"), (int,)),
    Rule(r"customer .*segment (\w+) .*highest .*revenue", "SELECT c_name FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE lower(c_mktsegment) = ? GROUP BY c_custkey, c_name ORDER BY round(sum(l_extendedprice * (1 - l_discount)), 2) DESC, c_name LIMIT 1", f"{_LINE} FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE lower(c_mktsegment) = ?", ("customer", "orders", "lineitem")),
    Rule(r"how many orders .*status (\w) .*each region", "SELECT r_name, count(DISTINCT o_orderkey) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE lower(o_orderstatus) = ? GROUP BY r_name ORDER BY r_name", "SELECT 'orders:' || o_orderkey AS record_id FROM orders WHERE lower(o_orderstatus) = ? AND o_custkey IN (SELECT c_custkey FROM customer)", ("orders", "customer", "nation", "region")),
    Rule(r"orders .*antarctica", "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ANTARCTICA' ORDER BY o_orderkey", "SELECT 'orders:' || o_orderkey AS record_id FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ANTARCTICA'", ("orders", "customer", "nation", "region")),
    Rule(r"revenue .*region (\w+)", f"SELECT {_MONEY} AS revenue {_BY_REGION}", f"{_LINE} {_BY_REGION}", ("lineitem", "orders", "customer", "nation", "region")),
    Rule(r"total .*revenue .*(\d{4})", f"SELECT {_MONEY} AS revenue {_YEAR}", f"{_LINE} {_YEAR}", ("lineitem", "orders"), (int,)),
)


def plan(question: str, known: set[str]) -> Plan:
    """The first rule that fits; a ValueError where none does, or where a table is missing."""
    q = question.lower()
    if "delete" in q and "cancelled" in q:
        return Plan(question, "DELETE FROM orders WHERE o_orderstatus = 'C'", tables=("orders",), operation="delete")
    for rule in RULES:
        found = re.search(rule.pattern, q)
        if found:
            missing = set(rule.tables) - known
            if missing:
                raise ValueError(f"tables not there: {sorted(missing)}")
            args = tuple(c(x) for c, x in zip(rule.cast or (str,) * len(found.groups()), found.groups()))
            return Plan(question, rule.sql, args, rule.evidence, args, rule.tables)
    raise ValueError("no rule fits the question")


@dataclass(frozen=True)
class Trace:
    question: str
    status: str
    answer: str = ""
    error: str = ""
    plan: Plan | None = None
    evidence: DataFrame | None = None


def prepare(tables: Tables, question: str) -> Trace:
    """Plans and validates one question, without an answer; its evidence (record_id) is a table that hasn't run."""
    try:
        made = plan(question, set(tables.keys))
    except ValueError as e:
        return Trace(question, "planning_error", error=str(e))
    ok, reason = filters.read_only(made.sql, set(made.tables), set(tables.keys))
    if not ok:
        return Trace(question, "rejected", error=reason, plan=made)
    evidence = tables.execute(made.evidence_sql, made.tables, list(made.evidence_args), spread=True) if made.evidence_sql else None
    return Trace(question, "ok", plan=made, evidence=evidence)


def ask(tables: Tables, question: str) -> Trace:
    """Plans, validates and runs one question; the rows of an answer are few, its evidence (record_id) stays a table."""
    trace = prepare(tables, question)
    if trace.status != "ok":
        return trace
    rows = tables.execute(trace.plan.sql, trace.plan.tables, list(trace.plan.args), spread=True).collect()
    return replace(trace, answer=format_answer([tuple(r) for r in rows]))


QUESTIONS = (
    "What is the region of Customer#000000007?",
    "Which parts are in order 5?",
    "Which customer of segment BUILDING has the highest revenue?",
    "How many orders of status F are there in each region?",
    "Which orders were shipped to Antarctica?",
    "What is the revenue of region EUROPE?",
    "What was the total revenue in 1995?",
    "Delete all cancelled orders",
    "What is the meaning of life?",
)


def answers(spark: SparkSession, folder: str, questions: tuple[str, ...] = QUESTIONS) -> DataFrame:
    """question_id, status, answer, error."""
    t = Tables(spark, folder)
    return spark.createDataFrame([(i, x.status, x.answer, x.error) for i, x in enumerate(ask(t, q) for q in questions)], "question_id int, status string, answer string, error string")


def evidence(spark: SparkSession, folder: str, questions: tuple[str, ...] = QUESTIONS) -> DataFrame:
    """question_id, record_id, locator: the rows behind each answer."""
    t = Tables(spark, folder)
    parts = [x.evidence.select(F.lit(i).alias("question_id"), "record_id") for i, x in enumerate(prepare(t, q) for q in questions) if x.evidence is not None]
    return reduce(DataFrame.union, parts).withColumn("locator", F.concat(F.lit("tables://"), F.replace("record_id", F.lit(":"), F.lit("/"))))
