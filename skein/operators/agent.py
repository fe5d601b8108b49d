"""A bounded tool loop over many tasks at once: a planner proposes the next call of each task, the tools answer all calls by joins."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import lexical as L
from skein.operators.graph import use_checkpoints

#: From the question and the calls so far (tool, argument, observation, success) to the next (tool, argument), or None to stop.
Planner = Callable[[str, list[dict]], tuple[str, str] | None]
COSTS = {"docs_search": 1.0, "inventory_lookup": 0.5, "status_lookup": 0.5, "calculator": 0.1}
ABSTAIN = "ABSTAIN"
_KEY, _SERVICE, _SUM = re.compile(r"\bSKU-[A-Z0-9]+\b"), re.compile(r"\bsvc-[-a-z0-9]+\b"), re.compile(r"(\d+)\s*\+\s*(\d+)")


def _told(calls: list[dict], tool: str) -> dict[str, str]:
    return {c["argument"]: c["observation"] for c in calls if c["tool"] == tool and c["success"]}


def _keys(pattern: re.Pattern, question: str, calls: list[dict]) -> list[str]:
    text = " ".join(_told(calls, "docs_search").values())
    return list(dict.fromkeys(pattern.findall(text) + pattern.findall(question)))


def plan(question: str, calls: list[dict]) -> tuple[str, str] | None:
    """A sum goes to the calculator, known keys to their lookups, all else to the documents first; a failed lookup is followed by one search, once."""
    low, tools = question.lower(), [c["tool"] for c in calls]
    lookup, pattern = ("inventory_lookup", _KEY) if "stock" in low else ("status_lookup", _SERVICE)
    if not calls:
        found = _SUM.search(question)
        if found and "stock" not in low:
            return "calculator", f"{found[1]} + {found[2]}"
        named = pattern.findall(question)
        return (lookup, named[0]) if named else ("docs_search", question)
    if not calls[-1]["success"]:
        again = calls[-1]["tool"] == lookup and "docs_search" not in tools
        return ("docs_search", question) if again else None
    if "stock" in low or "status" in low:
        tried = {c["argument"] for c in calls if c["tool"] == lookup}
        for key in _keys(pattern, question, calls):
            if key not in tried:
                return lookup, key
        values = list(_told(calls, lookup).values())
        if "total" in low and len(values) >= 2 and "calculator" not in tools:
            return "calculator", f"{values[0]} + {values[1]}"
    return None


def plan_once(question: str, calls: list[dict]) -> tuple[str, str] | None:
    """The baseline that routes to one tool and stops."""
    return None if calls else plan(question, calls)


def plan_docs(question: str, calls: list[dict]) -> tuple[str, str] | None:
    """The baseline that only searches."""
    return None if calls else ("docs_search", question)


def answer(question: str, calls: list[dict]) -> str:
    """What the calls tell: the last sum, the larger stock, the only stock, the last status; ABSTAIN otherwise."""
    low = question.lower()
    sums, stock, status = (_told(calls, t) for t in ("calculator", "inventory_lookup", "status_lookup"))
    if sums:
        return list(sums.values())[-1]
    if "more stock" in low and len(stock) > 1:
        return max(stock.items(), key=lambda x: (int(x[1]), x[0]))[0]
    if "stock" in low and len(stock) == 1:
        return next(iter(stock.values()))
    if "status" in low and status:
        return list(status.values())[-1]
    return ABSTAIN


_CALL = "struct<tool:string,argument:string,observation:string,success:boolean>"


def run(tasks: DataFrame, docs: DataFrame, inventory: DataFrame, status: DataFrame, planner: Planner = plan, k: int = 2, most: int = 4) -> DataFrame:
    """task_id, answer, calls, n_calls, cost of tasks (task_id, question).

    docs: doc_id, text; inventory and status: key, value. In each of at most most rounds the planner, in Arrow batches, proposes one call a task, and
    each tool answers its calls in one join; tasks without a proposal are done.
    """
    use_checkpoints(tasks.sparkSession)

    @F.pandas_udf("struct<tool:string,argument:string>")
    def propose(question: pd.Series, calls: pd.Series) -> pd.DataFrame:
        made = [planner(q, [dict(c) for c in x]) or (None, None) for q, x in zip(question, calls)]
        return pd.DataFrame(made, columns=["tool", "argument"])

    @F.pandas_udf("string")
    def conclude(question: pd.Series, calls: pd.Series) -> pd.Series:
        return pd.Series([answer(q, [dict(c) for c in x]) for q, x in zip(question, calls)])

    state = tasks.select("task_id", "question", F.array().cast(f"array<{_CALL}>").alias("calls"))
    for _ in range(most):
        asked = state.withColumn("next", propose("question", "calls")).checkpoint()
        live = asked.where("next.tool is not null").select("task_id", F.col("next.tool").alias("tool"), F.col("next.argument").alias("argument")).checkpoint()
        if live.isEmpty():
            break
        search = live.where("tool = 'docs_search'").select(F.col("task_id").alias("query_id"), F.col("argument").alias("text"))
        hits = L.bm25(docs, search, k).join(docs.select("doc_id", F.col("text").alias("body")), "doc_id").groupBy(F.col("query_id").alias("task_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.concat_ws(": ", F.col("doc_id").cast("string"), "body").alias("line")))), lambda x: x["line"]), "\n").alias("o"))
        look = lambda t, tool: live.where(F.col("tool") == tool).join(t, F.col("argument") == F.col("key")).select("task_id", F.col("value").cast("string").alias("o"))
        a, b = (F.regexp_extract("argument", r"^\s*(\d+)\s*\+\s*(\d+)\s*$", i).try_cast("long") for i in (1, 2))
        sums = live.where("tool = 'calculator'").select("task_id", (a + b).cast("string").alias("o")).where("o is not null")
        told = hits.union(look(inventory, "inventory_lookup")).union(look(status, "status_lookup")).union(sums)
        done = live.join(told, "task_id", "left").select("task_id", F.struct("tool", "argument", F.coalesce("o", F.lit("NOT_FOUND")).alias("observation"), F.col("o").isNotNull().alias("success")).cast(_CALL).alias("call"))
        state = state.join(done, "task_id", "left").select("task_id", "question", F.when(F.col("call").isNotNull(), F.concat("calls", F.array("call"))).otherwise(F.col("calls")).alias("calls")).checkpoint()
    cost = F.create_map(*[F.lit(x) for kv in COSTS.items() for x in kv])
    return state.select("task_id", conclude("question", "calls").alias("answer"), "calls", F.size("calls").alias("n_calls"), F.aggregate("calls", F.lit(0.0), lambda s, c: s + cost[c["tool"]]).alias("cost"))
