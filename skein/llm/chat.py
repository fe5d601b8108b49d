"""Chat formatting: cumulative snapshots collapse to the maximal conversations, which are then rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import _text as X

START, END = "<|im_start|>", "<|im_end|>"


def _plain(c: Column) -> Column:
    """Text that can't be taken for a marker."""
    return F.replace(F.replace(c, F.lit(START), F.lit("<| im_start |>")), F.lit(END), F.lit("<| im_end |>"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that are neither a prefix of a longer one nor a copy of one with a smaller conv_id.

    Only hashes are exchanged. The k-th rolling hash of a conversation stands for its first k
    turns, so an equality join of last hashes with all inner ones finds the prefixes.
    """
    hashed = X.need(turns, "conv_id", "turn", "role", "text").where("conv_id is not null").select("conv_id", F.struct("turn", "role", F.md5("text").alias("h")).alias("t"))
    rolled = F.aggregate(
        F.array_distinct(F.array_sort(F.collect_list("t"))),
        F.array().cast("array<string>"),
        lambda acc, t: F.concat(acc, F.array(F.md5(F.concat_ws("/", F.try_element_at(acc, F.lit(-1)), F.coalesce(F.md5(t["role"]), F.lit("-")), F.coalesce(t["h"], F.lit("-")))))),
    )
    convs = hashed.groupBy("conv_id").agg(rolled.alias("rolled"))
    inner = convs.select(F.explode(F.slice("rolled", 1, F.greatest(F.size("rolled") - 1, F.lit(0)))).alias("full")).distinct()
    last = convs.select("conv_id", F.element_at("rolled", -1).alias("full"), F.size("rolled").alias("n_turns"))
    return last.join(inner, "full", "left_anti").groupBy("full").agg(F.min("conv_id").alias("conv_id"), F.min("n_turns").alias("n_turns")).select("conv_id", "n_turns")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, text: each maximal conversation with its turns between markers, in order.

    Turns are ordered by turn, role and the hash of their text, nulls first; repeated rows count
    once, gaps in the numbering don't matter, and whether conversations are equal depends on roles
    and texts alone. A null role is rendered as "unknown", a null text as an empty one;
    markers inside a text are broken up. Rows without conv_id are left out.
    """
    rows = X.need(turns, "conv_id", "turn", "role", "text").join(maximal(turns), "conv_id")
    line = F.concat(F.lit(START), _plain(F.coalesce("role", F.lit("unknown"))), F.lit("\n"), _plain(F.coalesce("text", F.lit(""))), F.lit(END))
    ordered = F.array_distinct(F.array_sort(F.collect_list(F.struct("turn", "role", F.md5("text").alias("h"), line.alias("line")))))
    return rows.groupBy("conv_id", "n_turns").agg(ordered.alias("t")).select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda t: t["line"]), "\n").alias("text"))


SQL = f"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS k
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)),
p AS (
  SELECT conv_id, k, string_agg(coalesce(md5(role), '-') || '/' || coalesce(md5(text), '-'), ' ' ORDER BY k) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS prefix,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM t),
m AS (
  SELECT min(conv_id) AS conv_id FROM p
  WHERE k = n AND prefix NOT IN (SELECT prefix FROM p WHERE k < n) GROUP BY prefix)
SELECT conv_id, count(*) AS n_turns,
  string_agg('{START}' || replace(replace(coalesce(role, 'unknown'), '{START}', '<| im_start |>'), '{END}', '<| im_end |>') || chr(10)
    || replace(replace(coalesce(text, ''), '{START}', '<| im_start |>'), '{END}', '<| im_end |>') || '{END}', chr(10) ORDER BY k) AS text
FROM t JOIN m USING (conv_id) GROUP BY conv_id
"""


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
