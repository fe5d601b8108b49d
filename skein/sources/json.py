"""Loaders of JSON and JSON lines: collections in one document, templates, splits that must not overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lines(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """One row for each line; a line that is no JSON is refused."""
    r = spark.read.option("mode", "FAILFAST")
    return (r.schema(schema) if schema else r).json(path)


def collection(spark: SparkSession, path: str, field: str | None = None, schema: str | T.StructType | None = None) -> DataFrame:
    """The rows of an array: the document itself, or its field."""
    r = spark.read.option("mode", "FAILFAST").option("multiLine", True)
    whole = (r.schema(schema) if schema else r).json(path)
    return whole.select(F.explode(field).alias("row")).select("row.*") if field else whole


def mapping(spark: SparkSession, path: str, field: str, value: str = "string") -> DataFrame:
    """key, value of an object in a field of the document."""
    whole = spark.read.option("mode", "FAILFAST").option("multiLine", True).schema(f"`{field}` map<string,{value}>").json(path)
    return whole.select(F.explode(field).alias("key", "value"))


def render(template: Column, values: dict[str, Column]) -> Column:
    """A template with {name} in place of values; spaces collapse."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def check_splits(rows: DataFrame, split: str, *keys: str) -> None:
    """A ValueError where a value of one of keys is in more than one split."""
    for key in keys:
        if not rows.groupBy(key).agg(F.count_distinct(split).alias("n")).where("n > 1").isEmpty():
            raise ValueError(f"{key} crosses splits")


def distractors(docs: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """doc_id, text: n texts made of the words of docs, each word taken from the document that a hash names; they look like docs and answer nothing."""
    ids = docs.sparkSession.range(n).select(F.concat(F.lit("distractor-"), "id").alias("doc_id"), "id")
    words = docs.select(F.explode(F.slice(F.split("text", r"\s+"), 1, 40)).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("c"))
    dealt = words.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(9)))).select("w", F.pmod(F.xxhash64("w", "slot", F.lit(seed)), F.lit(max(1, n))).alias("id"), F.xxhash64("w", "slot").alias("o"))
    text = dealt.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "w"))), lambda x: x["w"]), " ").alias("text"))
    return ids.join(text, "id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def expand(docs: DataFrame, extra: DataFrame) -> DataFrame:
    """docs and extra, none of whose ids may be in both."""
    if not docs.join(extra, "doc_id", "left_semi").isEmpty():
        raise ValueError("ids in both")
    return docs.unionByName(extra)
