"""Structured Streaming: windowed event counts with late data, and an index kept current by upserts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import lexical as L
from skein.operators.graph import use_checkpoints


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    use_checkpoints(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir()
    return f"{base.get() if base.isDefined() else tempfile.mkdtemp()}/stream-{uuid.uuid4().hex}"


def windowed(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events (ts, event_type, value) counted and summed in tumbling windows by type; events later than late are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Events (ts, user_id) in sessions that a gap ends."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return s.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a streaming query over all that there is now; its result, through an exactly-once sink, as a table."""
    spark, at = stream.sparkSession, scratch(stream.sparkSession)
    if mode == "append":
        stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
        return spark.read.parquet(f"{at}/out")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


BUCKETS = 16


def upsert_stream(changes: DataFrame, base: DataFrame, path: str, key: str = "doc_id") -> None:
    """Applies streamed changes (columns of base, op, generation) to a table under path, which current() reads.

    The table keeps each key's last op and generation, deletes too, so a change that comes late, in whatever batch, never replaces a
    newer one, and a batch that is repeated changes nothing. A micro-batch rewrites the buckets of its keys only.
    """
    spark = changes.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    first = base.withColumn("op", F.lit("upsert")).withColumn("generation", F.lit(-1).cast("long")).withColumn("bucket", bucket)
    first.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/table")
    schema = first.schema

    def apply(batch: DataFrame, epoch: int) -> None:
        new = batch.withColumn("bucket", bucket).select(*schema.names).checkpoint()
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
        if touched:
            old = spark.read.schema(schema).parquet(f"{path}/table").where(F.col("bucket").isin(*touched))
            last = L.latest(old.unionByName(new), key, F.desc("generation"), "op").checkpoint()
            last.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/table")

    use_checkpoints(spark)
    changes.writeStream.foreachBatch(apply).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows that upsert_stream() left, without the deleted ones."""
    return spark.read.parquet(f"{path}/table").where("op = 'upsert'").drop("op", "generation", "bucket")


def sliding(events: DataFrame, window: str = "1 day", slide: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Events (ts, event_type, value) in overlapping windows by type."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window, slide).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
