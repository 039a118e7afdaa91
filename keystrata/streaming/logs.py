"""Streaming forms: appends, tailing reads, windows with late entries left out, fan-out, and a table kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.pubsub import receivers


def tail(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """New Parquet files under a path as a stream; the checkpoint is the reader's cursor."""
    return spark.readStream.schema(schema).parquet(path)


def after(entries: DataFrame, cursors: DataFrame) -> DataFrame:
    """Streamed entries (key, ms, seq, ...) above fixed cursors (key, after_ms, after_seq); a key without one reads from the start."""
    told = entries.join(cursors, "key", "left")
    above = F.struct("ms", "seq") > F.struct(F.col("after_ms").alias("ms"), F.col("after_seq").alias("seq"))
    return told.where(F.col("after_ms").isNull() | above).drop("after_ms", "after_seq")


def counts(entries: DataFrame, window: str, late: str, slide: str | None = None) -> DataFrame:
    """Entries of each key and time window; those later than ``late`` are left out."""
    at = entries.withColumn("at", F.timestamp_millis("ms")).withWatermark("at", late)
    return at.groupBy(F.window("at", window, slide), "key").agg(F.count(F.lit(1)).alias("n"))


def sessions(entries: DataFrame, gap: str, late: str) -> DataFrame:
    at = entries.withColumn("at", F.timestamp_millis("ms")).withWatermark("at", late)
    return at.groupBy(F.session_window("at", gap), "key").agg(F.count(F.lit(1)).alias("n"))


def deliver(messages: DataFrame, subscriptions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each streamed message (channel, ...) written once for each of its receivers."""

    def write(batch: DataFrame, number: int) -> None:
        batch.join(receivers(batch, subscriptions), "channel").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The latest value of each key of a stream (seq, key, value; null deletes), a version of the table for each batch.

    A batch that runs again after a failure writes the same version again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"))
        if number:
            new = spark.read.parquet(f"{path}/version={number - 1}").unionByName(new).groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"))
        new.write.mode("overwrite").parquet(f"{path}/version={number}")

    return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
