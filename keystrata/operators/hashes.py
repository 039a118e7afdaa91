"""Hashes: (key, field, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.glob import matches
from ..model import long_of, number_text, upsert, without


def hset(h: DataFrame, new: DataFrame) -> DataFrame:
    """Fields set; ``new``: (key, field, value, pos), the last of a field counts."""
    last = new.groupBy("key", "field").agg(F.max_by("value", "pos").alias("value"))
    return upsert(h, last, "key", "field")


def hset_replies(h: DataFrame, new: DataFrame) -> DataFrame:
    """1 for each (key, field) that is new, 0 for one that is overwritten."""
    had = h.select("key", "field", F.lit(0).alias("reply"))
    return new.select("key", "field").distinct().join(had, ["key", "field"], "left").withColumn("reply", F.coalesce("reply", F.lit(1)))


def hsetnx(h: DataFrame, new: DataFrame) -> DataFrame:
    """The first value of each field that isn't there yet."""
    first = new.groupBy("key", "field").agg(F.min_by("value", "pos").alias("value"))
    return h.unionByName(without(first, h, "key", "field"))


def hget(h: DataFrame, asked: DataFrame) -> DataFrame:
    """``value`` of each asked (key, field), null where there is none; other columns of ``asked`` stay."""
    return asked.join(h, ["key", "field"], "left")


def hexists(h: DataFrame, asked: DataFrame) -> DataFrame:
    return hget(h, asked).withColumn("present", F.col("value").isNotNull().cast("int")).drop("value")


def hstrlen(h: DataFrame, asked: DataFrame) -> DataFrame:
    return hget(h, asked).withColumn("length", F.coalesce(F.octet_length("value"), F.lit(0)).cast("long")).drop("value")


def hdel(h: DataFrame, gone: DataFrame) -> DataFrame:
    return without(h, gone, "key", "field")


def hlen(h: DataFrame) -> DataFrame:
    return h.groupBy("key").agg(F.count(F.lit(1)).alias("length"))


def hgetall(h: DataFrame) -> DataFrame:
    """``fields`` and ``values`` of each key in byte order of the fields; a key's fields make up one row."""
    pairs = h.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("field", "value"))).alias("e"))
    return pairs.select("key", F.col("e.field").alias("fields"), F.col("e.value").alias("values"))


def hincrby(h: DataFrame, by: DataFrame) -> DataFrame:
    total = by.groupBy("key", "field").agg(F.sum("by").alias("by"))
    now = hget(h, total)
    value = F.try_add(long_of(F.col("value")), F.col("by"))
    value = F.when(value.isNull(), F.raise_error(F.lit("increment or decrement would overflow")).cast("bigint")).otherwise(value)
    return upsert(h, now.select("key", "field", value.cast("string").alias("value")), "key", "field")


def hincrbyfloat(h: DataFrame, by: DataFrame) -> DataFrame:
    total = by.groupBy("key", "field").agg(F.sum("by").alias("by"))
    value = number_text(F.coalesce(F.col("value").cast("double"), F.lit(0.0)) + F.col("by"))
    return upsert(h, hget(h, total).select("key", "field", value.alias("value")), "key", "field")


def hscan(h: DataFrame, cursor: int, count: int, pattern: str = "*") -> DataFrame:
    """A page of each key: ``count`` fields are visited in byte order from ``cursor``, those that match are returned."""
    at = (F.row_number().over(W.partitionBy("key").orderBy("field")) - 1).cast("long")
    return h.withColumn("at", at).where(F.col("at") < cursor + count).where(F.col("at") >= cursor).where(matches("field", pattern))


def field_range(h: DataFrame, start: str = "", stop: str = "", limit: int = 10, pattern: str = "*", desc: bool = False) -> DataFrame:
    """Fields of each key from ``start`` to ``stop``, inclusive ("": unbounded); ``limit`` are visited, those that match are returned."""
    low, high = (stop, start) if desc else (start, stop)
    out = h.where(F.col("field") >= low) if low else h
    out = out.where(F.col("field") <= high) if high else out
    at = F.row_number().over(W.partitionBy("key").orderBy(F.desc("field") if desc else F.asc("field")))
    return out.withColumn("at", at.cast("long")).where(F.col("at") <= limit).where(matches("field", pattern))
