"""The driver's tables as tables of the data model, in Spark and, by the same names, as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The instant that expiry is judged at: 2024-01-15 00:00 UTC.
NOW = 1_705_276_800_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return read(spark, sf_dir, "events").withColumn("us", us).withColumn("ms", F.expr("us div 1000"))


def zsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("member")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("score"))


def zsets2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("member"), F.col("c_acctbal").alias("score"))


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("key"), F.col("o_custkey").cast("string").alias("member")).distinct()


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c_).cast("string").alias("value")) for f, c_ in (("name", "c_name"), ("nation", "c_nationkey"), ("segment", "c_mktsegment"))])
    return c.select(F.concat(F.lit("customer:"), "c_custkey").alias("key"), F.explode(fields).alias("f")).select("key", "f.field", "f.value")


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = F.row_number().over(W.partitionBy("user_id").orderBy("us", "event_id")) - 1
    return _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), idx.cast("long").alias("idx"), F.col("event_type").alias("value"))


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    never = F.lit(None).cast("long")
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), "doc_id").alias("key"), F.col("text").alias("value"), never.alias("etime_ms"))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    etime = F.when(F.col("event_id") % 5 != 0, F.col("ms") + (F.col("event_id") % 7) * 86_400_000)
    return e.select(F.concat(F.lit("n:"), "event_id").alias("key"), F.col("user_id").cast("string").alias("value"), etime.alias("etime_ms"))


def keyspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("string", "hash", "set", "list", "zset", "stream")))
    e = _events(spark, sf_dir)
    etime = F.when((F.col("event_id") % 5 != 0) & (F.col("event_id") % 6 != 5), F.col("ms") + (F.col("event_id") % 7) * 86_400_000)
    return e.select(F.concat(F.lit("k:"), "event_id").alias("key"), kinds[(F.col("event_id") % 6).cast("int")].alias("type"), etime.alias("etime_ms"))


def bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").where("value > 20").select(F.col("event_type").alias("key"), F.col("user_id").cast("long").alias("off")).distinct()


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.row_number().over(W.partitionBy("event_type", "ms").orderBy("event_id")) - 1
    return _events(spark, sf_dir).select(F.col("event_type").alias("key"), "ms", seq.cast("long").alias("seq"), "event_id", "user_id")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon = ((F.col("c_custkey") * 7919) % 36000) / 100.0 - 180
    lat = ((F.col("c_custkey") * 104729) % 17000) / 100.0 - 85
    return read(spark, sf_dir, "customer").select(F.lit("cities").alias("key"), F.col("c_name").alias("member"), lon.alias("lon"), lat.alias("lat"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("channel"), F.col("user_id").cast("string").alias("msg"))


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET, INCRBY and DEL on a key per user, in transactions of ten operations."""
    e = read(spark, sf_dir, "events")
    op = F.when(F.col("event_id") % 11 == 0, "DEL").when(F.col("event_id") % 4 == 0, "SET").otherwise("INCRBY")
    return e.select(F.col("event_id").alias("seq"), F.expr("event_id div 10").alias("txn"), op.alias("op"), F.concat(F.lit("u:"), "user_id").alias("key"), (F.col("event_id") % 100).alias("arg"))


_MS = "epoch_us(ts)//1000"
SQL = {
    "z": "z AS (SELECT event_type AS key, CAST(user_id AS VARCHAR) AS member, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS score FROM events GROUP BY 1, 2)",
    "z2": "z2 AS (SELECT c_mktsegment AS key, c_name AS member, c_acctbal AS score FROM customer)",
    "s": "s AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS key, CAST(o_custkey AS VARCHAR) AS member FROM orders)",
    "h": "h AS (SELECT 'customer:' || c_custkey AS key, 'name' AS field, c_name AS value FROM customer UNION ALL SELECT 'customer:' || c_custkey, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT 'customer:' || c_custkey, 'segment', c_mktsegment FROM customer)",
    "l": "l AS (SELECT CAST(user_id AS VARCHAR) AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_type AS value FROM events)",
    "k": "k AS (SELECT 'doc:' || doc_id AS key, text AS value FROM documents)",
    "c": f"c AS (SELECT 'n:' || event_id AS key, CAST(user_id AS VARCHAR) AS value, CASE WHEN event_id % 5 <> 0 THEN {_MS} + (event_id % 7) * 86400000 END AS etime_ms FROM events)",
    "ks": f"ks AS (SELECT 'k:' || event_id AS key, list_extract(['string','hash','set','list','zset','stream'], CAST(event_id % 6 AS INT) + 1) AS type, CASE WHEN event_id % 5 <> 0 AND event_id % 6 <> 5 THEN {_MS} + (event_id % 7) * 86400000 END AS etime_ms FROM events)",
    "b": "b AS (SELECT DISTINCT event_type AS key, CAST(user_id AS BIGINT) AS off FROM events WHERE value > 20)",
    "x": f"x AS (SELECT event_type AS key, {_MS} AS ms, row_number() OVER (PARTITION BY event_type, {_MS} ORDER BY event_id) - 1 AS seq, event_id, user_id FROM events)",
    "g0": "g0 AS (SELECT 'cities' AS key, c_name AS member, ((c_custkey*7919) % 36000)/100.0 - 180 AS lon, ((c_custkey*104729) % 17000)/100.0 - 85 AS lat FROM customer)",
    "o": "o AS (SELECT event_id AS seq, event_id // 10 AS txn, CASE WHEN event_id % 11 = 0 THEN 'DEL' WHEN event_id % 4 = 0 THEN 'SET' ELSE 'INCRBY' END AS op, 'u:' || user_id AS key, event_id % 100 AS arg FROM events)",
}


def sql(names: str, body: str) -> str:
    """A query over the named tables."""
    return "WITH " + ", ".join(SQL[n] for n in names.split()) + " " + body
