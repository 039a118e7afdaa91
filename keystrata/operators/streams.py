"""Append-only streams: (key, ms, seq, fields...), in order of the id (ms, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _id() -> Column:
    return F.struct("ms", "seq")


def identified(new: DataFrame, order: str) -> DataFrame:
    """``seq`` of entries (key, ms, ...) that came in ``order``: from 0 in each millisecond of a stream."""
    return new.withColumn("seq", (F.row_number().over(W.partitionBy("key", "ms").orderBy(order)) - 1).cast("long"))


def xadd(x: DataFrame, new: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(table, rejected): entries with ids, in order; one whose id isn't above all before it, or is 0-0, is rejected."""
    last = x.groupBy("key").agg(F.max(_id()).alias("_last"))
    before = F.max(_id()).over(W.partitionBy("key").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    told = new.join(last, "key", "left").withColumn("_before", before)
    ok = F.coalesce(_id() > F.col("_before"), F.lit(True)) & F.coalesce(_id() > F.col("_last"), F.lit(True)) & ((F.col("ms") > 0) | (F.col("seq") > 0))
    told = told.withColumn("_ok", ok)
    return x.unionByName(told.where("_ok").select(*x.columns)), told.where("not _ok").drop("_ok", "_before", "_last")


def xadd_auto(x: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """``x`` with entries (key, ms, ...) that get their ``seq``: the clock's ``ms`` unless the stream is further on, then the stream's, and the next number in it; 0-0 is never given."""
    last = x.groupBy("key").agg(F.max(_id()).alias("_last"))
    clock = F.max("ms").over(W.partitionBy("key").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    told = new.withColumn("_clock", clock).join(last, "key", "left").withColumn("ms", F.greatest("_clock", F.coalesce("_last.ms", F.lit(0))))
    nth = F.row_number().over(W.partitionBy("key", "ms").orderBy(order)) - 1
    first = F.when(F.col("_last.ms") == F.col("ms"), F.col("_last.seq") + 1).when(F.col("ms") == 0, 1).otherwise(0)
    return x.unionByName(told.withColumn("seq", (first + nth).cast("long")).select(*x.columns))


def xlen(x: DataFrame) -> DataFrame:
    return x.groupBy("key").agg(F.count(F.lit(1)).alias("length"))


def in_ids(low: tuple[int, int] | None = None, high: tuple[int, int] | None = None, open_low: bool = False, open_high: bool = False) -> Column:
    """A range of ids; None: unbounded. The ms bound alone can reach the source."""
    at = lambda i: F.struct(F.lit(i[0]).cast("long"), F.lit(i[1]).cast("long"))
    ok = F.lit(True)
    if low is not None:
        ok = ok & (F.col("ms") >= low[0]) & (_id() > at(low) if open_low else _id() >= at(low))
    if high is not None:
        ok = ok & (F.col("ms") <= high[0]) & (_id() < at(high) if open_high else _id() <= at(high))
    return ok


def _first(x: DataFrame, count: int | None, desc: bool = False) -> DataFrame:
    order = [F.desc("ms"), F.desc("seq")] if desc else [F.asc("ms"), F.asc("seq")]
    out = x.withColumn("nth", F.row_number().over(W.partitionBy("key").orderBy(*order)))
    return out if count is None else out.where(F.col("nth") <= count)


def xrange(x: DataFrame, ok: Column, count: int | None = None, desc: bool = False) -> DataFrame:
    return _first(x.where(ok), count, desc)


def xread(x: DataFrame, cursors: DataFrame, count: int | None = None) -> DataFrame:
    """Entries above each cursor (key, after_ms, after_seq); null: above the last one, so none."""
    above = x.join(cursors, "key").where(_id() > F.struct(F.col("after_ms").alias("ms"), F.col("after_seq").alias("seq"))).where("after_ms is not null")
    return _first(above.drop("after_ms", "after_seq"), count)


def xtrim_len(x: DataFrame, most: int) -> DataFrame:
    """The newest ``most`` of each stream."""
    return _first(x, most, desc=True).drop("nth")


def xtrim_id(x: DataFrame, least: tuple[int, int]) -> DataFrame:
    return x.where(in_ids(low=least))


def xdel(x: DataFrame, gone: DataFrame) -> DataFrame:
    return x.join(gone.select("key", "ms", "seq").distinct(), ["key", "ms", "seq"], "left_anti")


def xinfo(x: DataFrame) -> DataFrame:
    out = x.groupBy("key").agg(F.count(F.lit(1)).alias("length"), F.min(_id()).alias("a"), F.max(_id()).alias("b"))
    text = lambda c: F.concat_ws("-", F.col(f"{c}.ms").cast("string"), F.col(f"{c}.seq").cast("string"))
    return out.select("key", "length", text("a").alias("first_id"), text("b").alias("last_id"))
