"""Lists: (key, idx, value), in order of idx; positions are counted from 0 and may count from the end.

Pushes only add rows: an index grows in both directions, so no row is renumbered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.places import numbered
from ..model import bounds


def llen(t: DataFrame) -> DataFrame:
    return t.groupBy("key").agg(F.count(F.lit(1)).alias("length"))


def placed(t: DataFrame) -> DataFrame:
    """``pos``: each element's position; ``length``: its list's."""
    return numbered(t, ["idx"])


def push(t: DataFrame, new: DataFrame, left: bool, only_present: bool = False) -> DataFrame:
    """Elements of ``new`` (key, pos, value) put before or behind their lists one by one."""
    if only_present:
        new = new.join(t.select("key").distinct(), "key", "left_semi")
    ends = t.groupBy("key").agg(F.min("idx").alias("_lo"), F.max("idx").alias("_hi"))
    n = F.row_number().over(W.partitionBy("key").orderBy("pos"))
    idx = F.coalesce("_lo", F.lit(1)) - F.col("_n") if left else F.coalesce("_hi", F.lit(-1)) + F.col("_n")
    added = new.withColumn("_n", n).join(ends, "key", "left").select("key", idx.cast("long").alias("idx"), "value")
    return t.select("key", "idx", "value").unionByName(added)


def lindex(t: DataFrame, asked: DataFrame) -> DataFrame:
    """``value`` at each asked (key, i), null out of range."""
    at = F.when(F.col("i") < 0, F.col("i") + F.col("length")).otherwise(F.col("i"))
    want = asked.join(llen(t), "key", "left").withColumn("pos", at)
    return want.join(placed(t).select("key", "pos", "value"), ["key", "pos"], "left").select(*asked.columns, "value")


def lrange(t: DataFrame, start: int, stop: int) -> DataFrame:
    first, last = bounds(F.lit(start).cast("long"), F.lit(stop).cast("long"), F.col("length"))
    return placed(t).where(F.col("pos").between(first, last)).select("key", "pos", "idx", "value")


def ltrim(t: DataFrame, start: int, stop: int) -> DataFrame:
    return lrange(t, start, stop).select("key", "idx", "value")


def lset(t: DataFrame, asked: DataFrame) -> DataFrame:
    """Elements replaced at ``asked`` (key, i, new); a position out of range is an error."""
    at = F.when(F.col("i") < 0, F.col("i") + F.col("length")).otherwise(F.col("i"))
    want = asked.join(llen(t), "key").withColumn("pos", F.when((at >= 0) & (at < F.col("length")), at).otherwise(F.raise_error(F.lit("index out of range")).cast("long")))
    out = placed(t).join(want.select("key", "pos", "new"), ["key", "pos"], "left")
    return out.select("key", "idx", F.coalesce("new", "value").alias("value"))


def linsert(t: DataFrame, asked: DataFrame, before: bool) -> DataFrame:
    """``new`` put next to the first element equal to ``pivot``; ``asked``: (key, pivot, new). Indexes are spread anew."""
    pivot = t.join(asked.withColumnRenamed("pivot", "value"), ["key", "value"]).groupBy("key", "new").agg(F.min("idx").alias("idx"))
    added = pivot.select("key", (F.col("idx") * 2 + (-1 if before else 1)).alias("idx"), F.col("new").alias("value"))
    return t.select("key", (F.col("idx") * 2).alias("idx"), "value").unionByName(added)


def linsert_replies(t: DataFrame, asked: DataFrame) -> DataFrame:
    """The new length; -1 without such a pivot, 0 without such a list."""
    hit = t.join(asked.withColumnRenamed("pivot", "value"), ["key", "value"], "left_semi").select("key", F.col("value").alias("pivot")).distinct().withColumn("_hit", F.lit(1))
    reply = F.when(F.col("length").isNull(), 0).when(F.col("_hit").isNull(), -1).otherwise(F.col("length") + 1)
    return asked.join(llen(t), "key", "left").join(hit, ["key", "pivot"], "left").select("key", reply.cast("long").alias("reply"))


def lrem(t: DataFrame, value: str, count: int) -> DataFrame:
    """Without the first (``count`` > 0), last (< 0) or all (0) elements equal to ``value``."""
    if count == 0:
        return t.where(F.col("value") != value)
    order = F.asc("idx") if count > 0 else F.desc("idx")
    hit = t.where(F.col("value") == value).withColumn("_n", F.row_number().over(W.partitionBy("key").orderBy(order))).where(F.col("_n") <= abs(count))
    return t.join(hit.select("key", "idx"), ["key", "idx"], "left_anti")


def pop(t: DataFrame, n: int, left: bool) -> tuple[DataFrame, DataFrame]:
    """(popped in order, left): ``n`` elements from one end of every list."""
    order = F.asc("idx") if left else F.desc("idx")
    popped = t.withColumn("nth", F.row_number().over(W.partitionBy("key").orderBy(order))).where(F.col("nth") <= n)
    return popped, t.join(popped.select("key", "idx"), ["key", "idx"], "left_anti")


def rpoplpush(t: DataFrame, moves: DataFrame) -> DataFrame:
    """The tail of each ``src`` put at the head of its ``dst``; the same list is turned by one."""
    tail, left = pop(t.join(moves.select(F.col("src").alias("key")).distinct(), "key", "left_semi"), 1, left=False)
    rest = t.join(tail.select("key", "idx"), ["key", "idx"], "left_anti")
    moved = tail.join(moves, tail["key"] == moves["src"]).select(F.col("dst").alias("key"), F.lit(0).alias("pos"), "value")
    return push(rest, moved, left=True)


def pop_first(t: DataFrame, asked: DataFrame, left: bool) -> DataFrame:
    """Per request, the end of its first list that isn't empty; ``asked``: (request, nth, key)."""
    end, _ = pop(t, 1, left)
    found = asked.join(end.select("key", "value"), "key")
    return found.groupBy("request").agg(F.min_by(F.struct("key", "value"), "nth").alias("e")).select("request", "e.*")
