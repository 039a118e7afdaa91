"""Sorted sets: (key, member, score), ordered by score, then member bytes.

Requests are DataFrames with a row for each key asked for, so one plan answers
many. ``desc`` reverses both score and member.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.glob import matches
from ..functions.places import numbered
from ..model import bounds, upsert, without


def _order(desc: bool) -> list[Column]:
    return [F.desc("score"), F.desc("member")] if desc else [F.asc("score"), F.asc("member")]


def ranked(z: DataFrame, desc: bool = False) -> DataFrame:
    """``rank``: each member's place, from 0."""
    every = numbered(z, ["score", "member"], "rank")
    return every.withColumn("rank", F.col("length") - 1 - F.col("rank") if desc else F.col("rank")).drop("length")


def _first(z: DataFrame, n: int, desc: bool) -> DataFrame:
    """The first ``n`` of every key with their ``rank``: Spark limits each key before it shuffles."""
    nth = F.row_number().over(W.partitionBy("key").orderBy(*_order(desc)))
    return z.withColumn("_nth", nth).where(F.col("_nth") <= n).withColumn("rank", (F.col("_nth") - 1).cast("long")).drop("_nth")


def zadd(z: DataFrame, new: DataFrame) -> DataFrame:
    """Add or replace scores; ``new``: (key, member, score, pos). Of a member's scores in one call the first counts."""
    first = new.groupBy("key", "member").agg((F.min_by("score", "pos") + 0.0).alias("score"))
    return upsert(z, first, "key", "member")


def zadd_count(z: DataFrame, new: DataFrame) -> DataFrame:
    """Members that :func:`zadd` adds, by key."""
    fresh = new.select("key", "member").distinct().join(z.select("key", "member"), ["key", "member"], "left_anti")
    added = fresh.groupBy("key").agg(F.count(F.lit(1)).alias("added"))
    return new.select("key").distinct().join(added, "key", "left").select("key", F.coalesce("added", F.lit(0)).alias("added"))


def zincrby(z: DataFrame, by: DataFrame) -> DataFrame:
    """Add to scores, missing ones being 0; ``by``: (key, member, by). Returns the new table."""
    return z.select("key", "member", "score").union(by.select("key", "member", F.col("by").alias("score"))).groupBy("key", "member").agg((F.sum("score") + 0.0).alias("score"))


def zrem(z: DataFrame, gone: DataFrame) -> DataFrame:
    return without(z, gone, "key", "member")


def zcard(z: DataFrame) -> DataFrame:
    return z.groupBy("key").agg(F.count(F.lit(1)).alias("card"))


def zscore(z: DataFrame, asked: DataFrame) -> DataFrame:
    """The score of each asked (key, member), null where there is none."""
    return asked.join(z, ["key", "member"], "left")


def zrank(z: DataFrame, asked: DataFrame, desc: bool = False) -> DataFrame:
    """The rank of each asked (key, member): how many members of its key come before it; null for one that isn't there."""
    some = z.join(asked.select("key").distinct(), "key", "left_semi")
    return asked.join(ranked(some, desc).select("key", "member", "rank"), ["key", "member"], "left")


def zrange(z: DataFrame, asked: DataFrame, desc: bool = False) -> DataFrame:
    """Members from rank ``start`` to ``stop``, inclusive, negative ones from the end; ``asked``: (key, start, stop)."""
    n = zcard(z.join(asked.select("key").distinct(), "key", "left_semi"))
    first, last = bounds(F.col("start"), F.col("stop"), F.col("card"))
    wanted = asked.join(n, "key").withColumn("first", first).withColumn("last", last)
    return ranked(z, desc).join(wanted, "key").where("rank between first and last").select("key", "rank", "member", "score")


def top(z: DataFrame, n: int, desc: bool = True) -> DataFrame:
    """The first ``n`` of every key."""
    return _first(z, n, desc)


def in_scores(low: float | Column | None = None, high: float | Column | None = None, open_low: bool = False, open_high: bool = False) -> Column:
    """A score range; None: unbounded; open ends leave the bound out."""
    score, ok = F.col("score"), F.lit(True)
    if low is not None:
        ok = ok & (score > low if open_low else score >= low)
    if high is not None:
        ok = ok & (score < high if open_high else score <= high)
    return ok


def in_members(low: str | None = None, high: str | None = None, open_low: bool = False, open_high: bool = False) -> Column:
    """A range of members by their bytes; None: unbounded."""
    member, ok = F.col("member"), F.lit(True)
    if low is not None:
        ok = ok & (member > low if open_low else member >= low)
    if high is not None:
        ok = ok & (member < high if open_high else member <= high)
    return ok


def zrangeby(z: DataFrame, ok: Column, offset: int = 0, count: int | None = None, desc: bool = False) -> DataFrame:
    """Members in a range of scores or of bytes, per key in order, ``count`` of them from ``offset``; by bytes all scores are equal."""
    out = _first(z.where(ok), offset + count, desc) if count is not None and count >= 0 else ranked(z.where(ok), desc)
    if offset:
        out = out.where(F.col("rank") >= offset)
    return out.withColumn("rank", F.col("rank") - offset)


def zcount(z: DataFrame, ok: Column) -> DataFrame:
    return z.groupBy("key").agg(F.count_if(ok).alias("n"))


def zremrangebyrank(z: DataFrame, start: int, stop: int) -> DataFrame:
    first, last = bounds(F.lit(start).cast("long"), F.lit(stop).cast("long"), F.col("card"))
    return ranked(z).join(zcard(z), "key").where(~F.col("rank").between(first, last)).select("key", "member", "score")


def zremrangeby(z: DataFrame, ok: Column) -> DataFrame:
    return z.where(~ok)


def zpop(z: DataFrame, n: int, desc: bool) -> tuple[DataFrame, DataFrame]:
    """(popped, left): the ``n`` highest or lowest members of every key, and the others."""
    popped = _first(z, n, desc)
    return popped, without(z.select("key", "member", "score"), popped, "key", "member")


_FOLDS = {"sum": F.sum, "min": F.min, "max": F.max}


def zunionstore(z: DataFrame, inputs: DataFrame, fold: str = "sum") -> DataFrame:
    """The weighted union under each ``dst``; ``inputs``: (dst, key, weight), a row for each key given."""
    weighted = z.join(inputs, "key").withColumn("score", F.col("score") * F.col("weight"))
    return weighted.groupBy(F.col("dst").alias("key"), "member").agg((_FOLDS[fold]("score") + 0.0).alias("score"))


def zinterstore(z: DataFrame, inputs: DataFrame, fold: str = "sum") -> DataFrame:
    """The weighted intersection under each ``dst``: members of every key given."""
    numbered = inputs.withColumn("_n", F.monotonically_increasing_id())
    need = inputs.groupBy(F.col("dst").alias("key")).agg(F.count(F.lit(1)).alias("_need"))
    weighted = z.join(numbered, "key").withColumn("score", F.col("score") * F.col("weight"))
    out = weighted.groupBy(F.col("dst").alias("key"), "member").agg((_FOLDS[fold]("score") + 0.0).alias("score"), F.count(F.lit(1)).alias("_c"))
    return out.join(need, "key").where("_c = _need").select("key", "member", "score")


def stored_as(z: DataFrame, result: DataFrame, dst: DataFrame) -> DataFrame:
    """``z`` with each ``dst`` key replaced by ``result``; an empty result leaves no such key."""
    return without(z, dst, "key").unionByName(result.select("key", "member", "score"))


def zscan(z: DataFrame, cursor: int, count: int, pattern: str = "*") -> DataFrame:
    """A page of each key's members in byte order: ``count`` are visited from ``cursor``, those that match are returned."""
    at = (F.row_number().over(W.partitionBy("key").orderBy("member")) - 1).cast("long")
    return z.withColumn("at", at).where(F.col("at") < cursor + count).where(F.col("at") >= cursor).where(matches("member", pattern))
