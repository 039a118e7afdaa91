"""The key space: existence, expiry, types, scans and the census of (key, type, etime_ms)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.glob import matches
from ..model import TYPE_ORDER, is_live, live, without


def exists(keys: DataFrame, asked: DataFrame, now: int) -> DataFrame:
    """Asked rows whose key is alive; a key that is asked twice counts twice."""
    return asked.join(live(keys, now).select("key").distinct(), "key", "left_semi")


def delete(keys: DataFrame, gone: DataFrame) -> DataFrame:
    return without(keys, gone, "key")


def types(keys: DataFrame, asked: DataFrame, now: int) -> DataFrame:
    """``type`` of each asked key, "none" for one that isn't alive."""
    return asked.join(live(keys, now).select("key", "type"), "key", "left").withColumn("type", F.coalesce("type", F.lit("none")))


def ttl(keys: DataFrame, asked: DataFrame, now: int, unit_ms: int = 1000) -> DataFrame:
    """What is left of each asked key's time in units: -1 without expiry, -2 for none; streams never have an expiry and answer -2."""
    found = asked.join(keys.where("type <> 'stream'").select("key", F.lit(True).alias("_there"), "etime_ms"), "key", "left")
    left = F.when(F.col("_there").isNull() | ~is_live(now), -2).when(F.col("etime_ms").isNull(), -1).otherwise(F.floor((F.col("etime_ms") - now) / unit_ms))
    return found.select(*asked.columns, left.cast("long").alias("ttl"))


def expire_at(keys: DataFrame, asked: DataFrame, now: int) -> DataFrame:
    """Keys with the expiry of ``asked`` (key, at_ms); one not after ``now`` deletes the key; streams and dead keys are left alone."""
    at = keys.join(asked.select("key", "at_ms"), "key", "left")
    can = F.col("at_ms").isNotNull() & (F.col("type") != "stream") & is_live(now)
    return at.where(~F.coalesce(can & (F.col("at_ms") <= now), F.lit(False))).withColumn("etime_ms", F.when(can, F.col("at_ms")).otherwise(F.col("etime_ms"))).select(*keys.columns)


def expire_in(keys: DataFrame, asked: DataFrame, now: int, unit_ms: int = 1000) -> DataFrame:
    """The same from ``asked`` (key, ttl) in units from now."""
    return expire_at(keys, asked.select("key", (F.col("ttl") * unit_ms + now).alias("at_ms")), now)


def persist(keys: DataFrame, asked: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(answers, table): 1 if an expiry was taken away."""
    had = live(keys, now).where("etime_ms is not null").select("key", F.lit(1).alias("reply"))
    answers = asked.join(had, "key", "left").withColumn("reply", F.coalesce("reply", F.lit(0)))
    hit = answers.where("reply = 1").select("key", F.lit(True).alias("_hit"))
    return answers, keys.join(hit, "key", "left").withColumn("etime_ms", F.when(F.col("_hit").isNull(), F.col("etime_ms"))).select(*keys.columns)


def like(keys: DataFrame, pattern: str, now: int, kind: str | None = None) -> DataFrame:
    """Live keys that match a glob, of one type if given."""
    out = live(keys, now).where(matches("key", pattern))
    return out.where(F.col("type") == kind) if kind else out


def scan(keys: DataFrame, cursor: int, count: int, now: int, pattern: str = "*", kind: str | None = None) -> DataFrame:
    """A page of live keys that match, by type, then key: ``count`` are returned from ``cursor``."""
    place = F.array_position(F.array(*map(F.lit, TYPE_ORDER)), F.col("type"))
    return like(keys, pattern, now, kind).orderBy(place, "key").offset(cursor).limit(count)


def key_range(keys: DataFrame, kind: str, now: int, start: str = "", stop: str = "", limit: int = 10, pattern: str = "*", desc: bool = False) -> DataFrame:
    """Live keys of one type from ``start`` to ``stop``, inclusive ("": unbounded): the first ``limit`` that match, and whether one is the next page's start."""
    if start and stop and (stop > start if desc else start > stop):
        raise ValueError("start lies behind stop")
    low, high = (stop, start) if desc else (start, stop)
    out = like(keys, pattern, now, kind)
    out = out.where(F.col("key") >= low) if low else out
    out = out.where(F.col("key") <= high) if high else out
    page = out.select("key").orderBy(F.desc("key") if desc else F.asc("key")).limit(limit + 1)
    ends = page.agg((F.min("key") if desc else F.max("key")).alias("_end"), F.count(F.lit(1)).alias("_n"))
    is_next = (F.col("_n") > limit) & (F.col("key") == F.col("_end"))
    return page.join(F.broadcast(ends)).select("key", is_next.alias("is_next"))  # one row


def delete_like(keys: DataFrame, pattern: str, most: int, now: int) -> tuple[DataFrame, DataFrame]:
    """(deleted, table): the first ``most`` live keys by bytes that match."""
    gone = like(keys, pattern, now).select("key").orderBy("key").limit(most)
    return gone, delete(keys, gone)


def census(keys: DataFrame, now: int) -> DataFrame:
    """Per type: live keys, those with an expiry, their mean time left, and dead keys."""
    alive, timed = is_live(now), F.col("etime_ms").isNotNull()
    return keys.groupBy("type").agg(
        F.count_if(alive).alias("n_keys"),
        F.count_if(alive & timed).alias("n_expires"),
        F.coalesce(F.floor(F.avg(F.when(alive & timed, F.col("etime_ms") - now))), F.lit(0)).cast("long").alias("avg_ttl_ms"),
        F.count_if(~alive).alias("n_stale"),
    )


def compact(members: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    """Member rows of live keys: what a rewrite keeps."""
    return members.join(live(keys, now).select("key"), "key", "left_semi")
