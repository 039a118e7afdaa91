"""Strings: (key, value, etime_ms). Byte positions and lengths are of the UTF-8 or binary value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import live, long_of, number_text, upsert, without


def get(t: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    """The live value of each asked key, null where there is none; ``keys`` keeps its other columns, such as a position."""
    return keys.join(live(t, now).select("key", "value"), "key", "left")


def put(t: DataFrame, new: DataFrame, now: int, only: str | None = None) -> DataFrame:
    """Set values; ``new``: (key, value, pos[, etime_ms]), the last of a key counts and its expiry replaces the old one.

    ``only``: None; "absent": keys without a live value; "present": keys with
    one; "same": keys whose value is the column ``old`` of ``new``.
    """
    if "etime_ms" not in new.columns:
        new = new.withColumn("etime_ms", F.lit(None).cast("long"))
    extra = ["old"] if only == "same" else []
    last = new.groupBy("key").agg(F.max_by(F.struct("value", "etime_ms", *extra), "pos").alias("v")).select("key", "v.*")
    alive = live(t, now)
    if only == "absent":
        last = last.join(alive.select("key"), "key", "left_anti")
    elif only == "present":
        last = last.join(alive.select("key"), "key", "left_semi")
    elif only == "same":
        last = last.join(alive.select("key", F.col("value").alias("_v")), "key").where("_v = old").drop("_v", "old")
    return upsert(t.select("key", "value", "etime_ms"), last.select("key", "value", "etime_ms"), "key")


def put_all_or_none(t: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Set all values of a ``call`` if none of its keys has a live one; ``new``: (call, key, value, pos)."""
    taken = new.join(live(t, now).select("key"), "key", "left_semi").select("call").distinct()
    return put(t, new.join(taken, "call", "left_anti"), now)


def getset(t: DataFrame, ops: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(answers, table): each op's ``old`` is the value before it; ``ops``: (key, value, seq)."""
    before = live(t, now).select("key", F.col("value").alias("_v"))
    old = F.lag("value").over(W.partitionBy("key").orderBy("seq"))
    answers = ops.withColumn("old", old).join(before, "key", "left").withColumn("old", F.coalesce("old", "_v")).drop("_v")
    return answers, put(t, ops.withColumnRenamed("seq", "pos"), now)


def delete_if_same(t: DataFrame, asked: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(answers, table): 1 deleted, 0 no such key, -1 another value; ``asked``: (key, value)."""
    have = live(t, now).select("key", F.col("value").alias("_v"))
    code = F.when(F.col("_v").isNull(), 0).when(F.col("_v") == F.col("value"), 1).otherwise(-1)
    answers = asked.join(have, "key", "left").withColumn("reply", code).drop("_v")
    return answers, without(t, answers.where("reply = 1"), "key")


def incrby(t: DataFrame, by: DataFrame, now: int) -> DataFrame:
    """Integers with all of a key's ``by`` added; a missing key is 0, the expiry stays, text that is no integer or a sum beyond 64 bits is an error."""
    total = by.groupBy("key").agg(F.sum("by").alias("by"))
    alive = live(t, now).join(total, "key", "right")
    start = long_of(F.col("value"))
    value = F.try_add(start, F.col("by"))
    value = F.when(value.isNull(), F.raise_error(F.lit("increment or decrement would overflow")).cast("bigint")).otherwise(value)
    return upsert(t.select("key", "value", "etime_ms"), alive.select("key", value.cast("string").alias("value"), "etime_ms"), "key")


def incrbyfloat(t: DataFrame, by: DataFrame, now: int) -> DataFrame:
    """The same with doubles, written without trailing zeros."""
    total = by.groupBy("key").agg(F.sum("by").alias("by"))
    alive = live(t, now).join(total, "key", "right")
    value = number_text(F.coalesce(F.col("value").cast("double"), F.lit(0.0)) + F.col("by"))
    return upsert(t.select("key", "value", "etime_ms"), alive.select("key", value.alias("value"), "etime_ms"), "key")


def append(t: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Suffixes of a key put behind its value in order of ``pos``; the expiry stays."""
    tail = new.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]), "").alias("_tail"))
    alive = live(t, now).join(tail, "key", "right")
    return upsert(t.select("key", "value", "etime_ms"), alive.select("key", F.concat(F.coalesce("value", F.lit("")), "_tail").alias("value"), "etime_ms"), "key")


def byte_length(value: Column) -> Column:
    return F.coalesce(F.octet_length(value), F.lit(0)).cast("long")


def byte_range(value: Column, start: int, stop: int) -> Column:
    """Bytes from ``start`` to ``stop``, inclusive, negative ones from the end; a stop before the value's beginning means its first byte."""
    raw = value.cast("binary")
    n = F.octet_length(raw)
    first = F.greatest(F.lit(start) + n, F.lit(0)) if start < 0 else F.lit(start)
    last = F.greatest(F.lit(stop) + n, F.lit(0)) if stop < 0 else F.lit(stop)
    last = F.least(last, n - 1)
    return F.when((first > last) | (n == 0), F.lit(b"")).otherwise(F.substring(raw, first + 1, last - first + 1))


def overwrite_bytes(value: Column, offset: int, new: bytes) -> Column:
    """The value with bytes replaced from ``offset``, zero bytes filling any room before it; an empty ``new`` changes nothing."""
    raw = F.coalesce(value.cast("binary"), F.lit(b""))
    if not new:
        return raw
    head = F.substring(F.concat(raw, F.lit(bytes(offset))), F.lit(1), F.lit(offset))
    return F.concat(head, F.lit(new), F.substring(raw, F.lit(offset + len(new) + 1), F.greatest(F.octet_length(raw) - offset - len(new), F.lit(0))))
