"""The data model: typed keys as tables, expiry, and byte order.

Tables (all may hold any number of keys; every operator answers for many keys
in one plan):

=========  =====================================================
keyspace   key, type, etime_ms (null: never expires)
strings    key, value, etime_ms
hashes     key, field, value
sets       key, member
lists      key, idx, value
zsets      key, member, score
bits       key, off (set bits only)
geo        key, member, score (a 52-bit cell number)
streams    key, ms, seq, and any columns of fields
=========  =====================================================

Strings compare by UTF-8 bytes, Spark's default. ``now`` is always an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order in which a key scan visits types.
TYPE_ORDER = ("string", "hash", "set", "list", "zset", "stream")


def is_live(now: int | Column, etime: str | Column = "etime_ms") -> Column:
    """True unless the expiry lies before ``now``; a null expiry never does."""
    etime = F.col(etime) if isinstance(etime, str) else etime
    return etime.isNull() | (etime >= now)


def live(df: DataFrame, now: int) -> DataFrame:
    return df.where(is_live(now))


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with equal keys; columns that ``new`` lacks are null."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def without(old: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def bounds(start: Column, stop: Column, n: Column) -> tuple[Column, Column]:
    """Inclusive positions 0..n-1 of a slice whose ends may count from the end; empty if first > last."""
    first = F.greatest(F.when(start < 0, start + n).otherwise(start), F.lit(0))
    last = F.least(F.when(stop < 0, stop + n).otherwise(stop), n - 1)
    return first, last


def long_of(text: Column) -> Column:
    """A 64-bit integer of decimal text; an error for other text."""
    value = text.try_cast("bigint")
    return F.when(text.isNull(), F.lit(0).cast("bigint")).when(value.isNotNull() & text.rlike(r"^-?\d+$"), value).otherwise(F.raise_error(F.concat(F.lit("value is not an integer: "), text)).cast("bigint"))


def number_text(value: Column) -> Column:
    """A double as text without trailing zeros."""
    fixed = F.format_string("%.17f", value)
    return F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", "")
