"""Sets: (key, member)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.glob import matches
from ..functions.places import numbered
from ..model import without


def sadd(s: DataFrame, new: DataFrame) -> DataFrame:
    return s.select("key", "member").union(new.select("key", "member")).distinct()


def srem(s: DataFrame, gone: DataFrame) -> DataFrame:
    return without(s, gone, "key", "member")


def scard(s: DataFrame) -> DataFrame:
    return s.groupBy("key").agg(F.count(F.lit(1)).alias("card"))


def smembers(s: DataFrame, keys: DataFrame) -> DataFrame:
    return s.join(keys.select("key").distinct(), "key", "left_semi")


def sismember(s: DataFrame, asked: DataFrame) -> DataFrame:
    """``is_member`` 0 or 1 for each asked (key, member)."""
    found = s.select("key", "member", F.lit(1).alias("is_member"))
    return asked.join(found, ["key", "member"], "left").withColumn("is_member", F.coalesce("is_member", F.lit(0)))


def sunion(s: DataFrame, inputs: DataFrame) -> DataFrame:
    """The union under each ``dst``; ``inputs``: (dst, key)."""
    return s.join(inputs, "key").select(F.col("dst").alias("key"), "member").distinct()


def sinter(s: DataFrame, inputs: DataFrame) -> DataFrame:
    """Members of every key given for ``dst``; a key without members makes it empty."""
    inputs = inputs.distinct()
    need = inputs.groupBy("dst").agg(F.count(F.lit(1)).alias("need"))
    have = s.join(inputs, "key").groupBy("dst", "member").agg(F.count(F.lit(1)).alias("have"))
    return have.join(need, "dst").where("have = need").select(F.col("dst").alias("key"), "member")


def sdiff(s: DataFrame, inputs: DataFrame) -> DataFrame:
    """Members of ``dst``'s first key and of none of its others; ``inputs``: (dst, key, pos), the first has pos 0."""
    first = s.join(inputs.where("pos = 0"), "key").select(F.col("dst").alias("key"), "member")
    other = s.join(inputs.where("pos > 0"), "key").select(F.col("dst").alias("key"), "member")
    return first.distinct().join(other, ["key", "member"], "left_anti")


def stored_as(s: DataFrame, result: DataFrame, dst: DataFrame) -> DataFrame:
    return without(s, dst, "key").unionByName(result)


def smove(s: DataFrame, moves: DataFrame) -> DataFrame:
    """Members moved from ``src`` to ``dst`` if they are there; ``moves``: (src, dst, member)."""
    found = moves.join(s.withColumnRenamed("key", "src"), ["src", "member"], "left_semi")
    left = without(s, found.select(F.col("src").alias("key"), "member"), "key", "member")
    return sadd(left, found.select(F.col("dst").alias("key"), "member"))


def sscan(s: DataFrame, cursor: int, count: int, pattern: str = "*") -> DataFrame:
    """A page of each key: ``count`` members are visited in byte order from ``cursor``, those that match are returned."""
    at = (F.row_number().over(W.partitionBy("key").orderBy("member")) - 1).cast("long")
    return s.withColumn("at", at).where(F.col("at") < cursor + count).where(F.col("at") >= cursor).where(matches("member", pattern))


def _hash(seed: int) -> Column:
    return F.xxhash64("key", "member", F.lit(seed))


def _some(s: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` members of each key in the order of a seeded hash: Spark limits each key before it shuffles."""
    nth = F.row_number().over(W.partitionBy("key").orderBy(_hash(seed), "member"))
    return s.withColumn("_r", nth).where(F.col("_r") <= n).drop("_r")


def spop(s: DataFrame, n: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(popped, left): ``n`` members of each key in the order of a seeded hash; all, if it has no more."""
    popped = _some(s, n, seed)
    return popped, without(s, popped, "key", "member")


def srandmember(s: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` >= 0: that many distinct members of each key at most. ``n`` < 0: ``-n`` draws with replacement."""
    if n >= 0:
        return _some(s, n, seed)
    draws = scard(s).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(-n))))
    draws = draws.withColumn("_r", F.pmod(F.xxhash64("key", "draw", F.lit(seed)), "card"))
    order = numbered(s.withColumn("_h", _hash(seed)), ["_h", "member"], "_r")
    return draws.join(order, ["key", "_r"]).select("key", "draw", "member")
