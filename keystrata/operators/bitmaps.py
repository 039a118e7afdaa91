"""Bitmaps as relations of set bits: (key, off); bit 0 is the first byte's highest. A key's length in bytes is that of its last set bit unless given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import bounds


def setbit(b: DataFrame, new: DataFrame) -> DataFrame:
    """Bits set or cleared; ``new``: (key, off, bit, pos), the last of a place counts."""
    last = new.groupBy("key", "off").agg(F.max_by("bit", "pos").alias("bit"))
    return b.select("key", "off").join(last, ["key", "off"], "left_anti").union(last.where("bit = 1").select("key", "off"))


def getbit(b: DataFrame, asked: DataFrame) -> DataFrame:
    """``bit`` at each asked (key, off); 0 beyond the end."""
    return asked.join(b.select("key", "off", F.lit(1).alias("bit")), ["key", "off"], "left").withColumn("bit", F.coalesce("bit", F.lit(0)))


def lengths(b: DataFrame) -> DataFrame:
    return b.groupBy("key").agg((F.floor(F.max("off") / 8) + 1).cast("long").alias("n_bytes"))


def bitcount(b: DataFrame, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Set bits of each key, in bytes ``start`` to ``stop`` if given, negative ones from the end; a stop before the beginning means byte 0."""
    if start is None:
        return b.groupBy("key").agg(F.count(F.lit(1)).alias("bits"))
    n = F.col("n_bytes")
    first = F.greatest(n + start, F.lit(0)) if start < 0 else F.lit(start)
    last = F.least(F.greatest(n + stop, F.lit(0)) if stop < 0 else F.lit(stop), n - 1)
    return b.join(lengths(b), "key").groupBy("key").agg(F.count_if(F.floor(F.col("off") / 8).between(first, last)).alias("bits"))


def bitpos(b: DataFrame, bit: int, start: int = 0, stop: int = -1) -> DataFrame:
    """The first place with this bit in bytes ``start`` to ``stop``, -1 if there is none. A clear bit is found at the first gap of the set ones."""
    sized = lengths(b)
    first, last = bounds(F.lit(start).cast("long"), F.lit(stop).cast("long"), F.col("n_bytes"))
    inside = b.join(sized.withColumn("lo", first * 8).withColumn("hi", last * 8 + 7), "key").where("off between lo and hi")
    if bit:
        found = inside.groupBy("key").agg(F.min("off").alias("pos"))
    else:
        nth = F.row_number().over(W.partitionBy("key").orderBy("off")) - 1
        gap = inside.withColumn("gap", F.col("off") - F.col("lo") - nth).groupBy("key").agg(F.max(F.when(F.col("gap") == 0, F.col("off"))).alias("run"))
        ends = sized.withColumn("lo", first * 8).withColumn("hi", last * 8 + 7).where("lo <= hi")
        at = F.coalesce(F.col("run") + 1, F.col("lo"))
        found = ends.join(gap, "key", "left").select("key", F.when(at <= F.col("hi"), at).otherwise(-1).alias("pos"))
    return sized.select("key").join(found, "key", "left").select("key", F.coalesce("pos", F.lit(-1)).cast("long").alias("pos"))


def bitop(b: DataFrame, inputs: DataFrame, op: str) -> DataFrame:
    """AND, OR, XOR of the keys given for each ``dst``, or NOT of its only one, over its whole bytes; ``inputs``: (dst, key)."""
    if op == "not":
        every = lengths(b).join(inputs, "key").select(F.col("dst"), "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") * 8 - 1)).alias("off"))
        return every.join(b, ["key", "off"], "left_anti").select(F.col("dst").alias("key"), "off")
    need = inputs.groupBy("dst").agg(F.count(F.lit(1)).alias("need"))
    have = b.join(inputs, "key").groupBy("dst", "off").agg(F.count(F.lit(1)).alias("have"))
    test = {"and": "have = need", "or": "true", "xor": "have % 2 = 1"}[op]
    return have.join(need, "dst").where(test).select(F.col("dst").alias("key"), "off")
