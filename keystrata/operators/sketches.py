"""Approximate distinct counts: (key, sketch)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base-2 logarithm of a sketch's registers.
PRECISION = 17


def pfadd(t: DataFrame | None, new: DataFrame) -> DataFrame:
    """Sketches with elements of ``new`` (key, elem) added."""
    made = new.groupBy("key").agg(F.hll_sketch_agg("elem", F.lit(PRECISION)).alias("sketch"))
    return made if t is None else t.select("key", "sketch").union(made).groupBy("key").agg(F.hll_union_agg("sketch").alias("sketch"))


def pfadd_replies(t: DataFrame, new: DataFrame) -> DataFrame:
    """1 where the estimate changes, else 0."""
    # A sketch that was filled in one go is estimated by its history, a union by its registers: both sides are unions.
    old = t.select("key", F.hll_union("sketch", "sketch").alias("old"))
    same = F.hll_sketch_estimate(F.hll_union("old", "sketch")) == F.hll_sketch_estimate("old")
    return pfadd(None, new).join(old, "key", "left").select("key", (~F.coalesce(same, F.lit(False))).cast("int").alias("reply"))


def pfmerge(t: DataFrame, inputs: DataFrame) -> DataFrame:
    """The union of each ``dst``'s keys and of itself; ``inputs``: (dst, key)."""
    every = inputs.union(inputs.select("dst", F.col("dst").alias("key")).distinct()).distinct()
    return t.join(every, "key").groupBy(F.col("dst").alias("key")).agg(F.hll_union_agg("sketch").alias("sketch"))


def pfcount(t: DataFrame) -> DataFrame:
    return t.select("key", F.hll_sketch_estimate("sketch").alias("estimate"))
