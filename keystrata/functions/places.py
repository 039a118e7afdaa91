"""Places in an order and running counts, without all of a key's rows meeting in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of one range, and the most ranges that rows are cut into: what is cut is a sample of this many rows for each range.
PIECE, RANGES, SAMPLE = 1_000_000, 1024, 20


def _range(t: DataFrame, order: list[str]) -> Column:
    """How many of some rows of ``t`` come before a row: its range. The rows that cut are a sample by hash, bounded by RANGES * SAMPLE."""
    n = t.count()
    ranges = min(RANGES, -(-n // PIECE))
    if ranges < 2:
        return F.lit(0)
    types = dict(t.dtypes)
    some = t.select(*order).where(F.pmod(F.xxhash64(*order), F.lit(n)) < ranges * SAMPLE).orderBy(*order).limit(ranges * SAMPLE * 2).collect()
    cuts = some[SAMPLE // 2 :: SAMPLE]
    if not cuts:
        return F.lit(0)
    array = F.array(*(F.struct(*(F.lit(r[c]).cast(types[c]).alias(c) for c in order)) for r in cuts))
    steps, step = [], 1
    while step <= len(cuts):
        steps.insert(0, step)
        step *= 2
    here = F.struct(*(F.col(c) for c in order))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when((at + s <= len(cuts)) & (F.get(array, at + s - 1) <= here), at + s).otherwise(at))


def numbered(t: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """``name``: each row's place in its ``key`` by ascending ``order``, from 0; ``length``: the key's rows.

    Rows are cut into ranges of (key, order); a task counts inside one range of
    a key, and what lies before it is a sum over ranges.
    """
    cut = t.withColumn("_range", _range(t, ["key", *order]))
    counts = cut.groupBy("key", "_range").agg(F.count(F.lit(1)).alias("_n"))
    of_key = W.partitionBy("key")
    before = F.coalesce(F.sum("_n").over(of_key.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("key", "_range", before.alias("_before"), F.sum("_n").over(of_key).alias("length"))
    inside = F.row_number().over(W.partitionBy("key", "_range").orderBy(*order)) - 1
    return cut.withColumn("_inside", inside).join(starts, ["key", "_range"]).select(*t.columns, (F.col("_before") + F.col("_inside")).cast("long").alias(name), "length")
