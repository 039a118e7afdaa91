"""Connected components of links, by joins and minima alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import dropped, stored


def components(spark: SparkSession, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each linked node and the smallest node that it reaches.

    Alternates large and small stars: every node hands its larger, then its
    smaller neighbours to its smallest one, until nothing changes; the rounds
    grow with the logarithm of the number of nodes. Null ends are ignored.
    """
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = stored(spark, ends, "components")
    total = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = total(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(spark, large, "components")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = stored(spark, small.where("u <> v").distinct(), "components")
        after = total(small)
        dropped(spark, edges, large)
        edges = small
        if after == before:
            break
        before = after
    member = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return member.union(edges.select(F.col("v"), F.col("v")).distinct())
