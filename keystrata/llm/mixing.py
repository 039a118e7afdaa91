"""Mixing sources to target weights with a low-discrepancy schedule (DataFrame functions only).

Slot ``k`` of the mix takes the golden-ratio point ``frac(k / phi)`` and maps it
through the sources' cumulative shares. The slots of a source are ranked, and
rank ``r`` takes block ``r mod blocks`` of the source, whose documents are laid
out in a shuffled order and cut into blocks of equally many words. Prefix sums
(of words in a source, of slots in a source) go by bucket totals first, so that
no task ever holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .util import pieces, stored

#: Inverse golden ratio, and the fraction of 2^20 times it: frac(k / phi) keeps its precision for large k in two parts.
PHI = 0.6180339887498949
PHI_20 = (2**20 * PHI) % 1.0
#: Cells by which points find their source's interval with an equality join.
CELLS = 4096
#: Slots of one bucket, whose ranks one task counts.
RUN = 2**15


def n_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, 0 for null."""
    return F.coalesce(F.size(F.filter(pieces(text), lambda w: w != "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Words that each source gives to the mix.

    ``sizes``: (source, source_size), a row per source. Sources by code point,
    null last, weigh ``weights`` in turn and share the words of all sources; a
    share above ``most`` times the source's size is cut to that and the excess
    goes to the others by weight, until none is above. The level ``words per
    weight`` is found in one pass over the sources in order of the level at
    which each is cut. Returns (source, source_size, weight, target, lo, hi):
    lo to hi is the source's part of [0, 1). The windows see one row per source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    by_level = W.orderBy(F.col("cut"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    one = W.partitionBy(F.lit(1))
    out = (
        sizes.withColumn("weight", w)
        .withColumn("cut", cap / F.col("weight"))
        .withColumn("all_words", F.sum("source_size").over(one).cast("double"))
        .withColumn("w_left", F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("given", F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        .withColumn("level", (F.col("all_words") - F.col("given")) / F.col("w_left"))
        .withColumn("level", F.max(F.when(F.col("cut") >= F.col("level"), F.col("level"))).over(one))
        .withColumn("target", F.least(cap, F.coalesce(F.col("level") * F.col("weight"), cap)))
    )
    total = F.sum("target").over(one)
    upto = F.sum("target").over(by_name.rowsBetween(W.unboundedPreceding, 0))
    return out.select(
        "source", "source_size", "weight", "target", F.when(total > 0, (upto - F.col("target")) / total).otherwise(0.0).alias("lo"), F.when(total > 0, upto / total).otherwise(0.0).alias("hi")
    )


def mix(spark: SparkSession, docs: DataFrame, blocks_per_doc: int = 16, most: int = 3) -> DataFrame:
    """(row_id, doc_id, h, source, size, source_size, target, taken) of every row of ``docs``; h: the text's xxhash64.

    ``blocks_per_doc``: a block has the mean document's words divided by this
    (1 at least), which bounds how far a source's words can be from its target:
    by the few blocks of the points' discrepancy. A source gives at most
    ``most`` rounds of its blocks, so no document exceeds ``most`` times its
    size. Order in a source: md5 of the id, then id, size. Null text counts no
    words; a null source is a source of its own; rows that are repeated are
    documents of their own; an empty table gives no rows.
    """
    sized = docs.select("doc_id", F.xxhash64("text").alias("h"), "source", n_words(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_h"))
    sized = stored(spark, sized.withColumn("_b", F.substring("_h", 1, 3)), "mix-sizes")
    name = F.struct(F.col("source").isNull().alias("n"), F.coalesce(F.col("source"), F.lit("")).alias("s"))
    sized = sized.withColumn("_s", name)
    per_bucket = stored(spark, sized.groupBy("source", "_s", "_b").agg(F.sum("size").alias("b_size"), F.count(F.lit(1)).alias("n")), "mix-buckets")
    plan = stored(spark, targets(per_bucket.groupBy("source").agg(F.sum("b_size").alias("source_size")), most).withColumn("_s", name), "mix-targets")
    words, n = per_bucket.agg(F.sum("b_size"), F.sum("n")).first()
    block = max(1, (words or 0) // max(1, blocks_per_doc * (n or 1)))
    slots = (words or 0) // block
    taken = _visits(spark, plan, slots, block, most)

    # Where each document begins among its source's words.
    upto = W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    begins = per_bucket.select("_s", "_b", F.coalesce(F.sum("b_size").over(upto), F.lit(0)).alias("b_from"))
    inside = W.partitionBy("_s", "_b").orderBy("_h", F.col("doc_id").asc_nulls_last(), "size")
    placed = (
        sized.withColumn("upto", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("row_id", F.row_number().over(inside))
        .join(begins, ["_s", "_b"])
        .withColumn("row_id", F.concat_ws(":", "_b", F.col("row_id").cast("string")))
        .withColumn("a", F.col("b_from") + F.col("upto") - F.col("size"))
    )
    placed = stored(spark, placed.select("row_id", "doc_id", "h", "source", "_s", "size", "a"), "mix-places")
    first, last = F.expr(f"a div {block}"), F.expr(f"(a + size - 1) div {block}")
    parts = (
        placed.where("size > 0")
        .select("row_id", "_s", "a", "size", F.explode(F.sequence(first, last)).alias("blk"))
        .withColumn("words", F.least(F.col("a") + F.col("size"), (F.col("blk") + 1) * block) - F.greatest(F.col("a"), F.col("blk") * block))
        .join(taken, ["_s", "blk"])
        .groupBy("_s", "row_id")
        .agg(F.sum(F.col("words") * F.col("visits")).alias("taken"))
    )
    return (
        placed.join(parts, ["_s", "row_id"], "left")
        .join(plan.select("_s", "source_size", "target"), "_s")
        .select("row_id", "doc_id", "h", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def mixed(spark: SparkSession, docs: DataFrame, blocks_per_doc: int = 16, most: int = 3) -> DataFrame:
    """``docs`` as the mix has them: whole rows, as often as their words are taken; rows not taken go.

    What is taken of a row beyond whole copies is one more copy as often as its
    part of the row, by a hash of the row: so sources meet their targets in
    whole documents up to chance, and reruns agree. Rows that repeat id and text are each given as often as the most taken of
    them. Columns stay as they are.
    """
    chance = F.pmod(F.xxhash64("doc_id", "h", F.lit("copies")), F.lit(1 << 30)) / (1 << 30)
    whole = F.floor(F.col("taken") / F.col("size") + chance).cast("int")
    copies = mix(spark, docs, blocks_per_doc, most).where("taken > 0").groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.max(whole).alias("_copies"))
    copies = stored(spark, copies.where("_copies > 0"), "mix-copies")
    # Columns go under numbers meanwhile, so that none of their names can clash.
    at = docs.columns.index
    inner = [f"c{i}" for i in range(len(docs.columns))]
    keyed = docs.toDF(*inner).withColumn("_t", F.xxhash64(f"c{at('text')}"))
    out = keyed.join(copies, F.col(f"c{at('doc_id')}").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_h")))
    return out.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*inner).toDF(*docs.columns)


def _visits(spark: SparkSession, plan: DataFrame, slots: int, block: int, most: int) -> DataFrame:
    """(_s, blk, visits): how often the schedule takes each block of each source."""
    point = F.expr(f"(k div {2**20}) * {PHI_20!r}D + (k % {2**20}) * {PHI!r}D")
    points = spark.range(slots).withColumnRenamed("id", "k").withColumn("u", point - F.floor(point)).withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    cells = F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)).cast("int"))
    spans = plan.where("hi > lo").select("_s", "lo", "hi", F.explode(cells).alias("cell"))
    hit = points.join(spans, "cell").where("u >= lo and u < hi").select("_s", "k", F.expr(f"k div {RUN}").alias("run"))
    runs = hit.groupBy("_s", "run").agg(F.count(F.lit(1)).alias("n"))
    starts = stored(spark, runs.select("_s", "run", F.coalesce(F.sum("n").over(W.partitionBy("_s").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("from")), "mix-runs")
    rank = F.row_number().over(W.partitionBy("_s", "run").orderBy("k")) - 1
    blocks = F.expr(f"(source_size + {block - 1}) div {block}")
    return (
        hit.withColumn("r", rank)
        .join(starts, ["_s", "run"])
        .join(plan.select("_s", blocks.alias("blocks")), "_s")
        .withColumn("r", F.col("from") + F.col("r"))
        .where(F.col("r") < F.col("blocks") * most)
        .groupBy("_s", F.expr("r % blocks").alias("blk"))
        .agg(F.count(F.lit(1)).alias("visits"))
    )
