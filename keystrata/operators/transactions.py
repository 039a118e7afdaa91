"""Ordered folds of an operation log, transactions and optimistic locks.

Log rows: (seq, txn, op, key, arg). A batch is atomic as a whole; a key's value
after each operation comes from windows over its own operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def folded(log: DataFrame) -> DataFrame:
    """``value`` of the key after each operation: SET n, INCRBY n, DEL (null after it)."""
    order = W.partitionBy("key").orderBy("seq")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    starts = F.sum(F.col("op").isin("SET", "DEL").cast("int")).over(upto)
    part = log.withColumn("_part", starts)
    inside = W.partitionBy("key", "_part").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    total = F.sum(F.when(F.col("op") != "DEL", F.col("arg"))).over(inside)
    return part.withColumn("value", total).drop("_part")


def state(log: DataFrame) -> DataFrame:
    """(key, value) after the whole log, deleted keys left out: maxima alone, so no key's operations are gathered."""
    last = log.where(F.col("op").isin("SET", "DEL")).groupBy("key").agg(F.max("seq").alias("_from"), F.max_by("op", "seq").alias("_op"))
    told = log.join(last, "key", "left").where("_from is null or seq >= _from")
    out = told.groupBy("key").agg(F.sum(F.when(F.col("op") != "DEL", F.col("arg"))).alias("value"))
    return out.where("value is not null")


#: Sequence numbers of one range, whose writes to a key one task counts.
RANGE = 1 << 16


def conflicts(watches: DataFrame, writes: DataFrame) -> DataFrame:
    """Transactions to be refused: a watched key was written by another between watch and exec.

    ``watches``: (txn, key, watch_seq, exec_seq); ``writes``: (seq, txn, key).
    All writes to the key in between are counted by running sums over ranges of
    the log, and the transaction's own ones taken off, so no watch meets the
    writes of its key one by one.
    """
    ids = ["txn", "key", "watch_seq", "exec_seq"]
    w = watches.select(*ids).where("exec_seq > watch_seq").distinct()
    # At one place of the log: ends come before writes, and starts behind them.
    nothing = [F.lit(None).cast(t).alias(c) for c, t in w.dtypes if c != "key"]
    marks = writes.select("key", "seq", F.lit(1).alias("o"), F.lit(1).alias("n"), *nothing)
    for at, o in (("exec_seq", 0), ("watch_seq", 2)):
        marks = marks.unionByName(w.select("key", F.col(at).alias("seq"), F.lit(o).alias("o"), F.lit(0).alias("n"), "txn", "watch_seq", "exec_seq"))
    marks = marks.withColumn("part", F.floor(F.col("seq") / RANGE))
    parts = marks.groupBy("key", "part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("n").over(W.partitionBy("key", "part").orderBy("seq", "o").rangeBetween(W.unboundedPreceding, W.currentRow))
    upto = marks.withColumn("upto", inside).where("n = 0").join(parts.select("key", "part", before.alias("before")), ["key", "part"])
    sign = F.when(F.col("o") == 0, 1).otherwise(-1)
    every = upto.groupBy(*ids).agg(F.sum(sign * (F.col("before") + F.col("upto"))).alias("every"))
    own = w.join(writes.select("txn", "key", "seq"), ["txn", "key"]).where("seq > watch_seq and seq < exec_seq").groupBy(*ids).agg(F.count(F.lit(1)).alias("own"))
    return every.join(own, ids, "left").where(F.col("every") > F.coalesce("own", F.lit(0))).select("txn").distinct()


def committed(log: DataFrame, refused: DataFrame, discarded: DataFrame) -> DataFrame:
    """The log without refused and discarded transactions; rows outside transactions (null txn) stay."""
    return log.join(refused.union(discarded.select("txn")), "txn", "left_anti").select(*log.columns)
