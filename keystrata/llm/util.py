"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words, as the inside of a regex class.
BLANK = r"\x20\x09-\x0D"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Higher-order functions run interpreted, so Spark doesn't share what their
    arguments have in common; a lambda's variable is bound once.
    """
    return F.transform(F.array(value), body)[0]


def pieces(text: Column) -> Column:
    """The text split at each single blank: one string between each two blanks."""
    return F.split(text, f"[{BLANK}]")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``. Only where driver and executors are one process, as in tests, may it be unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = spark.conf.get("keystrata.shared.dir", None)
        if not where:
            where = "file://" + tempfile.mkdtemp(prefix="keystrata-")
            spark.conf.set("keystrata.shared.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it goes when the application ends."""
    path = f"{shared_dir(spark)}/keystrata/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


#: Settings that a table is written under: Spark deletes a query's shuffle files as soon as it ends, not when the driver happens to collect its garbage, and Python gets texts in batches of bounded size.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str] = WRITING):
    """``values`` for the queries that run inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(spark: SparkSession, df: DataFrame, name: str, values: dict[str, str] = WRITING) -> DataFrame:
    """``df`` as written to, and read from, a Parquet table in the shared folder: lineage ends there. ``values``: the settings that it is written under."""
    path = new_path(spark, name)
    with settings(spark, values):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._keystrata_path = path
    return out


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by :func:`stored` that no later plan reads."""
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t._keystrata_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of the table that tells rows apart before a shuffle: 1 MB, whatever the corpus.
SEEN_BITS = 1 << 23


def asked(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """``rows`` with ``_asked``: false only where no row of ``keys`` has the same ``on``.

    The hashes of ``keys`` become a bitmap of 256 blocks of 4 KB, which is what
    is broadcast; what it lets through by chance a join must still leave out.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(SEEN_BITS))
    blocks = keys.select(place.alias("p")).groupBy(F.expr("p div 32768").alias("_block")).agg(F.bitmap_construct_agg(F.expr("p % 32768")).alias("_bits"))
    byte = "cast(conv(hex(substring(_bits, cast((_place % 32768) div 8 as int) + 1, 1)), 16, 10) as int)"
    hit = F.expr(f"(shiftright({byte}, cast(_place % 8 as int)) & 1) = 1")
    rows = rows.withColumn("_place", place).withColumn("_block", F.expr("_place div 32768"))
    return rows.join(F.broadcast(blocks), "_block", "left").withColumn("_asked", F.coalesce(hit, F.lit(False))).drop("_block", "_bits", "_place")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
