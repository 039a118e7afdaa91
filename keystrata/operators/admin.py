"""Reports and housekeeping that are queries: big keys, slow log, settings, users' rights, slots, and the operator list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.glob import matched, matches

#: Slots that keys are dealt to unless told otherwise.
SLOTS = 1024


def slot(key: Column, slots: int = SLOTS) -> Column:
    """crc32 of the text between the first ``{`` and the next ``}``, or else of the key, by slots."""
    tag = r"(?s)^[^{]*\{([^}]*)\}"
    return (F.crc32(F.when(key.rlike(tag), F.regexp_extract(key, tag, 1)).otherwise(key).cast("binary")) % slots).cast("int")


def slot_census(keys: DataFrame, slots: int = SLOTS) -> DataFrame:
    return keys.groupBy(slot(F.col("key"), slots).alias("slot")).agg(F.count(F.lit(1)).alias("n_keys"))


def slot_members(keys: DataFrame, wanted: list[int], slots: int = SLOTS) -> DataFrame:
    return keys.where(slot(F.col("key"), slots).isin(wanted))


def slot_cleaned(keys: DataFrame, gone: list[int], slots: int = SLOTS) -> DataFrame:
    return keys.where(~slot(F.col("key"), slots).isin(gone))


def rebalanced(census: DataFrame, groups: int) -> DataFrame:
    """(slot, group): slots in order, dealt evenly; the window sees one row per slot."""
    from pyspark.sql import Window as W

    return census.select("slot", F.ntile(groups).over(W.orderBy("slot")).alias("group"))


def selected(keys: DataFrame, db: int) -> DataFrame:
    """The keys of one database of a key space with a column ``db``."""
    return keys.where(F.col("db") == db).drop("db")


def flushed(keys: DataFrame, db: int | None = None) -> DataFrame:
    """The key space without one database's keys, or, for None, without any."""
    return keys.limit(0) if db is None else keys.where(F.col("db") != db)


def bigkeys(members: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest keys of (key, bytes) rows."""
    return members.groupBy("key").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("members")).orderBy(F.desc("bytes"), "key").limit(n)


def slowlog(log: DataFrame, n: int, least_us: int) -> DataFrame:
    """The newest ``n`` entries (id, duration_us, ...) that took ``least_us`` or longer."""
    return log.where(F.col("duration_us") >= least_us).orderBy(F.desc("id")).limit(n)


def settings(spark: SparkSession, table: DataFrame, pattern: str) -> DataFrame:
    """Rows (name, value) whose name matches a glob."""
    return table.where(matches("name", pattern))


def allowed(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """``allowed`` of each request (request, user, command, category, key).

    ``rules``: (user, pos, allow, what, key_pattern): ``what`` is ``+command``,
    ``@category`` or ``*``; the last rule that fits a user's command decides
    it, and one of the user's key patterns must match the key.
    """
    fits = (F.col("what") == "*") | (F.col("what") == F.concat(F.lit("+"), F.col("command"))) | (F.col("what") == F.concat(F.lit("@"), F.col("category")))
    command = requests.join(rules.where("what is not null"), "user").where(fits).groupBy("request").agg(F.max_by("allow", "pos").alias("may"))
    key = requests.join(matched(requests, "key", rules.where("key_pattern is not null"), "key_pattern", "user").select("key", "user").distinct(), ["key", "user"]).select("request").distinct().withColumn("reaches", F.lit(True))
    out = requests.join(command, "request", "left").join(key, "request", "left")
    return out.select(*requests.columns, (F.coalesce("may", F.lit(False)) & F.coalesce("reaches", F.lit(False))).alias("allowed"))
