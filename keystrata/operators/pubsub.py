"""Publish and subscribe: messages (seq, channel, msg) and subscriptions (client, pattern, is_glob)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.glob import matched


def receivers(channels: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(channel, client, pattern): exact names by an equality join, distinct globs with distinct channels that begin alike."""
    names = channels.select("channel").distinct()
    exact = names.join(subscriptions.where("not is_glob"), F.col("channel") == F.col("pattern")).select("channel", "client", "pattern")
    asked = subscriptions.where("is_glob").select("client", "pattern")
    globs = matched(names, "channel", asked, "pattern").join(asked, "pattern").select("channel", "client", "pattern")
    return exact.union(globs)


def delivered(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    return messages.join(receivers(messages, subscriptions), "channel")


def publish(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """``receivers`` of each message: a client that subscribes twice counts twice."""
    n = receivers(messages, subscriptions).groupBy("channel").agg(F.count(F.lit(1)).alias("receivers"))
    return messages.join(n, "channel", "left").withColumn("receivers", F.coalesce("receivers", F.lit(0)))


def subscribe(subscriptions: DataFrame, new: DataFrame) -> DataFrame:
    return subscriptions.unionByName(new).distinct()


def unsubscribe(subscriptions: DataFrame, gone: DataFrame) -> DataFrame:
    """Without (client, pattern, is_glob) of ``gone``; a null pattern takes all of a client's of that kind."""
    out = subscriptions.join(gone.where("pattern is not null"), ["client", "pattern", "is_glob"], "left_anti")
    return out.join(gone.where("pattern is null").select("client", "is_glob").distinct(), ["client", "is_glob"], "left_anti").select(*subscriptions.columns)


def numsub(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.where("not is_glob").groupBy(F.col("pattern").alias("channel")).agg(F.count_distinct("client").alias("clients"))


def numpat(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.where("is_glob").agg(F.count_distinct("pattern").alias("patterns"))
