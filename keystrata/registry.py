"""What the library offers for each command of a typed key-value server, as a table.

status: ``query`` (an operator with a query of these names), ``operator`` (an
operator without one), ``spark`` (Spark's own means, named), ``outside``
(connections, cluster control and storage engine switches, which have no query
in them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_QUERIES = {
    "SET": "set set_nx set_xx set_vx", "GET": "get", "INCR": "incr", "INCRBY": "incrby", "INCRBYFLOAT": "incrbyfloat", "DECR": "decr", "DECRBY": "decrby", "GETSET": "getset", "APPEND": "append", "MGET": "mget_positional",
    "SETNX": "setnx", "SETEX": "setex", "PSETEX": "psetex", "DELVX": "delvx", "MSET": "mset", "MSETNX": "msetnx", "GETRANGE": "getrange getrange_tail", "SETRANGE": "setrange", "STRLEN": "strlen", "PKSETEXAT": "pksetexat",
    "DEL": "del", "UNLINK": "del", "KEYS": "keys_glob", "EXISTS": "exists_multi", "EXPIRE": "expire", "PEXPIRE": "pexpire", "EXPIREAT": "expireat", "PEXPIREAT": "pexpireat", "TTL": "ttl", "PTTL": "pttl", "PERSIST": "persist",
    "TYPE": "type", "SCAN": "scan_page", "SCANX": "scanx", "PKSCANRANGE": "pkscanrange", "PKRSCANRANGE": "pkrscanrange", "PKPATTERNMATCHDEL": "pkpatternmatchdel",
    "HDEL": "hdel", "HSET": "hset hset_replies", "HGET": "hget", "HGETALL": "hgetall", "HEXISTS": "hexists", "HINCRBY": "hincrby", "HINCRBYFLOAT": "hincrbyfloat", "HKEYS": "hkeys", "HLEN": "hlen", "HMGET": "hmget", "HMSET": "hmset_last_dup",
    "HSETNX": "hsetnx", "HSTRLEN": "hstrlen", "HVALS": "hvals", "HSCAN": "hscan_page", "HSCANX": "hscanx", "PKHSCANRANGE": "pkhscanrange", "PKHRSCANRANGE": "pkhrscanrange",
    "LINDEX": "lindex", "LINSERT": "linsert_before linsert_after", "LLEN": "llen", "BLPOP": "blpop_batch", "BRPOP": "brpop_batch", "LPOP": "lpop_n", "RPOP": "rpop_n", "LPUSH": "lpush", "RPUSH": "rpush", "LPUSHX": "lpushx", "RPUSHX": "rpushx",
    "LRANGE": "lrange", "LREM": "lrem_head lrem_tail lrem_all", "LSET": "lset", "LTRIM": "ltrim", "RPOPLPUSH": "rpoplpush",
    "ZADD": "zadd_first_dup zadd_replies", "ZCARD": "zcard", "ZSCAN": "zscan_page", "ZINCRBY": "zincrby", "ZRANGE": "zrange zrange_neg_index", "ZREVRANGE": "zrevrange zrevrange_top10", "ZRANGEBYSCORE": "zrangebyscore_open", "ZREVRANGEBYSCORE": "zrevrangebyscore_limit",
    "ZCOUNT": "zcount", "ZREM": "zrem", "ZUNIONSTORE": "zunionstore_sum zunionstore_min zunionstore_max zunionstore_replaced", "ZINTERSTORE": "zinterstore_sum zinterstore_min zinterstore_max", "ZRANK": "zrank", "ZREVRANK": "zrevrank", "ZSCORE": "zscore",
    "ZRANGEBYLEX": "zrangebylex", "ZREVRANGEBYLEX": "zrevrangebylex", "ZLEXCOUNT": "zlexcount", "ZREMRANGEBYRANK": "zremrangebyrank", "ZREMRANGEBYSCORE": "zremrangebyscore", "ZREMRANGEBYLEX": "zremrangebylex", "ZPOPMAX": "zpopmax", "ZPOPMIN": "zpopmin_left",
    "SADD": "sadd", "SPOP": "spop_invariants", "SCARD": "scard", "SMEMBERS": "smembers", "SSCAN": "sscan_page", "SREM": "srem", "SUNION": "sunion", "SUNIONSTORE": "sunionstore", "SINTER": "sinter", "SINTERSTORE": "sinterstore", "SISMEMBER": "sismember", "SDIFF": "sdiff",
    "SDIFFSTORE": "sdiffstore", "SMOVE": "smove", "SRANDMEMBER": "srandmember_invariants",
    "SETBIT": "setbit", "GETBIT": "getbit", "BITCOUNT": "bitcount bitcount_range", "BITPOS": "bitpos_0 bitpos_1", "BITOP": "bitop_and bitop_or bitop_xor bitop_not", "PFADD": "pfadd_changed", "PFCOUNT": "pfcount_within_5pct", "PFMERGE": "pfmerge_union_within_5pct",
    "GEOADD": "geoadd_score", "GEOPOS": "geopos", "GEODIST": "geodist_km", "GEOHASH": "geohash10", "GEORADIUS": "georadius_asc georadius_count_desc georadius_store", "GEORADIUSBYMEMBER": "georadiusbymember",
    "PUBLISH": "publish_fanout", "SUBSCRIBE": "subscribe_exact", "UNSUBSCRIBE": "unsubscribe", "PSUBSCRIBE": "psubscribe_glob", "PUNSUBSCRIBE": "unsubscribe", "PUBSUB": "pubsub_numsub pubsub_numpat", "ACL": "acl_dryrun",
    "EXEC": "exec_fold exec_committed", "MULTI": "exec_fold", "DISCARD": "discard", "WATCH": "watch_conflict", "UNWATCH": "watch_conflict",
    "XADD": "xadd_autoid xadd_monotone", "XLEN": "xlen", "XREAD": "xread_multi", "XRANGE": "xrange", "XREVRANGE": "xrevrange_count", "XTRIM": "xtrim_maxlen xtrim_minid", "XDEL": "xdel", "XINFO": "xinfo",
    "COMPACT": "compact", "COMPACTRANGE": "compact", "SELECT": "select_db", "FLUSHDB": "flushdb", "FLUSHALL": "flushall", "INFO": "live_census", "DBSIZE": "live_census", "ECHO": "echo", "PING": "echo", "SLOWLOG": "slowlog_topn", "SCANDB": "scan_page",
    "SLOTSINFO": "slots_census", "SLOTSDEL": "slots_cleanup", "SLOTSHASHKEY": "slots_hashkey", "SLOTSSCAN": "slots_scan", "SLOTSRELOAD": "slots_census", "SLOTSCLEANUP": "slots_cleanup", "COMMAND": "command_registry",
}
_SPARK = {
    "BGSAVE": "sources.snapshots.save", "LASTSAVE": "file times of a snapshot", "DELBACKUP": "deleting a snapshot's folder", "CONFIG": "spark.conf; operators.admin.settings", "MONITOR": "streaming.logs.tail", "TIME": "current_timestamp", "SHUTDOWN": "spark.stop",
    "CACHE": "DataFrame.cache and unpersist", "CLEARCACHE": "spark.catalog.clearCache", "PURGELOGSTO": "a filter on the log's file number", "SLAVEOF": "streaming.logs.keep", "DBSLAVEOF": "streaming.logs.keep on one db",
    "SLOTSMGRTTAGSLOT-ASYNC": "operators.admin.slot_members and a write", "SLOTSMGRTTAGONE": "operators.admin.slot_members and a write", "SLOTSMGRTONE": "operators.admin.slot_members and a write", "SLOTSMGRTTAGSLOT": "operators.admin.slot_members and a write",
    "SLOTSMGRTSLOT": "operators.admin.slot_members and a write", "SLOTSMGRT-ASYNC-STATUS": "StreamingQuery.lastProgress", "SLOTSMGRT-ASYNC-CANCEL": "StreamingQuery.stop",
}
_OUTSIDE = "AUTH HELLO CLIENT QUIT PADDING DISKRECOVERY CLEARREPLICATIONID DISABLEWAL SLOTSMGRT-EXEC-WRAPPER SLOTSRELOADOFF SLOTSCLEANUPOFF".split()


def rows() -> list[tuple[str, str, str]]:
    return [(c, "query", q) for c, q in _QUERIES.items()] + [(c, "spark", m) for c, m in _SPARK.items()] + [(c, "outside", "") for c in _OUTSIDE]


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "command string, status string, by string")
