"""Queries of the string, key, hash and list operators, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hashes as H
from ..operators import keys as K
from ..operators import lists as L
from ..operators import strings as S
from . import adapters as A
from .adapters import NOW, sql

_LIVE = f"(etime_ms IS NULL OR etime_ms >= {NOW})"
_NEVER = "CAST(NULL AS BIGINT)"


def _c(f):
    return lambda spark, d: f(A.counters(spark, d))


def _k(f):
    return lambda spark, d: f(A.keyspace(spark, d))


def _h(f):
    return lambda spark, d: f(A.hashes(spark, d))


def _l(f):
    return lambda spark, d: f(A.lists(spark, d))


def _texts(f):
    return lambda spark, d: A.strings(spark, d).select("key", f(F.col("value")).alias("r"))


def _wanted(c, m=3):
    """Keys n:0, n:3, ... and one key that isn't there."""
    number = F.substring("key", 3, 20).cast("long")
    return c.where(number % m == 0).select("key").union(c.select(F.lit("n:none").alias("key")).distinct())


def _every(t):
    """Every key, and one that isn't there."""
    return t.select("key").union(t.select(F.lit("none").alias("key")).distinct())


_EVERY_C = "w AS (SELECT key FROM c UNION ALL SELECT 'none')"
_EVERY_K = "a AS (SELECT key FROM ks UNION ALL SELECT 'none')"


def _new(c):
    """Values by key, two for every sixth key."""
    w = _wanted(c)
    twice = w.where(F.substring("key", 3, 20).try_cast("long") % 6 == 0)
    return w.select("key", F.lit("one").alias("value"), F.lit(0).alias("pos")).union(twice.select("key", F.lit("two"), F.lit(1)))


_W = "w AS (SELECT key FROM c WHERE CAST(substr(key, 3) AS BIGINT) % 3 = 0 UNION ALL SELECT 'n:none')"
_N = f"{_W}, new AS (SELECT key, CASE WHEN TRY_CAST(substr(key, 3) AS BIGINT) % 6 = 0 THEN 'two' ELSE 'one' END AS value FROM w)"


def _put(which, keep, only=None, etime=_NEVER, fn=None):
    """Query and SQL of a conditional set: new rows that satisfy ``keep`` (a SQL test on the live old row ``o``) replace old ones."""
    run = fn or _c(lambda c: S.put(c, _new(c), NOW, only))
    text = sql("c", f", {_N}, a AS (SELECT new.key, new.value, {etime} AS etime_ms FROM new LEFT JOIN (SELECT * FROM c WHERE {_LIVE}) o ON o.key = new.key WHERE {keep}) SELECT * FROM a UNION ALL SELECT * FROM c WHERE key NOT IN (SELECT key FROM a)")
    return run, text


def _with_etime(ms):
    return _c(lambda c: S.put(c, _new(c).withColumn("etime_ms", F.lit(ms).cast("long")), NOW))


def _incr(by, sql_by):
    return (
        _c(lambda c: S.incrby(c, _wanted(c).select("key", F.lit(by).cast("long").alias("by")), NOW)),
        sql("c", f", {_W}, a AS (SELECT w.key, CAST(coalesce(CAST(value AS BIGINT), 0) + {sql_by} AS VARCHAR) AS value, etime_ms FROM w LEFT JOIN (SELECT * FROM c WHERE {_LIVE}) o ON o.key = w.key) SELECT * FROM a UNION ALL SELECT * FROM c WHERE key NOT IN (SELECT key FROM a)"),
    )


def _page(asked):
    return asked


def _asked_keys(k, m=4):
    number = F.substring("key", 3, 20).cast("long")
    return k.where(number % m == 0).select("key").union(k.select(F.lit("k:none").alias("key")).distinct())


_AK = "a AS (SELECT key FROM ks WHERE CAST(substr(key, 3) AS BIGINT) % 4 = 0 UNION ALL SELECT 'k:none')"


def _expire(fn, at):
    return _k(fn), sql("ks", f", {_AK} SELECT ks.key, type, CASE WHEN a.key IS NOT NULL AND type <> 'stream' AND {_LIVE} THEN {at} ELSE etime_ms END AS etime_ms FROM ks LEFT JOIN a ON a.key = ks.key WHERE NOT coalesce(a.key IS NOT NULL AND type <> 'stream' AND {_LIVE} AND {at} <= {NOW}, false)")


_FIELDS = "a AS (SELECT key, unnest(['segment','nothing','name']) AS field, unnest([0,1,2]) AS pos FROM (SELECT DISTINCT key FROM h))"


def _fields(h):
    three = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("pos")) for i, f in enumerate(("segment", "nothing", "name"))])
    return h.select("key").distinct().select("key", F.explode(three).alias("f")).select("key", "f.field", "f.pos")


def _hnew(h):
    return h.where("field = 'segment'").select("key", "field", F.lit("x").alias("value"), F.lit(0).alias("pos")).union(h.where("field = 'segment'").select("key", "field", F.lit("y"), F.lit(1))).union(h.where("field = 'name'").select("key", F.lit("extra"), F.lit("z"), F.lit(0)))


_HIDX = 'SELECT *, row_number() OVER (PARTITION BY key ORDER BY field) AS "at" FROM h'
_P = "p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM l)"


def _push(left):
    def run(l):
        new = l.select("key").distinct().union(l.select(F.lit("fresh").alias("key")).distinct())
        two = F.array(F.struct(F.lit(0).alias("pos"), F.lit("a").alias("value")), F.struct(F.lit(1).alias("pos"), F.lit("b").alias("value")))
        return L.push(l, new.select("key", F.explode(two).alias("e")).select("key", "e.pos", "e.value"), left)

    key = "k AS (SELECT key, min(idx) AS lo, max(idx) AS hi FROM l GROUP BY key UNION ALL SELECT 'fresh', 1, -1)"
    a, b = ("lo - 1", "lo - 2") if left else ("hi + 1", "hi + 2")
    return _l(run), sql("l", f", {key} SELECT key, idx, value FROM l UNION ALL SELECT key, {a}, 'a' FROM k UNION ALL SELECT key, {b}, 'b' FROM k")


def _pushx(left):
    def run(l):
        new = l.select("key").distinct().union(l.select(F.lit("fresh").alias("key")).distinct())
        return L.push(l, new.select("key", F.lit(0).alias("pos"), F.lit("a").alias("value")), left, only_present=True)

    return _l(run), sql("l", f"SELECT key, idx, value FROM l UNION ALL SELECT key, {'min(idx) - 1' if left else 'max(idx) + 1'}, 'a' FROM l GROUP BY key")


def _first_key(l):
    return l.select("key").distinct()


def _lrem(count):
    order = "idx" if count >= 0 else "idx DESC"
    test = "value <> 'click'" if count == 0 else f"NOT (value = 'click' AND nth <= {abs(count)})"
    return _l(lambda l: L.lrem(l, "click", count)), sql("l", f"SELECT key, idx, value FROM (SELECT *, row_number() OVER (PARTITION BY key, value ORDER BY {order}) AS nth FROM l) WHERE {test}")


def _linsert(before):
    def run(l):
        asked = _first_key(l).select("key", F.lit("view").alias("pivot"), F.lit("new").alias("new"))
        return L.linsert(l, asked, before)

    return _l(run), sql("l", f"SELECT key, idx * 2 AS idx, value FROM l UNION ALL SELECT key, min(idx) * 2 {'- 1' if before else '+ 1'}, 'new' FROM l WHERE value = 'view' GROUP BY key")


def _rpoplpush(spark, d):
    l = A.lists(spark, d)
    moves = spark.createDataFrame([("1", "2"), ("3", "3")], "src string, dst string")
    return L.rpoplpush(l, moves)


def _blpop(spark, d, left=True):
    asked = spark.createDataFrame([("r1", 0, "none"), ("r1", 1, "3"), ("r1", 2, "1"), ("r2", 0, "2")], "request string, nth int, key string")
    return L.pop_first(A.lists(spark, d), asked, left)


QUERIES = {
    "get": (_c(lambda c: S.get(c, _every(c), NOW)), sql("c", f", {_EVERY_C} SELECT w.key, o.value FROM w LEFT JOIN (SELECT * FROM c WHERE {_LIVE}) o ON o.key = w.key")),
    "mget_positional": (lambda spark, d: S.get(A.strings(spark, d), spark.createDataFrame([(0, "doc:3"), (1, "doc:none"), (2, "doc:1"), (3, "doc:3")], "pos int, key string"), NOW), sql("k", ", a(pos, key) AS (VALUES (0,'doc:3'),(1,'doc:none'),(2,'doc:1'),(3,'doc:3')) SELECT a.pos, a.key, k.value FROM a LEFT JOIN k ON a.key = k.key")),
    "set": _put("set", "true"),
    "set_nx": _put("set_nx", "o.key IS NULL", "absent"),
    "set_xx": _put("set_xx", "o.key IS NOT NULL", "present"),
    "set_vx": (_c(lambda c: S.put(c, _new(c).withColumn("old", F.lit("7")), NOW, "same")), sql("c", f", {_N}, a AS (SELECT new.key, new.value, {_NEVER} AS etime_ms FROM new JOIN c o ON o.key = new.key WHERE {_LIVE} AND o.value = '7') SELECT * FROM a UNION ALL SELECT * FROM c WHERE key NOT IN (SELECT key FROM a)")),
    "setnx": _put("setnx", "o.key IS NULL", "absent"),
    "setex": _put("setex", "true", etime=str(NOW + 5000), fn=_with_etime(NOW + 5000)),
    "psetex": _put("psetex", "true", etime=str(NOW + 1500), fn=_with_etime(NOW + 1500)),
    "pksetexat": _put("pksetexat", "true", etime="1800000000000", fn=_with_etime(1_800_000_000_000)),
    "mset": _put("mset", "true"),
    "msetnx": (
        _c(lambda c: S.put_all_or_none(c, c.select(F.lit("a").alias("call"), F.lit("x:1").alias("key"), F.lit("1").alias("value"), F.lit(0).alias("pos")).distinct().union(c.where("etime_ms is null").select(F.lit("b"), "key", F.lit("2"), F.lit(0))), NOW)),
        sql("c", f"SELECT * FROM c UNION ALL SELECT 'x:1', '1', {_NEVER}"),
    ),
    "getset": (_c(lambda c: S.getset(c, _new(c).withColumnRenamed("pos", "seq"), NOW)[0].select("key", "value", "seq", "old")), sql("c", f", {_W}, ops AS (SELECT key, 'one' AS value, 0 AS seq FROM w UNION ALL SELECT key, 'two', 1 FROM w WHERE TRY_CAST(substr(key, 3) AS BIGINT) % 6 = 0) SELECT ops.key, ops.value, seq, CASE WHEN seq = 1 THEN 'one' ELSE o.value END AS old FROM ops LEFT JOIN (SELECT * FROM c WHERE {_LIVE}) o ON o.key = ops.key")),
    "delvx": (_c(lambda c: S.delete_if_same(c, _wanted(c).withColumn("value", F.lit("7")), NOW)[0]), sql("c", f", {_W} SELECT w.key, '7' AS value, CASE WHEN o.key IS NULL THEN 0 WHEN o.value = '7' THEN 1 ELSE -1 END AS reply FROM w LEFT JOIN (SELECT * FROM c WHERE {_LIVE}) o ON o.key = w.key")),
    "append": (_c(lambda c: S.append(c, _new(c), NOW)), sql("c", f", {_N}, a AS (SELECT new.key, coalesce(o.value, '') || CASE WHEN new.value = 'two' THEN 'onetwo' ELSE 'one' END AS value, o.etime_ms FROM new LEFT JOIN (SELECT * FROM c WHERE {_LIVE}) o ON o.key = new.key) SELECT * FROM a UNION ALL SELECT * FROM c WHERE key NOT IN (SELECT key FROM a)")),
    "getrange": (_texts(lambda v: F.hex(S.byte_range(v, 2, 6))), sql("k", "SELECT key, hex(array_slice(encode(value), 3, 7)) AS r FROM k")),
    "getrange_tail": (_texts(lambda v: F.hex(S.byte_range(v, -5, -2))), sql("k", "SELECT key, hex(array_slice(encode(value), greatest(octet_length(encode(value)) - 4, 1), octet_length(encode(value)) - 1)) AS r FROM k")),
    "setrange": (_texts(lambda v: F.sha2(S.overwrite_bytes(v, 3, b"xyz"), 256)), sql("k", "SELECT key, sha256(array_slice(encode(value), 1, 3) || encode('xyz') || array_slice(encode(value), 7, octet_length(encode(value)))) AS r FROM k")),
    "strlen": (_texts(S.byte_length), sql("k", "SELECT key, CAST(octet_length(encode(value)) AS BIGINT) AS r FROM k")),
    "incr": _incr(1, 1),
    "incrby": _incr(41, 41),
    "decr": _incr(-1, "(-1)"),
    "decrby": _incr(-17, "(-17)"),
    "incrbyfloat": (_c(lambda c: S.incrbyfloat(c, _wanted(c).select("key", F.lit(0.5).alias("by")), NOW)), sql("c", f", {_W}, a AS (SELECT w.key, CAST(coalesce(CAST(value AS BIGINT), 0) AS VARCHAR) || '.5' AS value, etime_ms FROM w LEFT JOIN (SELECT * FROM c WHERE {_LIVE}) o ON o.key = w.key) SELECT * FROM a UNION ALL SELECT * FROM c WHERE key NOT IN (SELECT key FROM a)")),
    "exists_multi": (_k(lambda k: K.exists(k, _every(k), NOW).agg(F.count(F.lit(1)).alias("n"))), sql("ks", f", {_EVERY_K} SELECT count(*) AS n FROM a WHERE key IN (SELECT key FROM ks WHERE {_LIVE})")),
    "del": (_k(lambda k: K.delete(k, _asked_keys(k))), sql("ks", f", {_AK} SELECT * FROM ks WHERE key NOT IN (SELECT key FROM a)")),
    "type": (_k(lambda k: K.types(k, _every(k), NOW)), sql("ks", f", {_EVERY_K} SELECT a.key, coalesce(o.type, 'none') AS type FROM a LEFT JOIN (SELECT * FROM ks WHERE {_LIVE}) o ON o.key = a.key")),
    "keys_glob": (_k(lambda k: K.like(k, "k:1[0-4]?*", NOW, "hash").select("key")), sql("ks", f"SELECT key FROM ks WHERE {_LIVE} AND type = 'hash' AND key GLOB 'k:1[0-4]?*'")),
    "scan_page": (_k(lambda k: K.scan(k, 5, 50, NOW, "k:*").select("key", "type")), sql("ks", f"SELECT key, type FROM ks WHERE {_LIVE} AND key LIKE 'k:%' ORDER BY list_position(['string','hash','set','list','zset','stream'], type), key LIMIT 50 OFFSET 5")),
    "scanx": (_k(lambda k: K.key_range(k, "zset", NOW, start="k:3", limit=20)), sql("ks", f"SELECT key, rn = 21 AS is_next FROM (SELECT key, row_number() OVER (ORDER BY key) AS rn FROM ks WHERE {_LIVE} AND type = 'zset' AND key >= 'k:3') WHERE rn <= 21")),
    "pkscanrange": (_k(lambda k: K.key_range(k, "string", NOW, "k:1", "k:5", 30)), sql("ks", f"SELECT key, rn = 31 AS is_next FROM (SELECT key, row_number() OVER (ORDER BY key) AS rn FROM ks WHERE {_LIVE} AND type = 'string' AND key BETWEEN 'k:1' AND 'k:5') WHERE rn <= 31")),
    "pkrscanrange": (_k(lambda k: K.key_range(k, "set", NOW, "k:7", "k:2", 10, desc=True)), sql("ks", f"SELECT key, rn = 11 AS is_next FROM (SELECT key, row_number() OVER (ORDER BY key DESC) AS rn FROM ks WHERE {_LIVE} AND type = 'set' AND key BETWEEN 'k:2' AND 'k:7') WHERE rn <= 11")),
    "expire": _expire(lambda k: K.expire_in(k, _asked_keys(k).withColumn("ttl", F.lit(60)), NOW), NOW + 60_000),
    "pexpire": _expire(lambda k: K.expire_in(k, _asked_keys(k).withColumn("ttl", F.lit(-5)), NOW, 1), NOW - 5),
    "expireat": _expire(lambda k: K.expire_at(k, _asked_keys(k).withColumn("at_ms", F.lit(1_800_000_000_000)), NOW), 1_800_000_000_000),
    "pexpireat": _expire(lambda k: K.expire_at(k, _asked_keys(k).withColumn("at_ms", F.lit(1_800_000_000_123)), NOW), 1_800_000_000_123),
    "ttl": (_k(lambda k: K.ttl(k, _every(k), NOW)), sql("ks", f", {_EVERY_K} SELECT a.key, CAST(CASE WHEN o.key IS NULL OR NOT {_LIVE} THEN -2 WHEN etime_ms IS NULL THEN -1 ELSE (etime_ms - {NOW}) // 1000 END AS BIGINT) AS ttl FROM a LEFT JOIN (SELECT * FROM ks WHERE type <> 'stream') o ON o.key = a.key")),
    "pttl": (_k(lambda k: K.ttl(k, _every(k), NOW, 1)), sql("ks", f", {_EVERY_K} SELECT a.key, CAST(CASE WHEN o.key IS NULL OR NOT {_LIVE} THEN -2 WHEN etime_ms IS NULL THEN -1 ELSE etime_ms - {NOW} END AS BIGINT) AS ttl FROM a LEFT JOIN (SELECT * FROM ks WHERE type <> 'stream') o ON o.key = a.key")),
    "persist": (_k(lambda k: K.persist(k, _asked_keys(k), NOW)[1]), sql("ks", f", {_AK} SELECT key, type, CASE WHEN {_LIVE} AND key IN (SELECT key FROM a) THEN NULL ELSE etime_ms END AS etime_ms FROM ks")),
    "pkpatternmatchdel": (_k(lambda k: K.delete_like(k, "k:2*", 15, NOW)[1]), sql("ks", f"SELECT * FROM ks WHERE key NOT IN (SELECT key FROM ks WHERE {_LIVE} AND key LIKE 'k:2%' ORDER BY key LIMIT 15)")),
    "live_census": (_k(lambda k: K.census(k, NOW)), sql("ks", f"SELECT type, count(*) FILTER (WHERE {_LIVE}) AS n_keys, count(*) FILTER (WHERE {_LIVE} AND etime_ms IS NOT NULL) AS n_expires, CAST(coalesce(floor(avg(etime_ms - {NOW}) FILTER (WHERE etime_ms >= {NOW})), 0) AS BIGINT) AS avg_ttl_ms, count(*) FILTER (WHERE NOT {_LIVE}) AS n_stale FROM ks GROUP BY type")),
    "compact": (_k(lambda k: K.compact(k, k, NOW)), sql("ks", f"SELECT * FROM ks WHERE {_LIVE}")),
    "hset": (_h(lambda h: H.hset(h, _hnew(h))), sql("h", "SELECT key, field, CASE WHEN field = 'segment' THEN 'y' ELSE value END AS value FROM h UNION ALL SELECT DISTINCT key, 'extra', 'z' FROM h")),
    "hset_replies": (_h(lambda h: H.hset_replies(h, _hnew(h))), sql("h", "SELECT DISTINCT key, 'extra' AS field, 1 AS reply FROM h UNION ALL SELECT DISTINCT key, 'segment', 0 FROM h")),
    "hmset_last_dup": (_h(lambda h: H.hset(h, _hnew(h)).where("field = 'segment'")), sql("h", "SELECT key, field, 'y' AS value FROM h WHERE field = 'segment'")),
    "hget": (_h(lambda h: H.hget(h, _fields(h).where("pos = 0").drop("pos"))), sql("h", "SELECT key, field, value FROM h WHERE field = 'segment'")),
    "hmget": (_h(lambda h: H.hget(h, _fields(h))), sql("h", f", {_FIELDS} SELECT a.key, a.field, a.pos, h.value FROM a LEFT JOIN h ON a.key = h.key AND a.field = h.field")),
    "hgetall": (_h(lambda h: H.hgetall(h).select("key", F.array_join("fields", ",").alias("fields"), F.array_join("values", ",").alias("values"))), sql("h", "SELECT key, string_agg(field, ',' ORDER BY field) AS fields, string_agg(value, ',' ORDER BY field) AS values FROM h GROUP BY key")),
    "hkeys": (_h(lambda h: H.hgetall(h).select("key", F.array_join("fields", "|").alias("r"))), sql("h", "SELECT key, string_agg(field, '|' ORDER BY field) AS r FROM h GROUP BY key")),
    "hvals": (_h(lambda h: H.hgetall(h).select("key", F.array_join("values", "|").alias("r"))), sql("h", "SELECT key, string_agg(value, '|' ORDER BY field) AS r FROM h GROUP BY key")),
    "hlen": (_h(H.hlen), sql("h", "SELECT key, count(*) AS length FROM h GROUP BY key")),
    "hexists": (_h(lambda h: H.hexists(h, _fields(h).drop("pos"))), sql("h", f", {_FIELDS} SELECT a.key, a.field, CAST(h.value IS NOT NULL AS INT) AS present FROM a LEFT JOIN h ON a.key = h.key AND a.field = h.field")),
    "hstrlen": (_h(lambda h: H.hstrlen(h, _fields(h).drop("pos"))), sql("h", f", {_FIELDS} SELECT a.key, a.field, CAST(coalesce(octet_length(encode(h.value)), 0) AS BIGINT) AS length FROM a LEFT JOIN h ON a.key = h.key AND a.field = h.field")),
    "hdel": (_h(lambda h: H.hdel(h, _fields(h))), sql("h", "SELECT * FROM h WHERE field NOT IN ('segment', 'name')")),
    "hsetnx": (_h(lambda h: H.hsetnx(h, _hnew(h))), sql("h", "SELECT * FROM h UNION ALL SELECT DISTINCT key, 'extra', 'z' FROM h")),
    "hincrby": (_h(lambda h: H.hincrby(h, h.where("field = 'nation'").select("key", "field", F.lit(3).cast("long").alias("by"))).where("field = 'nation'")), sql("h", "SELECT key, field, CAST(CAST(value AS BIGINT) + 3 AS VARCHAR) AS value FROM h WHERE field = 'nation'")),
    "hincrbyfloat": (_h(lambda h: H.hincrbyfloat(h, h.where("field = 'nation'").select("key", "field", F.lit(0.25).alias("by"))).where("field = 'nation'")), sql("h", "SELECT key, field, value || '.25' AS value FROM h WHERE field = 'nation'")),
    "hscan_page": (_h(lambda h: H.hscan(h, 1, 2, "*n*").select("key", "at", "field", "value")), sql("h", f"""SELECT key, "at" - 1 AS "at", field, value FROM ({_HIDX}) WHERE "at" BETWEEN 2 AND 3 AND field LIKE '%n%'""")),
    "hscanx": (_h(lambda h: H.field_range(h, start="nation", limit=1).select("key", "at", "field", "value")), sql("h", "SELECT key, CAST(1 AS BIGINT) AS \"at\", field, value FROM h WHERE field = 'nation'")),
    "pkhscanrange": (_h(lambda h: H.field_range(h, "name", "nation", 10).select("key", "at", "field", "value")), sql("h", "SELECT key, row_number() OVER (PARTITION BY key ORDER BY field) AS \"at\", field, value FROM h WHERE field BETWEEN 'name' AND 'nation'")),
    "pkhrscanrange": (_h(lambda h: H.field_range(h, "segment", "nation", 2, "s*", True).select("key", "at", "field", "value")), sql("h", "SELECT key, CAST(1 AS BIGINT) AS \"at\", field, value FROM h WHERE field = 'segment'")),
    "llen": (_l(L.llen), sql("l", "SELECT key, count(*) AS length FROM l GROUP BY key")),
    "lindex": (_l(lambda l: L.lindex(l, _first_key(l).select("key", F.lit(-2).cast("long").alias("i")).union(_first_key(l).select("key", F.lit(100000).cast("long"))))), sql("l", f", {_P} SELECT key, CAST(-2 AS BIGINT) AS i, value FROM p WHERE pos = n - 2 UNION ALL SELECT DISTINCT key, 100000, NULL FROM l")),
    "lrange": (_l(lambda l: L.lrange(l, 2, -4).select("key", "pos", "value")), sql("l", f", {_P} SELECT key, pos, value FROM p WHERE pos BETWEEN 2 AND n - 4")),
    "ltrim": (_l(lambda l: L.ltrim(l, -10, -1)), sql("l", f", {_P} SELECT key, idx, value FROM p WHERE pos >= n - 10")),
    "lset": (_l(lambda l: L.lset(l, _first_key(l).select("key", F.lit(-1).cast("long").alias("i"), F.lit("last").alias("new")))), sql("l", f", {_P} SELECT key, idx, CASE WHEN pos = n - 1 THEN 'last' ELSE value END AS value FROM p")),
    "lpush": _push(True),
    "rpush": _push(False),
    "lpushx": _pushx(True),
    "rpushx": _pushx(False),
    "linsert_before": _linsert(True),
    "linsert_after": _linsert(False),
    "lrem_head": _lrem(2),
    "lrem_tail": _lrem(-3),
    "lrem_all": _lrem(0),
    "lpop_n": (_l(lambda l: L.pop(l, 3, True)[0].select("key", "nth", "value")), sql("l", f", {_P} SELECT key, pos + 1 AS nth, value FROM p WHERE pos < 3")),
    "rpop_n": (_l(lambda l: L.pop(l, 3, False)[0].select("key", "nth", "value")), sql("l", f", {_P} SELECT key, n - pos AS nth, value FROM p WHERE pos >= n - 3")),
    "rpoplpush": (_rpoplpush, sql("l", f", {_P}, m(src, dst) AS (VALUES ('1','2'),('3','3')), t AS (SELECT m.dst, p.value FROM p JOIN m ON p.key = m.src WHERE pos = n - 1), r AS (SELECT key, idx, value FROM p WHERE NOT (pos = n - 1 AND key IN (SELECT src FROM m))) SELECT * FROM r UNION ALL SELECT dst, coalesce((SELECT min(idx) FROM r WHERE r.key = dst), 1) - 1, value FROM t")),
    "brpop_batch": (lambda spark, d: _blpop(spark, d, False), sql("l", "SELECT 'r1' AS request, key, value FROM l WHERE key = '3' AND idx = (SELECT max(idx) FROM l WHERE key = '3') UNION ALL SELECT 'r2', key, value FROM l WHERE key = '2' AND idx = (SELECT max(idx) FROM l WHERE key = '2')")),
    "blpop_batch": (_blpop, sql("l", "SELECT 'r1' AS request, key, value FROM l WHERE key = '3' AND idx = 0 UNION ALL SELECT 'r2', key, value FROM l WHERE key = '2' AND idx = 0")),
}
