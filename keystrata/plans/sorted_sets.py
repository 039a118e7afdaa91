"""Queries of the sorted-set and set operators, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sets as S
from ..operators import zsets as Z
from . import adapters as A
from .adapters import sql

_RANK = "SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS r, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rr, count(*) OVER (PARTITION BY key) AS n FROM z"


def _keys(spark, z, **more):
    return z.select("key").distinct().select("key", *(F.lit(v).cast("long").alias(k) for k, v in more.items()))


def _inputs(spark, rows, schema="dst string, key string, weight double"):
    return spark.createDataFrame(rows, schema)


def _asked(z):
    """Every seventh member by number, and one that no key has."""
    return z.select("key", "member").where(F.col("member").cast("long") % 7 == 3).union(z.select("key", F.lit("nobody").alias("member")).distinct())


def _every(z):
    """Every member, and one that no key has."""
    return z.select("key", "member").union(z.select("key", F.lit("nobody").alias("member")).distinct())


_EVERY = "asked AS (SELECT key, member FROM z UNION ALL SELECT DISTINCT key, 'nobody' FROM z)"
_ASKED = "asked AS (SELECT key, member FROM z WHERE CAST(member AS BIGINT) % 7 = 3 UNION ALL SELECT DISTINCT key, 'nobody' FROM z)"


def _new(z):
    return z.select("key", "member", (F.col("score") + 1).alias("score"), F.lit(1).alias("pos")).where(F.col("member").cast("long") % 3 == 0).union(z.select("key", "member", F.lit(5.0), F.lit(0)).where(F.col("member").cast("long") % 6 == 0)).union(z.select("key", F.lit("fresh"), F.lit(7.0), F.lit(0)).distinct())


_NEW = "new AS (SELECT key, member, CASE WHEN CAST(member AS BIGINT) % 6 = 0 THEN 5.0 ELSE score + 1 END AS score FROM z WHERE CAST(member AS BIGINT) % 3 = 0 UNION ALL SELECT DISTINCT key, 'fresh', 7.0 FROM z)"
_FOLD_IN = [("out1", "view", 2.0), ("out1", "click", 1.0), ("out2", "purchase", 1.0), ("out2", "signup", -1.0)]
_FOLD_SQL = "i(dst, key, weight) AS (VALUES ('out1','view',2.0::DOUBLE),('out1','click',1.0::DOUBLE),('out2','purchase',1.0::DOUBLE),('out2','signup',-1.0::DOUBLE))"
_SET_IN = [("a", "1995-01", 0), ("a", "1995-02", 1), ("a", "1995-03", 2), ("b", "1996-05", 0), ("b", "1997-05", 1), ("c", "1996-05", 0), ("c", "none", 1)]
_SET_SQL = "i(dst, key, pos) AS (VALUES ('a','1995-01',0),('a','1995-02',1),('a','1995-03',2),('b','1996-05',0),('b','1997-05',1),('c','1996-05',0),('c','none',1))"
_SET_SCHEMA = "dst string, key string, pos int"


def _z(f):
    return lambda spark, d: f(A.zsets(spark, d))


def _s(f):
    return lambda spark, d: f(A.sets(spark, d))


def _fold(kind, fold):
    def run(spark, d):
        return (Z.zunionstore if kind == "union" else Z.zinterstore)(A.zsets(spark, d), _inputs(spark, _FOLD_IN), fold)

    having = "" if kind == "union" else " HAVING count(*) = 2"
    return run, sql("z", f", {_FOLD_SQL} SELECT dst AS key, member, {fold}(score * weight) + 0.0 AS score FROM z JOIN i USING (key) GROUP BY 1, 2{having}")


def _shown(desc):
    return lambda spark, d: Z.zrange(A.zsets(spark, d), _keys(spark, A.zsets(spark, d), start=-5, stop=-2), desc)


QUERIES = {
    "zrevrange_top10": (_z(lambda z: Z.top(z, 10)), sql("z", f"SELECT key, member, score, rr AS rank FROM ({_RANK}) WHERE rr < 10")),
    "zadd_first_dup": (_z(lambda z: Z.zadd(z, _new(z))), sql("z", f", {_NEW} SELECT * FROM new UNION ALL SELECT * FROM z WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.key = z.key AND n.member = z.member)")),
    "zadd_replies": (_z(lambda z: Z.zadd_count(z, _new(z))), sql("z", f", {_NEW} SELECT key, count(*) FILTER (WHERE member = 'fresh') AS added FROM new GROUP BY key")),
    "zincrby": (_z(lambda z: Z.zincrby(z, _asked(z).withColumn("by", F.lit(1.5)))), sql("z", f", {_ASKED} SELECT coalesce(z.key, a.key) AS key, coalesce(z.member, a.member) AS member, coalesce(score, 0) + CASE WHEN a.key IS NULL THEN 0 ELSE 1.5 END AS score FROM z FULL JOIN asked a ON z.key = a.key AND z.member = a.member")),
    "zcard": (_z(Z.zcard), sql("z", "SELECT key, count(*) AS card FROM z GROUP BY key")),
    "zscore": (_z(lambda z: Z.zscore(z, _every(z))), sql("z", f", {_EVERY} SELECT a.key, a.member, z.score FROM asked a LEFT JOIN z ON a.key = z.key AND a.member = z.member")),
    "zrank": (_z(lambda z: Z.zrank(z, _every(z))), sql("z", f", {_EVERY} SELECT a.key, a.member, r AS rank FROM asked a LEFT JOIN ({_RANK}) q ON a.key = q.key AND a.member = q.member")),
    "zrevrank": (_z(lambda z: Z.zrank(z, _every(z), True)), sql("z", f", {_EVERY} SELECT a.key, a.member, rr AS rank FROM asked a LEFT JOIN ({_RANK}) q ON a.key = q.key AND a.member = q.member")),
    "zrange": (_z(lambda z: Z.zrange(z, _keys(None, z, start=2, stop=6))), sql("z", f"SELECT key, r AS rank, member, score FROM ({_RANK}) WHERE r BETWEEN 2 AND 6")),
    "zrange_neg_index": (_shown(False), sql("z", f"SELECT key, r AS rank, member, score FROM ({_RANK}) WHERE r BETWEEN greatest(n - 5, 0) AND n - 2")),
    "zrevrange": (_shown(True), sql("z", f"SELECT key, rr AS rank, member, score FROM ({_RANK}) WHERE rr BETWEEN greatest(n - 5, 0) AND n - 2")),
    "zrangebyscore_open": (_z(lambda z: Z.zrangeby(z, Z.in_scores(100.0, 3000.0, open_low=True), 1, 20)), sql("z", "SELECT key, member, score, r - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS r FROM z WHERE score > 100 AND score <= 3000) WHERE r BETWEEN 1 AND 20")),
    "zrevrangebyscore_limit": (_z(lambda z: Z.zrangeby(z, Z.in_scores(None, 3000.0, open_high=True), 2, 5, True)), sql("z", "SELECT key, member, score, r - 2 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS r FROM z WHERE score < 3000) WHERE r BETWEEN 2 AND 6")),
    "zcount": (_z(lambda z: Z.zcount(z, Z.in_scores(500.0, 2500.0))), sql("z", "SELECT key, count(*) FILTER (WHERE score BETWEEN 500 AND 2500) AS n FROM z GROUP BY key")),
    "zrangebylex": (_z(lambda z: Z.zrangeby(z.withColumn("score", F.lit(0.0)), Z.in_members("1", "3", open_high=True), 0, 15).select("key", "rank", "member")), sql("z", "SELECT key, r AS rank, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) - 1 AS r FROM z WHERE member >= '1' AND member < '3') WHERE r < 15")),
    "zrevrangebylex": (_z(lambda z: Z.zrangeby(z.withColumn("score", F.lit(0.0)), Z.in_members("1", "3", open_low=True), 1, 9, True).select("key", "rank", "member")), sql("z", "SELECT key, r - 1 AS rank, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member DESC) - 1 AS r FROM z WHERE member > '1' AND member <= '3') WHERE r BETWEEN 1 AND 9")),
    "zlexcount": (_z(lambda z: Z.zcount(z, Z.in_members("2", None))), sql("z", "SELECT key, count(*) FILTER (WHERE member >= '2') AS n FROM z GROUP BY key")),
    "zrem": (_z(lambda z: Z.zrem(z, _asked(z))), sql("z", "SELECT * FROM z WHERE CAST(member AS BIGINT) % 7 <> 3")),
    "zremrangebyrank": (_z(lambda z: Z.zremrangebyrank(z, 3, -3)), sql("z", f"SELECT key, member, score FROM ({_RANK}) WHERE NOT (r BETWEEN 3 AND n - 3)")),
    "zremrangebyscore": (_z(lambda z: Z.zremrangeby(z, Z.in_scores(500.0, 2500.0, open_high=True))), sql("z", "SELECT * FROM z WHERE NOT (score >= 500 AND score < 2500)")),
    "zremrangebylex": (_z(lambda z: Z.zremrangeby(z, Z.in_members("2", "5"))), sql("z", "SELECT * FROM z WHERE NOT (member >= '2' AND member <= '5')")),
    "zpopmax": (_z(lambda z: Z.zpop(z, 3, True)[0]), sql("z", f"SELECT key, member, score, rr AS rank FROM ({_RANK}) WHERE rr < 3")),
    "zpopmin_left": (_z(lambda z: Z.zpop(z, 3, False)[1]), sql("z", f"SELECT key, member, score FROM ({_RANK}) WHERE r >= 3")),
    "zscan_page": (_z(lambda z: Z.zscan(z, 5, 20, "*1*").select("key", "at", "member", "score")), sql("z", 'SELECT key, "at", member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) - 1 AS "at" FROM z) WHERE "at" BETWEEN 5 AND 24 AND member LIKE \'%1%\'')),
    **{f"z{kind}store_{fold}": _fold(kind, fold) for kind in ("union", "inter") for fold in ("sum", "min", "max")},
    "zunionstore_replaced": (lambda spark, d: Z.stored_as(A.zsets(spark, d), Z.zunionstore(A.zsets(spark, d), _inputs(spark, [("view", "view", 1.0), ("view", "click", 1.0)])), _inputs(spark, [("view",)], "key string")), sql("z", "SELECT 'view' AS key, member, sum(score) AS score FROM z WHERE key IN ('view','click') GROUP BY member UNION ALL SELECT * FROM z WHERE key <> 'view'")),
    "zset_segments_top3": (lambda spark, d: Z.top(A.zsets2(spark, d), 3), sql("z2", "SELECT key, member, score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS r FROM z2) WHERE r < 3")),
    "sadd": (_s(lambda s: S.sadd(s, s.select("key", F.lit("new").alias("member")).union(s))), sql("s", "SELECT * FROM s UNION SELECT key, 'new' FROM s")),
    "srem": (_s(lambda s: S.srem(s, s.where("member like '%7'"))), sql("s", "SELECT * FROM s WHERE member NOT LIKE '%7'")),
    "scard": (_s(S.scard), sql("s", "SELECT key, count(*) AS card FROM s GROUP BY key")),
    "smembers": (_s(lambda s: S.smembers(s, s.select("key").union(s.select(F.lit("none").alias("key")).distinct()))), sql("s", "SELECT * FROM s")),
    "sismember": (_s(lambda s: S.sismember(s, s.select("key", F.lit("7").alias("member")).distinct())), sql("s", "SELECT k.key, '7' AS member, CAST(EXISTS (SELECT 1 FROM s WHERE s.key = k.key AND s.member = '7') AS INT) AS is_member FROM (SELECT DISTINCT key FROM s) k")),
    "sunion": (lambda spark, d: S.sunion(A.sets(spark, d), _inputs(spark, _SET_IN, _SET_SCHEMA)), sql("s", f", {_SET_SQL} SELECT DISTINCT dst AS key, member FROM s JOIN i USING (key)")),
    "sinter": (lambda spark, d: S.sinter(A.sets(spark, d), _inputs(spark, _SET_IN, _SET_SCHEMA).select("dst", "key")), sql("s", f", {_SET_SQL}, n AS (SELECT dst, count(*) AS n FROM i GROUP BY dst) SELECT dst AS key, member FROM s JOIN i USING (key) JOIN n USING (dst) GROUP BY 1, 2, n.n HAVING count(*) = n.n")),
    "sdiff": (lambda spark, d: S.sdiff(A.sets(spark, d), _inputs(spark, _SET_IN, _SET_SCHEMA)), sql("s", f", {_SET_SQL} SELECT dst AS key, member FROM s JOIN i USING (key) WHERE pos = 0 EXCEPT SELECT dst, member FROM s JOIN i USING (key) WHERE pos > 0")),
    "sdiffstore": (lambda spark, d: S.stored_as(A.sets(spark, d), S.sdiff(A.sets(spark, d), _inputs(spark, [("1995-01", "1995-01", 0), ("1995-01", "1995-02", 1)], _SET_SCHEMA)), _inputs(spark, [("1995-01",)], "key string")), sql("s", "SELECT * FROM s WHERE key <> '1995-01' UNION ALL (SELECT '1995-01', member FROM s WHERE key = '1995-01' EXCEPT SELECT '1995-01', member FROM s WHERE key = '1995-02')")),
    "sunionstore": (lambda spark, d: S.stored_as(A.sets(spark, d), S.sunion(A.sets(spark, d), _inputs(spark, [("1995-01", "1995-02", 0), ("1995-01", "1996-05", 1), ("new", "1995-01", 0)], _SET_SCHEMA)), _inputs(spark, [("1995-01",), ("new",)], "key string")), sql("s", "SELECT * FROM s WHERE key <> '1995-01' UNION ALL SELECT DISTINCT '1995-01', member FROM s WHERE key IN ('1995-02','1996-05') UNION ALL SELECT 'new', member FROM s WHERE key = '1995-01'")),
    "sinterstore": (lambda spark, d: S.stored_as(A.sets(spark, d), S.sinter(A.sets(spark, d), _inputs(spark, [("1995-01", "1995-02", 0), ("1995-01", "1996-05", 1), ("1995-03", "1995-03", 0), ("1995-03", "none", 1)], _SET_SCHEMA).select("dst", "key")), _inputs(spark, [("1995-01",), ("1995-03",)], "key string")), sql("s", "SELECT * FROM s WHERE key NOT IN ('1995-01','1995-03') UNION ALL (SELECT '1995-01', member FROM s WHERE key = '1995-02' INTERSECT SELECT '1995-01', member FROM s WHERE key = '1996-05')")),
    "smove": (_s(lambda s: S.smove(s, s.where("key = '1995-01'").select(F.col("key").alias("src"), F.lit("1995-02").alias("dst"), "member"))), sql("s", "SELECT * FROM s WHERE key <> '1995-01' UNION SELECT '1995-02', member FROM s WHERE key = '1995-01'")),
    "sscan_page": (_s(lambda s: S.sscan(s, 3, 10, "1?*").select("key", "at", "member")), sql("s", 'SELECT key, "at", member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) - 1 AS "at" FROM s) WHERE "at" BETWEEN 3 AND 12 AND regexp_full_match(member, \'1.+\')')),
    "spop_invariants": (_s(lambda s: S.scard(S.spop(s, 5, 1)[0]).join(S.scard(S.spop(s, 5, 1)[1]).withColumnRenamed("card", "rest"), "key", "left").select("key", "card", F.coalesce("rest", F.lit(0)).alias("rest"))), sql("s", "SELECT key, least(count(*), 5) AS card, greatest(count(*) - 5, 0) AS rest FROM s GROUP BY key")),
    "srandmember_invariants": (_s(lambda s: S.srandmember(s, -12, 1).join(s, ["key", "member"], "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("draws"))), sql("s", "SELECT DISTINCT key, CAST(12 AS BIGINT) AS draws FROM s")),
}
