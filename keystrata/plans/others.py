"""Queries of bitmaps, sketches, places, streams, messages, transactions and reports, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import admin as M
from ..operators import bitmaps as B
from ..operators import geo as G
from ..operators import pubsub as P
from ..operators import sketches as Q
from ..operators import streams as X
from ..operators import transactions as T
from ..registry import registry
from . import adapters as A
from .adapters import sql


def _b(f):
    return lambda spark, d: f(A.bits(spark, d))


def _x(f):
    return lambda spark, d: f(A.streams(spark, d))


_BIN = [("o", "view"), ("o", "click"), ("o", "purchase")]
_BSQL = "i(dst, key) AS (VALUES ('o','view'),('o','click'),('o','purchase'))"


def _bitop(op):
    test = {"and": "count(*) = 3", "or": "true", "xor": "count(*) % 2 = 1"}[op]
    return lambda spark, d: B.bitop(A.bits(spark, d), spark.createDataFrame(_BIN, "dst string, key string"), op), sql("b", f", {_BSQL} SELECT dst AS key, off FROM b JOIN i USING (key) GROUP BY 1, 2 HAVING {test}")


def _sketch(spark, d):
    return A.read(spark, d, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_custkey").cast("string").alias("elem"))


def _near(estimate, exact):
    return F.abs(F.col(estimate) - F.col(exact)) <= 0.05 * F.col(exact)


def _pfcount(spark, d):
    e = _sketch(spark, d)
    exact = e.groupBy("key").agg(F.count_distinct("elem").alias("n"))
    return Q.pfcount(Q.pfadd(None, e)).join(exact, "key").select("key", _near("estimate", "n").alias("near"))


def _pfmerge(spark, d):
    e = _sketch(spark, d)
    inputs = e.select(F.lit("all").alias("dst"), "key").distinct()
    exact = e.select(F.count_distinct("elem").alias("n"))
    return Q.pfcount(Q.pfmerge(Q.pfadd(None, e), inputs)).join(exact).select("key", _near("estimate", "n").alias("near"))


def _pfadd(spark, d):
    e = _sketch(spark, d)
    old = Q.pfadd(None, e)
    same = e.where("key like '1%' or key like '2%'")
    many = e.where("key like '5%'").select("key", F.concat(F.lit("n"), "elem").alias("elem"))
    return Q.pfadd_replies(old, same.union(many))


_CELL = """
c0 AS (SELECT key, member, CAST(floor((lat + 85.05112878) / 170.10225756 * 67108864) AS BIGINT) AS y, CAST(floor((lon + 180.0) / 360.0 * 67108864) AS BIGINT) AS x FROM g0),
g AS (SELECT key, member, x, y, ((-180.0::DOUBLE + x / 67108864.0::DOUBLE * 360.0::DOUBLE) + (-180.0::DOUBLE + (x + 1) / 67108864.0::DOUBLE * 360.0::DOUBLE)) / 2 AS lon, ((-85.05112878::DOUBLE + y / 67108864.0::DOUBLE * 170.10225756::DOUBLE) + (-85.05112878::DOUBLE + (y + 1) / 67108864.0::DOUBLE * 170.10225756::DOUBLE)) / 2 AS lat FROM c0)"""
_BITS = "(SELECT sum(((y >> i) & 1) * power(2::DOUBLE, 2 * i) + ((x >> i) & 1) * power(2::DOUBLE, 2 * i + 1)) FROM range(26) t(i))"


def _hav(lon1, lat1, lon2, lat2):
    u, v = f"sin((radians({lat2}) - radians({lat1})) / 2)", f"sin((radians({lon2}) - radians({lon1})) / 2)"
    return f"(2.0 * 6372797.560856 * asin(sqrt({u} * {u} + cos(radians({lat1})) * cos(radians({lat2})) * {v} * {v})))"


def _g(f):
    return lambda spark, d: f(spark, G.geoadd(A.places(spark, d)))


_CENTRES = [("r1", "cities", 15.0, 37.0, 3000.0), ("r2", "cities", -120.5, -45.25, 1500.0), ("r3", "cities", 179.5, 60.0, 2000.0), ("r4", "none", 0.0, 0.0, 9000.0)]
_CSQL = "r(request, key, clon, clat, radius) AS (VALUES ('r1','cities',15.0::DOUBLE,37.0::DOUBLE,3000.0::DOUBLE),('r2','cities',-120.5::DOUBLE,-45.25::DOUBLE,1500.0::DOUBLE),('r3','cities',179.5::DOUBLE,60.0::DOUBLE,2000.0::DOUBLE))"


def _centres(spark):
    return spark.createDataFrame(_CENTRES, "request string, key string, lon double, lat double, radius double")


_HITS = f"hits AS (SELECT request, member, {_hav('clon', 'clat', 'lon', 'lat')} AS d, radius FROM g JOIN r USING (key))"


def _subs(spark):
    return spark.createDataFrame([("a", "view", False), ("a", "v*", True), ("b", "click", False), ("c", "*", True), ("d", "p?rch*", True), ("d", "view", False), ("e", "[a-e]l*", True), ("e", "[^a-e]*", True), ("f", r"vi\ew*", True), ("f", r"\*", True)], "client string, pattern string, is_glob boolean")


_SUBS = "u(client, pattern, is_glob, rx) AS (VALUES ('a','view',false,NULL),('a','v*',true,'v.*'),('b','click',false,NULL),('c','*',true,'.*'),('d','p?rch*',true,'p.rch.*'),('d','view',false,NULL),('e','[a-e]l*',true,'[a-e]l.*'),('e','[^a-e]*',true,'[^a-e].*'),('f','vi\\ew*',true,'view.*'),('f','\\*',true,'[*]')), m AS (SELECT event_id AS seq, event_type AS channel, CAST(user_id AS VARCHAR) AS msg FROM events)"


def _watches(spark, d):
    o = A.oplog(spark, d)
    return o.groupBy("txn").agg(F.min_by("key", "seq").alias("key"), (F.min("seq") - 25).alias("watch_seq"), F.max("seq").alias("exec_seq"))


def _refused(spark, d):
    return T.conflicts(_watches(spark, d), A.oplog(spark, d).select("seq", "txn", "key"))


_REFUSED = "w AS (SELECT txn, min_by(key, seq) AS key, min(seq) - 25 AS watch_seq, max(seq) AS exec_seq FROM o GROUP BY txn), refused AS (SELECT DISTINCT w.txn FROM w JOIN o ON o.key = w.key WHERE o.txn <> w.txn AND o.seq > watch_seq AND o.seq < exec_seq)"
_FOLD = "last AS (SELECT key, max(seq) AS s, max_by(op, seq) AS op FROM l2 WHERE op IN ('SET','DEL') GROUP BY key), st AS (SELECT l2.key, sum(CASE WHEN l2.op <> 'DEL' THEN arg END) AS value FROM l2 LEFT JOIN last ON last.key = l2.key WHERE s IS NULL OR seq >= s GROUP BY l2.key)"


def _acl(spark, d):
    rules = spark.createDataFrame([("0", 0, True, "@read", None), ("0", 1, False, "+scan", None), ("0", 2, True, None, "u:*"), ("1", 0, True, "*", None), ("1", 1, False, "@write", None), ("1", 2, True, None, "*"), ("2", 0, True, "+get", None)], "user string, pos int, allow boolean, what string, key_pattern string")
    e = A.read(spark, d, "events")
    requests = e.select(F.col("event_id").alias("request"), (F.col("user_id") % 3).cast("string").alias("user"), F.when(F.col("event_id") % 2 == 0, "get").otherwise("scan").alias("command"), F.lit("read").alias("category"), F.concat(F.lit("u:"), "user_id").alias("key"))
    return M.allowed(requests, rules).select("request", "allowed")


# crc32 bit by bit; keys are ASCII here. None of these keys has a tag in braces, the tags of others do.
_STEPS = "list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, {})"
_CRC = f"xor(list_reduce([CAST(unicode(x) AS BIGINT) for x in string_split(tag, '')], lambda c, b: {_STEPS.format('xor(c, b)')}, 4294967295::BIGINT), 4294967295::BIGINT)"
_SLOTS = f"t AS (SELECT *, CASE WHEN regexp_matches(key, '^[^{{]*[{{][^}}]*[}}]') THEN regexp_extract(key, '^[^{{]*[{{]([^}}]*)[}}]', 1) ELSE key END AS tag FROM ks2), s AS (SELECT key, type, etime_ms, CAST({_CRC} % 1024 AS INT) AS slot FROM t)"
_KS2 = "ks2 AS (SELECT CASE WHEN CAST(substr(key, 3) AS BIGINT) % 7 = 0 THEN 'u{' || (CAST(substr(key, 3) AS BIGINT) % 50) || '}' || key ELSE key END AS key, type, etime_ms FROM ks)"


def _tagged(spark, d):
    """The key space with a tag in every seventh key."""
    number = F.substring("key", 3, 20).cast("long")
    return A.keyspace(spark, d).withColumn("key", F.when(number % 7 == 0, F.concat(F.lit("u{"), number % 50, F.lit("}"), "key")).otherwise(F.col("key")))


def _dbs(spark, d):
    return A.keyspace(spark, d).withColumn("db", F.substring("key", 3, 20).cast("long") % 3)


def _xauto(spark, d):
    """Entries without a sequence number go behind a stream that has some, in the order they came."""
    x = A.streams(spark, d).select("key", "ms", "seq", "event_id")
    old = x.where("event_id % 2 = 0")
    return X.xadd_auto(old, x.where("event_id % 2 = 1").drop("seq"), "event_id").select("key", "ms", "seq", "event_id")


_XAUTO = """
, p AS (SELECT key, ms, seq, event_id FROM x WHERE event_id % 2 = 0), m AS (SELECT key, max({'ms': ms, 'seq': seq}) AS l FROM p GROUP BY key),
n AS (SELECT x.key, event_id, greatest(max(ms) OVER (PARTITION BY x.key ORDER BY event_id), coalesce(l.ms, 0)) AS ms, l FROM x LEFT JOIN m ON m.key = x.key WHERE event_id % 2 = 1)
SELECT * FROM p UNION ALL SELECT key, ms, row_number() OVER (PARTITION BY key, ms ORDER BY event_id) - 1 + CASE WHEN l.ms = ms THEN l.seq + 1 ELSE 0 END, event_id FROM n"""


QUERIES = {
    "setbit": (_b(lambda b: B.setbit(b, b.where("off < 50").select("key", "off", F.lit(0).alias("bit"), F.lit(0).alias("pos")).union(b.select("key", F.lit(7777).cast("long"), F.lit(1), F.lit(0)).distinct()))), sql("b", "SELECT * FROM b WHERE off >= 50 UNION SELECT key, 7777 FROM b")),
    "getbit": (_b(lambda b: B.getbit(b, b.select("key", F.lit(3).cast("long").alias("off")).distinct().union(b.select("key", F.lit(99999).cast("long")).distinct()))), sql("b", "SELECT k.key, o.off, CAST(EXISTS (SELECT 1 FROM b WHERE b.key = k.key AND b.off = o.off) AS INT) AS bit FROM (SELECT DISTINCT key FROM b) k, (VALUES (3::BIGINT), (99999::BIGINT)) o(off)")),
    "bitcount": (_b(B.bitcount), sql("b", "SELECT key, count(*) AS bits FROM b GROUP BY key")),
    "bitcount_range": (_b(lambda b: B.bitcount(b, 1, -2)), sql("b", ", n AS (SELECT key, max(off) // 8 + 1 AS n FROM b GROUP BY key) SELECT key, count(*) FILTER (WHERE off // 8 BETWEEN 1 AND least(greatest(n - 2, 0), n - 1)) AS bits FROM b JOIN n USING (key) GROUP BY key")),
    "bitpos_1": (_b(lambda b: B.bitpos(b, 1, 1)), sql("b", "SELECT key, coalesce(min(off) FILTER (WHERE off >= 8), -1) AS pos FROM b GROUP BY key")),
    "bitpos_0": (_b(lambda b: B.bitpos(b, 0)), sql("b", ", n AS (SELECT key, (max(off) // 8 + 1) * 8 AS n FROM b GROUP BY key), e AS (SELECT key, unnest(range(n)) AS off FROM n), f AS (SELECT key, min(off) AS pos FROM (SELECT * FROM e EXCEPT SELECT * FROM b) GROUP BY key) SELECT n.key, CAST(coalesce(pos, -1) AS BIGINT) AS pos FROM n LEFT JOIN f USING (key)")),
    "bitop_and": _bitop("and"),
    "bitop_or": _bitop("or"),
    "bitop_xor": _bitop("xor"),
    "bitop_not": (lambda spark, d: B.bitop(A.bits(spark, d), spark.createDataFrame([("o", "view")], "dst string, key string"), "not"), sql("b", "SELECT 'o' AS key, unnest(range((SELECT max(off) // 8 + 1 FROM b WHERE key = 'view') * 8)) AS off EXCEPT SELECT 'o', off FROM b WHERE key = 'view'")),
    "pfcount_within_5pct": (_pfcount, "SELECT DISTINCT o_orderpriority AS key, true AS near FROM orders"),
    "pfmerge_union_within_5pct": (_pfmerge, "SELECT 'all' AS key, true AS near"),
    "pfadd_changed": (_pfadd, "SELECT DISTINCT o_orderpriority AS key, CASE WHEN o_orderpriority LIKE '5%' THEN 1 ELSE 0 END AS reply FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' OR o_orderpriority LIKE '5%'"),
    "geoadd_score": (lambda spark, d: G.geoadd(A.places(spark, d)), sql("g0", f", {_CELL} SELECT key, member, CAST({_BITS} AS BIGINT) AS score FROM g")),
    "geopos": (_g(lambda spark, g: G.geopos(g, g.select("key", "member")).select("key", "member", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))), sql("g0", f", {_CELL} SELECT key, member, round(lon, 6) AS lon, round(lat, 6) AS lat FROM g")),
    "geodist_km": (_g(lambda spark, g: G.geodist(g, g.select("key", F.col("member").alias("a"), F.lit("Customer#000000001").alias("b")), "km")), sql("g0", f", {_CELL} SELECT a.key, a.member AS a, 'Customer#000000001' AS b, round({_hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} / 1000, 4) AS distance FROM g a LEFT JOIN g b ON b.member = 'Customer#000000001'")),
    "geohash10": (_g(lambda spark, g: G.geohash(g, g.select("key", "member"))), sql("g0", f", {_CELL}, e AS (SELECT key, member, x, CAST(floor((lat + 90.0) / 180.0 * 67108864) AS BIGINT) AS y FROM g) SELECT key, member, (SELECT string_agg(substr('0123456789bcdefghjkmnpqrstuvwxyz', 1 + CAST(list_sum([((CASE WHEN (51 - p) % 2 = 1 THEN x >> ((51 - p) // 2) ELSE y >> ((51 - p) // 2) END) & 1) * CAST(power(2, 4 - (p - 5 * c)) AS BIGINT) for p in range(5 * c, 5 * c + 5)]) AS INT), 1), '' ORDER BY c) FROM range(10) t(c)) AS geohash FROM e")),
    "georadius_asc": (_g(lambda spark, g: G.georadius(g, _centres(spark), "km").select("request", "nth", "member", "distance")), sql("g0", f", {_CELL}, {_CSQL}, {_HITS} SELECT request, row_number() OVER (PARTITION BY request ORDER BY d, member) AS nth, member, round(d / 1000, 4) AS distance FROM hits WHERE d <= radius * 1000")),
    "georadius_count_desc": (_g(lambda spark, g: G.georadius(g, _centres(spark), "km", 5, True).select("request", "nth", "member", "distance")), sql("g0", f", {_CELL}, {_CSQL}, {_HITS} SELECT * FROM (SELECT request, row_number() OVER (PARTITION BY request ORDER BY d DESC, member) AS nth, member, round(d / 1000, 4) AS distance FROM hits WHERE d <= radius * 1000) WHERE nth <= 5")),
    "georadius_store": (_g(lambda spark, g: G.georadius(g, _centres(spark), "km").select(F.col("request").alias("key"), "member", "score")), sql("g0", f", {_CELL}, {_CSQL}, {_HITS} SELECT request AS key, hits.member, CAST({_BITS} AS BIGINT) AS score FROM hits JOIN g ON g.member = hits.member WHERE d <= radius * 1000")),
    "georadiusbymember": (_g(lambda spark, g: G.georadiusbymember(g, spark.createDataFrame([("q", "cities", "Customer#000000002", 4000.0)], "request string, key string, member string, radius double"), "km").select("request", "nth", "member", "distance")), sql("g0", f", {_CELL}, r AS (SELECT 'q' AS request, key, lon AS clon, lat AS clat, 4000.0 AS radius FROM g WHERE member = 'Customer#000000002'), {_HITS} SELECT request, row_number() OVER (PARTITION BY request ORDER BY d, member) AS nth, member, round(d / 1000, 4) AS distance FROM hits WHERE d <= radius * 1000")),
    "xadd_autoid": (_xauto, sql("x", _XAUTO)),
    "xadd_monotone": (_x(lambda x: X.xadd(x.limit(0), x, "event_id")[0].select("key", "ms", "seq", "event_id")), sql("x", "SELECT key, ms, seq, event_id FROM (SELECT *, max({'ms': ms, 'seq': seq}) OVER (PARTITION BY key ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM x) WHERE b IS NULL OR {'ms': ms, 'seq': seq} > b")),
    "xlen": (_x(X.xlen), sql("x", "SELECT key, count(*) AS length FROM x GROUP BY key")),
    "xrange": (_x(lambda x: X.xrange(x, X.in_ids((1704240000000, 0), (1704412800000, 0), open_high=True)).select("key", "nth", "ms", "seq")), sql("x", "SELECT key, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS nth, ms, seq FROM x WHERE ms >= 1704240000000 AND ms < 1704412800000")),
    "xrevrange_count": (_x(lambda x: X.xrange(x, X.in_ids(None, (1705276800000, 0)), 7, True).select("key", "nth", "ms", "seq")), sql("x", "SELECT * FROM (SELECT key, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS nth, ms, seq FROM x WHERE ms < 1705276800000 OR (ms = 1705276800000 AND seq = 0)) WHERE nth <= 7")),
    "xread_multi": (lambda spark, d: X.xread(A.streams(spark, d), spark.createDataFrame([("view", 1704240000000, 0), ("click", 1704412800000, 3), ("error", None, None)], "key string, after_ms long, after_seq long"), 9).select("key", "nth", "ms", "seq"), sql("x", ", c(key, m, s) AS (VALUES ('view', 1704240000000, 0), ('click', 1704412800000, 3)) SELECT * FROM (SELECT key, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS nth, ms, seq FROM x JOIN c USING (key) WHERE ms > m OR (ms = m AND seq > s)) WHERE nth <= 9")),
    "xtrim_maxlen": (_x(lambda x: X.xtrim_len(x, 25).select("key", "ms", "seq")), sql("x", "SELECT key, ms, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS n FROM x) WHERE n <= 25")),
    "xtrim_minid": (_x(lambda x: X.xtrim_id(x, (1705276800000, 0)).select("key", "ms", "seq")), sql("x", "SELECT key, ms, seq FROM x WHERE ms >= 1705276800000")),
    "xdel": (_x(lambda x: X.xdel(x, x.where("user_id % 2 = 0")).select("key", "ms", "seq")), sql("x", "SELECT key, ms, seq FROM x WHERE user_id % 2 <> 0")),
    "xinfo": (_x(X.xinfo), sql("x", "SELECT key, count(*) AS length, min({'ms': ms, 'seq': seq}).ms || '-' || min({'ms': ms, 'seq': seq}).seq AS first_id, max({'ms': ms, 'seq': seq}).ms || '-' || max({'ms': ms, 'seq': seq}).seq AS last_id FROM x GROUP BY key")),
    "publish_fanout": (lambda spark, d: P.publish(A.messages(spark, d), _subs(spark)), f"WITH {_SUBS} SELECT m.channel, m.seq, m.msg, (SELECT count(*) FROM u WHERE CASE WHEN is_glob THEN regexp_full_match(m.channel, rx) ELSE m.channel = pattern END) AS receivers FROM m"),
    "psubscribe_glob": (lambda spark, d: P.delivered(A.messages(spark, d), _subs(spark).where("is_glob")), f"WITH {_SUBS} SELECT m.channel, m.seq, m.msg, u.client, u.pattern FROM m JOIN u ON is_glob AND regexp_full_match(m.channel, rx)"),
    "subscribe_exact": (lambda spark, d: P.delivered(A.messages(spark, d), _subs(spark).where("not is_glob")), f"WITH {_SUBS} SELECT m.channel, m.seq, m.msg, u.client, u.pattern FROM m JOIN u ON NOT is_glob AND m.channel = pattern"),
    "unsubscribe": (lambda spark, d: P.unsubscribe(_subs(spark), spark.createDataFrame([("a", None, True), ("d", "view", False)], "client string, pattern string, is_glob boolean")), "SELECT * FROM (VALUES ('a','view',false),('b','click',false),('c','*',true),('d','p?rch*',true),('e','[a-e]l*',true),('e','[^a-e]*',true),('f','vi\\ew*',true),('f','\\*',true)) t(client, pattern, is_glob)"),
    "pubsub_numsub": (lambda spark, d: P.numsub(_subs(spark)), "SELECT * FROM (VALUES ('view', 2::BIGINT), ('click', 1::BIGINT)) t(channel, clients)"),
    "pubsub_numpat": (lambda spark, d: P.numpat(_subs(spark)), "SELECT 7::BIGINT AS patterns"),
    "oplog_running": (lambda spark, d: T.folded(A.oplog(spark, d)).select("seq", "key", F.col("value").cast("long").alias("value")), sql("o", ", p AS (SELECT *, sum(CASE WHEN op IN ('SET','DEL') THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS part FROM o) SELECT seq, key, CAST(sum(CASE WHEN op <> 'DEL' THEN arg END) OVER (PARTITION BY key, part ORDER BY seq) AS BIGINT) AS value FROM p")),
    "exec_fold": (lambda spark, d: T.state(A.oplog(spark, d)), sql("o", f", l2 AS (SELECT * FROM o), {_FOLD} SELECT key, CAST(value AS BIGINT) AS value FROM st WHERE value IS NOT NULL")),
    "watch_conflict": (_refused, sql("o", f", {_REFUSED} SELECT txn FROM refused")),
    "exec_committed": (lambda spark, d: T.state(T.committed(A.oplog(spark, d), _refused(spark, d), A.oplog(spark, d).where("txn % 13 = 0"))), sql("o", f", {_REFUSED}, l2 AS (SELECT * FROM o WHERE txn NOT IN (SELECT txn FROM refused) AND txn % 13 <> 0), {_FOLD} SELECT key, CAST(value AS BIGINT) AS value FROM st WHERE value IS NOT NULL")),
    "discard": (lambda spark, d: T.committed(A.oplog(spark, d), A.oplog(spark, d).select("txn").limit(0), A.oplog(spark, d).where("txn % 13 = 0")), sql("o", "SELECT * FROM o WHERE txn % 13 <> 0")),
    "slowlog_topn": (lambda spark, d: M.slowlog(A.read(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("value") * 100).cast("long").alias("duration_us")), 20, 1000), "SELECT event_id AS id, CAST(trunc(value * 100) AS BIGINT) AS duration_us FROM events WHERE CAST(trunc(value * 100) AS BIGINT) >= 1000 ORDER BY event_id DESC LIMIT 20"),
    "acl_dryrun": (_acl, "SELECT event_id AS request, CASE WHEN user_id % 3 = 0 THEN event_id % 2 = 0 WHEN user_id % 3 = 1 THEN true ELSE false END AS allowed FROM events"),
    "bigkeys_topn": (lambda spark, d: M.bigkeys(A.hashes(spark, d).select("key", (F.octet_length("field") + F.octet_length("value")).cast("long").alias("bytes")), 10), sql("h", "SELECT key, CAST(sum(octet_length(encode(field)) + octet_length(encode(value))) AS BIGINT) AS bytes, count(*) AS members FROM h GROUP BY key ORDER BY bytes DESC, key LIMIT 10")),
    "slots_census": (lambda spark, d: M.slot_census(_tagged(spark, d)), sql("ks", f", {_KS2}, {_SLOTS} SELECT slot, count(*) AS n_keys FROM s GROUP BY slot")),
    "slots_hashkey": (lambda spark, d: _tagged(spark, d).select("key", M.slot(F.col("key")).alias("slot")), sql("ks", f", {_KS2}, {_SLOTS} SELECT key, slot FROM s")),
    "slots_cleanup": (lambda spark, d: M.slot_cleaned(_tagged(spark, d), [0, 1, 2, 3]), sql("ks", f", {_KS2}, {_SLOTS} SELECT key, type, etime_ms FROM s WHERE slot NOT IN (0, 1, 2, 3)")),
    "slots_scan": (lambda spark, d: M.slot_members(_tagged(spark, d), list(range(16))), sql("ks", f", {_KS2}, {_SLOTS} SELECT key, type, etime_ms FROM s WHERE slot < 16")),
    "slots_rebalance": (lambda spark, d: M.rebalanced(M.slot_census(_tagged(spark, d)), 3).select("slot", "group"), sql("ks", f', {_KS2}, {_SLOTS} SELECT slot, CAST(ntile(3) OVER (ORDER BY slot) AS INT) AS "group" FROM (SELECT DISTINCT slot FROM s)')),
    "select_db": (lambda spark, d: M.selected(_dbs(spark, d), 1).select("key", "type"), sql("ks", "SELECT key, type FROM ks WHERE CAST(substr(key, 3) AS BIGINT) % 3 = 1")),
    "flushdb": (lambda spark, d: M.flushed(_dbs(spark, d), 1).groupBy("db").agg(F.count(F.lit(1)).alias("n")), sql("ks", "SELECT CAST(substr(key, 3) AS BIGINT) % 3 AS db, count(*) AS n FROM ks WHERE CAST(substr(key, 3) AS BIGINT) % 3 <> 1 GROUP BY 1")),
    "flushall": (lambda spark, d: M.flushed(_dbs(spark, d)).agg(F.count(F.lit(1)).alias("n")), "SELECT 0::BIGINT AS n"),
    "command_registry": (lambda spark, d: registry(spark).groupBy("status").agg(F.count(F.lit(1)).alias("commands")), None),
    "echo": (lambda spark, d: spark.range(1).select(F.lit("hello").alias("msg")), "SELECT 'hello' AS msg"),
}
