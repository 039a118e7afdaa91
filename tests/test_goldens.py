"""Known cases of each family, on literals."""

import random
import zlib
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.functions import places
from keystrata.functions.glob import literal_prefix, matched, matches, regex
from keystrata.operators import admin, bitmaps, geo, hashes, keys, lists, pubsub, sets, sketches, streams, strings, transactions, zsets

NOW = 1_000_000


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_glob():
    import re

    for pattern, yes, no in [("a*c", ["ac", "abbc", "a\nc"], ["acb"]), ("h?llo", ["hello"], ["hllo"]), ("[a-c]x", ["bx"], ["dx"]), ("[^a]x", ["bx"], ["ax"]), (r"a\*", ["a*"], ["ab"]), ("[]", [], ["", "]"]), ("a.b", ["a.b"], ["axb"]), ("", [""], ["a"]), ("[a", ["a"], ["["])]:
        assert all(re.search(regex(pattern), t) for t in yes) and not any(re.search(regex(pattern), t) for t in no), pattern


def test_glob_columns(spark):
    df = spark.createDataFrame([("abc", "a*"), ("a.c", "a.?"), ("x", "y"), ("a(c", "a(*")], "c string, p string")
    assert rows(matched(df, "c", df, "p")) == [("a(c", "a(*"), ("a(c", "a*"), ("a.c", "a*"), ("a.c", "a.?"), ("abc", "a*")]
    globs = spark.createDataFrame([("[a-c]bc",), ("[^a]*",), (r"\*",), ("abcdefghijkl*",), ("*",), ("?",)], "p string")
    texts = spark.createDataFrame([("abc",), ("*",), ("abcdefghijklm",), ("",), (None,)], "c string")
    assert rows(matched(texts, "c", globs, "p")) == sorted([("abc", "[a-c]bc"), ("abc", "*"), ("*", "[^a]*"), ("*", r"\*"), ("*", "*"), ("*", "?"), ("abcdefghijklm", "abcdefghijkl*"), ("abcdefghijklm", "*"), ("", "*")])
    assert [literal_prefix(p) for p in ("ab*", r"a\*b?", "[x]", "")] == ["ab", "a*b", "", ""]
    assert rows(df.where(matches("c", "a*")), "c") == [("a(c",), ("a.c",), ("abc",)]
    assert rows(df.where(matches("c", "x")), "c") == [("x",)]


def test_places_in_ranges(spark, monkeypatch):
    rng = random.Random(4)
    data = [(rng.choice(["hot", "hot", "hot", "a", "b"]), f"m{i}", float(rng.choice([1, 1, 1, rng.randint(0, 50)]))) for i in range(3000)]
    z = spark.createDataFrame(data, "key string, member string, score double")
    want = {}
    for k in ("hot", "a", "b"):
        for n, (_, m, _) in enumerate(sorted((r for r in data if r[0] == k), key=lambda r: (r[2], r[1]))):
            want[k, m] = n
    for piece in (100, 10**6):  # the members of a key go in some thirty ranges, or in one
        monkeypatch.setattr(places, "PIECE", piece)
        got = places.numbered(z, ["score", "member"], "rank")
        assert {(r["key"], r["member"]): r["rank"] for r in got.collect()} == want
        assert {(r["key"], r["length"]) for r in got.collect()} == {(k, sum(d[0] == k for d in data)) for k in ("hot", "a", "b")}
    one = spark.range(100_000).select(F.lit("k").alias("key"), F.col("id").cast("string").alias("member"), (F.col("id") % 977).cast("double").alias("score"))
    monkeypatch.setattr(places, "PIECE", 10_000)
    asked = spark.createDataFrame([("k", "0"), ("k", "977"), ("k", "1"), ("k", "none"), ("other", "0")], "key string, member string")
    assert zsets.zrank(one, asked).count() == 5
    assert {r["member"]: r["rank"] for r in zsets.zrank(one, asked).where("key = 'k'").collect()} == brute_ranks(100_000, 977, ["0", "977", "1", "none"])


def brute_ranks(n, m, asked):
    order = {x: i for i, x in enumerate(sorted(map(str, range(n)), key=lambda x: (int(x) % m, x)))}
    return {x: order.get(x) for x in asked}


def test_conflicts_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(transactions, "RANGE", 16)
    rng = random.Random(5)
    writes = [(s, rng.randrange(12), rng.choice("aab")) for s in range(200)]
    watches = [(t, rng.choice("abc"), a, a + rng.randint(-3, 40)) for t in range(14) for a in [rng.randrange(200)] for _ in range(2)]
    want = {t for t, k, a, b in watches for s, by, key in writes if key == k and by != t and a < s < b}
    got = transactions.conflicts(spark.createDataFrame(watches, "txn long, key string, watch_seq long, exec_seq long"), spark.createDataFrame(writes, "seq long, txn long, key string"))
    assert {r["txn"] for r in got.collect()} == want


def test_stored_sets_and_databases(spark):
    s = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, member string")
    empty = sets.sinter(s, spark.createDataFrame([("a", "a"), ("a", "b")], "dst string, key string"))
    assert rows(sets.stored_as(s, empty, spark.createDataFrame([("a",)], "key string"))) == [("b", "2")]
    k = spark.createDataFrame([("x", 0), ("y", 1)], "key string, db int")
    assert rows(admin.selected(k, 1)) == [("y",)] and rows(admin.flushed(k, 1)) == [("x", 0)] and rows(admin.flushed(k)) == []


def test_automatic_stream_ids(spark):
    x = spark.createDataFrame([("s", 100, 3, 0)], "key string, ms long, seq long, n int")
    new = spark.createDataFrame([("s", 90, 1), ("s", 100, 2), ("s", 120, 3), ("s", 110, 4), ("t", 0, 5), ("t", 0, 6)], "key string, ms long, n int")
    got = {r["n"]: (r["ms"], r["seq"]) for r in streams.xadd_auto(x, new, "n").collect()}
    assert got == {0: (100, 3), 1: (100, 4), 2: (100, 5), 3: (120, 0), 4: (120, 1), 5: (0, 1), 6: (0, 2)}


def test_set_algebra(spark):
    s = spark.createDataFrame([(k, m) for k, ms in {"k1": "abcd", "k2": "c", "k3": "ace"}.items() for m in ms], "key string, member string")
    three = spark.createDataFrame([("d", "k1", 0), ("d", "k2", 1), ("d", "k3", 2)], "dst string, key string, pos int")
    assert rows(sets.sdiff(s, three)) == [("d", "b"), ("d", "d")]
    assert rows(sets.sinter(s, three.select("dst", "key"))) == [("d", "c")]
    assert rows(sets.sunion(s, three)) == [("d", m) for m in "abcde"]
    missing = three.where("pos < 2").union(spark.createDataFrame([("d", "none", 2)], three.schema))
    assert rows(sets.sinter(s, missing.select("dst", "key"))) == []
    moved = sets.smove(s, spark.createDataFrame([("k1", "k2", "a"), ("k1", "k2", "zz")], "src string, dst string, member string"))
    assert ("k2", "a") in rows(moved) and ("k1", "a") not in rows(moved) and ("k2", "zz") not in rows(moved)
    taken, left = sets.spop(s, 2, 5)
    assert rows(taken.unionByName(left)) == rows(s) and rows(sets.scard(taken)) == [("k1", 2), ("k2", 1), ("k3", 2)]
    assert sets.srandmember(s, -7, 1).count() == 21 and sets.srandmember(s, 9, 1).count() == 8


def test_weighted_unions(spark):
    z = spark.createDataFrame([(f"z{i}", f"M{j}", float(10 ** (j + 3 * i))) for i in range(3) for j in range(3)], "key string, member string, score double")
    inputs = spark.createDataFrame([("d", f"z{i}", 1.0) for i in range(3)], "dst string, key string, weight double")
    assert rows(zsets.zunionstore(z, inputs), "member", "score") == [("M0", 1001001.0), ("M1", 10010010.0), ("M2", 100100100.0)]
    assert rows(zsets.zunionstore(z, inputs, "min"), "member", "score") == [("M0", 1.0), ("M1", 10.0), ("M2", 100.0)]
    assert zsets.zinterstore(z, inputs.union(spark.createDataFrame([("d", "none", 1.0)], inputs.schema))).count() == 0
    zero = zsets.zunionstore(z.limit(1), spark.createDataFrame([("d", "z0", -0.0)], inputs.schema)).first()["score"]
    assert str(zero) == "0.0"


def test_ranges_by_rank(spark):
    members = [(f"MM{i}", float(i)) for i in range(9)]
    z = spark.createDataFrame([("k", m, s) for m, s in members], "key string, member string, score double")
    for start in range(-11, 12):
        for stop in range(-11, 12):
            a, b = start + 9 if start < 0 else start, stop + 9 if stop < 0 else stop
            want = [m for m, _ in members[max(a, 0) : b + 1]] if b >= 0 else []
            if (start + stop) % 5 == 0:
                asked = spark.createDataFrame([("k", start, stop)], "key string, start long, stop long")
                assert [m for (m,) in rows(zsets.zrange(z, asked), "member")] == want
    assert rows(zsets.zremrangebyrank(z, 1, -2), "member") == [("MM0",), ("MM8",)]
    ties = spark.createDataFrame([("k", m, 1.0) for m in ("10", "9", "é", "Z", "a")], "key string, member string, score double")
    assert [r["member"] for r in zsets.ranked(ties).orderBy("rank").collect()] == ["10", "9", "Z", "a", "é"]
    assert rows(zsets.zrank(ties, ties.select("key", "member"), True), "member", "rank") == [("10", 4), ("9", 3), ("Z", 2), ("a", 1), ("é", 0)]


def test_ranges_by_bytes(spark):
    z = spark.createDataFrame([("k", m, 1.0) for m in "efghijklm"], "key string, member string, score double")
    run = lambda *a, **k: "".join(r["member"] for r in zsets.zrangeby(z, zsets.in_members(*a, **k)).orderBy("rank").collect())
    assert run("a", "n") == "efghijklm" and run("e", "m") == "efghijklm" and run("e", "m", True, True) == "fghijkl" and run(None, "g") == "efg" and run("k", None, True) == "lm"
    new = spark.createDataFrame([("k", "e", 5.0, 0), ("k", "e", 9.0, 1), ("k", "q", 2.0, 2)], "key string, member string, score double, pos int")
    assert {r["member"]: r["score"] for r in zsets.zadd(z, new).collect()}["e"] == 5.0 and rows(zsets.zadd_count(z, new)) == [("k", 1)]


def test_lists(spark):
    t = lists.push(spark.createDataFrame([], "key string, idx long, value string"), spark.createDataFrame([("k", i, c) for i, c in enumerate("nilppez")], "key string, pos int, value string"), left=True)
    order = lambda df: "".join(r["value"] for r in df.orderBy("idx").collect())
    assert order(t) == "zepplin"
    asked = spark.createDataFrame([("k", 0), ("k", 4), ("k", -1), ("k", 7), ("none", 0)], "key string, i long")
    assert {(r["key"], r["i"]): r["value"] for r in lists.lindex(t, asked).collect()} == {("k", 0): "z", ("k", 4): "l", ("k", -1): "n", ("k", 7): None, ("none", 0): None}
    pivot = spark.createDataFrame([("k", "p", "X")], "key string, pivot string, new string")
    assert order(lists.linsert(t, pivot, True)) == "zeXpplin" and order(lists.linsert(t, pivot, False)) == "zepXplin"
    replies = spark.createDataFrame([("k", "p", "X"), ("k2", "p", "X")], pivot.schema).union(spark.createDataFrame([("k", "?", "X")], pivot.schema))
    assert sorted(r["reply"] for r in lists.linsert_replies(t, replies).collect()) == [-1, 0, 8]
    assert order(lists.lrem(t, "p", 1)) == "zeplin" and order(lists.lrem(t, "p", 0)) == "zelin" and order(lists.ltrim(t, -3, -1)) == "lin" and order(lists.ltrim(t, 5, 2)) == ""
    moved = lists.rpoplpush(t, spark.createDataFrame([("k", "k")], "src string, dst string"))
    assert order(moved) == "nzeppli"
    popped, left = lists.pop(t, 3, False)
    assert [r["value"] for r in popped.orderBy("nth").collect()] == list("nil") and order(left) == "zepp"
    with pytest.raises(Exception, match="index out of range"):
        lists.lset(t, spark.createDataFrame([("k", 9, "x")], "key string, i long, new string")).collect()


def bits_of(spark, values):
    return spark.createDataFrame([(k, 8 * i + j) for k, v in values.items() for i, b in enumerate(v) for j in range(8) if b >> (7 - j) & 1], "key string, off long")


def bytes_of(df, n):
    out = bytearray(n)
    for r in df.collect():
        out[r["off"] >> 3] |= 128 >> (r["off"] & 7)
    return bytes(out)


def test_bitmaps(spark):
    b = bits_of(spark, {"f": b"foobar"})
    assert rows(bitmaps.bitcount(b)) == [("f", 26)] and rows(bitmaps.bitcount(b, 0, 0)) == [("f", 4)] and rows(bitmaps.bitcount(b, 1, 1)) == [("f", 6)] and rows(bitmaps.bitcount(b, 0, -99)) == [("f", 4)]
    b = bits_of(spark, {"1": b"FOOBAR", "2": b"ABCDEF", "3": b"STORAGE"})
    inputs = spark.createDataFrame([("d", k) for k in "123"], "dst string, key string")
    assert bytes_of(bitmaps.bitop(b, inputs, "and"), 7) == b"@@C@AB\0"
    assert bytes_of(bitmaps.bitop(b, inputs, "or"), 7) == b"W_OVEWE"
    assert bytes_of(bitmaps.bitop(b, inputs, "xor"), 7) == b"TYCTESE"
    assert bytes_of(bitmaps.bitop(b, inputs.where("key = '1'"), "not"), 6) == bytes.fromhex("b9b0b0bdbead")


def test_bitmaps_against_a_model(spark):
    rng = random.Random(3)
    values = {f"k{i}": bytes(rng.choice([0, 255, 255, rng.randrange(256)]) for _ in range(rng.randint(1, 6))) + b"\1" for i in range(40)}
    b = bits_of(spark, values)
    for start, stop in [(0, -1), (1, -1), (1, 2), (-2, -1)]:
        for bit in (0, 1):
            got = dict(rows(bitmaps.bitpos(b, bit, start, stop)))
            for k, v in values.items():
                n = len(v)
                first, last = max(start + n if start < 0 else start, 0), min(stop + n if stop < 0 else stop, n - 1)
                want = next((i for i in range(8 * first, 8 * last + 8) if (v[i >> 3] >> (7 - (i & 7)) & 1) == bit), -1)
                assert got[k] == want, (k, v, bit, start, stop)


def text_table(spark, values):
    return spark.createDataFrame([(k, v, e) for k, (v, e) in values.items()], "key string, value string, etime_ms long")


def test_strings(spark):
    t = text_table(spark, {"a": ("10", None), "dead": ("7", NOW - 1), "soon": ("5", NOW), "é": ("héllo", NOW + 5)})
    by = spark.createDataFrame([("a", 5), ("dead", 1), ("new", -3), ("a", 1)], "key string, by long")
    assert {r["key"]: r["value"] for r in strings.incrby(t, by, NOW).collect()} == {"a": "16", "dead": "1", "new": "-3", "soon": "5", "é": "héllo"}
    for bad in ("x", "1.5", "9223372036854775807", " 1"):
        with pytest.raises(Exception, match="integer|overflow"):
            strings.incrby(text_table(spark, {"a": (bad, None)}), by, NOW).collect()
    assert {r["key"]: r["value"] for r in strings.incrbyfloat(t, by.selectExpr("key", "by + 0.25 as by"), NOW).collect()}["new"] == "-2.75"
    cut = lambda a, b: bytes(t.where("key = 'é'").select(strings.byte_range(F.col("value"), a, b)).first()[0])
    raw = "héllo".encode()
    for a in range(-8, 8):
        for b in range(-8, 8):
            if (a + b) % 3 == 0:
                first, last = max(a + 6, 0) if a < 0 else a, max(b + 6, 0) if b < 0 else b
                assert cut(a, b) == raw[first : last + 1], (a, b)
    put = lambda v, o, n: bytes(spark.range(1).select(strings.overwrite_bytes(F.lit(v), o, n)).first()[0])
    assert put("Hello World", 6, b"Redis") == b"Hello Redis" and put("ab", 4, b"x") == b"ab\0\0x" and put(None, 1, b"y") == b"\0y" and put("ab", 9, b"") == b"ab"
    told, left = strings.delete_if_same(t, spark.createDataFrame([("a", "10"), ("soon", "x"), ("dead", "7")], "key string, value string"), NOW)
    assert {r["key"]: r["reply"] for r in told.collect()} == {"a": 1, "soon": -1, "dead": 0} and "a" not in {r["key"] for r in left.collect()}
    new = spark.createDataFrame([("a", "n", 0), ("dead", "n", 0)], "key string, value string, pos int")
    assert {r["key"]: r["value"] for r in strings.put(t, new, NOW, "absent").collect()}["dead"] == "n"
    calls = new.withColumn("call", F.lit("c"))
    assert rows(strings.put_all_or_none(t, calls, NOW)) == rows(t)


def test_keys(spark):
    k = spark.createDataFrame([("a", "string", None), ("b", "hash", NOW + 1500), ("c", "set", NOW - 1), ("s", "stream", None)], "key string, type string, etime_ms long")
    asked = spark.createDataFrame([(x,) for x in "abcsz"], "key string")
    assert dict(rows(keys.ttl(k, asked, NOW))) == {"a": -1, "b": 1, "c": -2, "s": -2, "z": -2}
    assert dict(rows(keys.types(k, asked, NOW))) == {"a": "string", "b": "hash", "c": "none", "s": "stream", "z": "none"}
    assert keys.exists(k, asked.union(asked), NOW).count() == 6
    assert {r["key"] for r in keys.expire_in(k, asked.withColumn("ttl", F.lit(0)), NOW).collect()} == {"c", "s"}
    told, left = keys.persist(k, asked, NOW)
    assert dict(rows(told)) == {"a": 0, "b": 1, "c": 0, "s": 0, "z": 0} and left.where("key = 'b'").first()["etime_ms"] is None
    letters = spark.createDataFrame([(c, "string", None) for c in "ACEGIKMOQS"], k.schema)
    page = lambda *a, **o: [(r["key"], r["is_next"]) for r in sorted(keys.key_range(letters, "string", NOW, *a, **o).collect())]
    assert page("", "", limit=3) == [("A", False), ("C", False), ("E", False), ("G", True)]
    assert page("C", "G", limit=9) == [("C", False), ("E", False), ("G", False)]
    assert page("S", "O", limit=2, desc=True) == [("O", True), ("Q", False), ("S", False)]
    with pytest.raises(ValueError):
        keys.key_range(letters, "string", NOW, "Z", "A")


def test_hashes(spark):
    h = spark.createDataFrame([("k", "a", "1"), ("k", "b", "x"), ("k", "é", "ü")], "key string, field string, value string")
    new = spark.createDataFrame([("k", "a", "8", 0), ("k", "a", "9", 1), ("k", "n", "0", 2)], "key string, field string, value string, pos int")
    assert dict(rows(hashes.hset(h, new), "field", "value")) == {"a": "9", "b": "x", "é": "ü", "n": "0"}
    assert dict(rows(hashes.hsetnx(h, new), "field", "value")) == {"a": "1", "b": "x", "é": "ü", "n": "0"}
    assert rows(hashes.hscan(h, 0, 2, "b*"), "field") == [("b",)] and rows(hashes.hscan(h, 0, 1, "b*"), "field") == []
    assert rows(hashes.hstrlen(h, spark.createDataFrame([("k", "é"), ("k", "?")], "key string, field string")), "field", "length") == [("?", 0), ("é", 2)]
    with pytest.raises(Exception, match="integer"):
        hashes.hincrby(h, spark.createDataFrame([("k", "b", 1)], "key string, field string, by long")).collect()


def test_geo(spark):
    g = geo.geoadd(spark.createDataFrame([("Sicily", "Palermo", 13.361389, 38.115556), ("Sicily", "Catania", 15.087269, 37.502669)], "key string, member string, lon double, lat double"))
    assert {r["member"]: r["score"] for r in g.collect()} == {"Palermo": 3479099956230698, "Catania": 3479447370796909}
    asked = spark.createDataFrame([("q", "Sicily", 15.0, 37.0, 200.0)], "request string, key string, lon double, lat double, radius double")
    got = geo.georadius(g, asked, "km").orderBy("nth").collect()
    assert [(r["member"], r["distance"]) for r in got] == [("Catania", 56.4413), ("Palermo", 190.4424)]
    assert geo.geodist(g, spark.createDataFrame([("Sicily", "Palermo", "Catania")], "key string, a string, b string")).first()["distance"] == 166274.1516
    assert dict(rows(geo.geohash(g, g.select("key", "member")), "member", "geohash")) == {"Palermo": "sqc8b49rny", "Catania": "sqdtr74hyu"}
    assert geo.geohash(g, spark.createDataFrame([("Sicily", "none")], "key string, member string")).first()["geohash"] is None


def test_geo_radius_against_all_distances(spark):
    rng = random.Random(5)
    places = [("k", f"m{i}", rng.uniform(-180, 180), rng.uniform(-85, 85)) for i in range(400)] + [("k", "w", -179.99, 10.0), ("k", "e", 179.99, 10.0), ("k", "n", 3.0, 85.0)]
    g = geo.geoadd(spark.createDataFrame(places, "key string, member string, lon double, lat double")).cache()
    centres = [(f"q{i}", "k", rng.uniform(-180, 180), rng.uniform(-85, 85), 10 ** rng.uniform(1, 4)) for i in range(20)] + [("q_edge", "k", 179.999, 10.0, 50.0), ("q_pole", "k", -170.0, 84.9, 900.0)]
    asked = spark.createDataFrame(centres, "request string, key string, lon double, lat double, radius double")
    lon, lat = geo.decode(F.col("score"))
    every = g.select("member", lon.alias("lon"), lat.alias("lat")).crossJoin(asked.select("request", F.col("lon").alias("x"), F.col("lat").alias("y"), "radius"))
    want = rows(every.where(geo.distance(F.col("x"), F.col("y"), F.col("lon"), F.col("lat")) <= F.col("radius") * 1000), "request", "member")
    assert rows(geo.georadius(g, asked, "km"), "request", "member") == want


def test_streams(spark):
    x = spark.createDataFrame([("s", 5, 0, "a"), ("s", 5, 1, "b"), ("s", 9, 0, "c")], "key string, ms long, seq long, v string")
    new = spark.createDataFrame([("s", 9, 0, "d", 0), ("s", 9, 1, "e", 1), ("s", 8, 9, "f", 2), ("t", 0, 0, "g", 3), ("t", 0, 1, "h", 4)], "key string, ms long, seq long, v string, n int")
    table, refused = streams.xadd(x, new, "n")
    assert rows(table, "v") == [(c,) for c in "abceh"] and rows(refused, "v") == [("d",), ("f",), ("g",)]
    assert rows(streams.xrange(x, streams.in_ids((5, 0), (9, 0), open_low=True)), "v") == [("b",), ("c",)]
    assert rows(streams.xread(x, spark.createDataFrame([("s", 5, 0)], "key string, after_ms long, after_seq long"), 1), "v") == [("b",)]
    assert rows(streams.xtrim_len(x, 2), "v") == [("b",), ("c",)] and rows(streams.xtrim_id(x, (5, 1)), "v") == [("b",), ("c",)]
    assert streams.xinfo(x).first().asDict() == {"key": "s", "length": 3, "first_id": "5-0", "last_id": "9-0"}


def test_sketches(spark):
    one = sketches.pfadd(None, spark.createDataFrame([("k", str(i)) for i in range(5)], "key string, elem string"))
    two = sketches.pfadd(one, spark.createDataFrame([("k", str(i)) for i in range(3, 10)] + [("l", c) for c in "BCD"], "key string, elem string"))
    assert rows(sketches.pfcount(one)) == [("k", 5)] and rows(sketches.pfcount(two)) == [("k", 10), ("l", 3)]
    merged = sketches.pfmerge(two, spark.createDataFrame([("k", "l")], "dst string, key string"))
    assert rows(sketches.pfcount(merged)) == [("k", 13)]


def test_sketch_replies_of_large_sets(spark):
    elems = lambda key, first, last: spark.range(first, last, 1, 1).select(F.lit(key).alias("key"), F.col("id").cast("string").alias("elem"))
    every = lambda *some: reduce(DataFrame.union, [elems(*x) for x in some])
    old = sketches.pfadd(None, every(("same", 0, 60_000), ("few", 0, 60_000), ("one", 0, 60_000), ("more", 0, 60_000), ("small", 0, 9), ("grown", 0, 12_000)))
    new = every(("same", 0, 60_000), ("few", 100, 200), ("one", 7, 8), ("more", 59_000, 61_000), ("small", 2, 5), ("grown", 0, 20_000), ("none", 0, 3))
    assert rows(sketches.pfadd_replies(old, new)) == [("few", 0), ("grown", 1), ("more", 1), ("none", 1), ("one", 0), ("same", 0), ("small", 0)]
    again = sketches.pfadd_replies(sketches.pfadd(old, new).where("key = 'more'"), elems("more", 0, 61_000))
    assert rows(again) == [("more", 0)]


def test_pubsub(spark):
    m = spark.createDataFrame([(1, "news.a", "x"), (2, "b", "y"), (3, "none", "z")], "seq long, channel string, msg string")
    s = spark.createDataFrame([("c1", "news.*", True), ("c1", "news.a", False), ("c2", "?", True)], "client string, pattern string, is_glob boolean")
    assert dict(rows(pubsub.publish(m, s), "seq", "receivers")) == {1: 2, 2: 1, 3: 0}
    assert rows(pubsub.unsubscribe(s, spark.createDataFrame([("c1", None, True)], s.schema)), "client", "pattern") == [("c1", "news.a"), ("c2", "?")]


def test_transactions(spark):
    log = spark.createDataFrame([(1, 1, "SET", "a", 5), (2, 1, "INCRBY", "a", 2), (3, 2, "DEL", "a", 0), (4, 3, "INCRBY", "a", 7), (5, 3, "SET", "b", 1), (6, 4, "DEL", "b", 0)], "seq long, txn long, op string, key string, arg long")
    assert sorted(((r["seq"], r["value"]) for r in transactions.folded(log).collect()), key=lambda x: x[0]) == [(1, 5), (2, 7), (3, None), (4, 7), (5, 1), (6, None)]
    assert dict(rows(transactions.state(log))) == {"a": 7}
    watches = spark.createDataFrame([(3, "a", 2, 5), (4, "a", 5, 6)], "txn long, key string, watch_seq long, exec_seq long")
    refused = transactions.conflicts(watches, log.select("seq", "txn", "key"))
    assert rows(refused) == [(3,)]
    assert dict(rows(transactions.state(transactions.committed(log, refused, log.where("txn = 2"))))) == {"a": 7}


def test_slots(spark):
    names = ["123456789", "{tag}x", "a{tag}b{c}", "{}x", "{open", "plain", "x}y{z}"]
    got = {r["key"]: r["slot"] for r in spark.createDataFrame([(n,) for n in names], "key string").select("key", admin.slot(F.col("key")).alias("slot")).collect()}
    crc = lambda t: zlib.crc32(t.encode()) % 1024
    assert got == {"123456789": crc("123456789"), "{tag}x": crc("tag"), "a{tag}b{c}": crc("tag"), "{}x": crc(""), "{open": crc("{open"), "plain": crc("plain"), "x}y{z}": crc("z")}
