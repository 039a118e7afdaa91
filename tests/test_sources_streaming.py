"""Files in and out, and streams driven to their end."""

import datetime
import struct

import pytest
from pyspark.sql import functions as F

from keystrata.sources import dumps, snapshots
from keystrata.streaming import logs, waiting


def test_snapshot(spark, tmp_path):
    df = spark.createDataFrame([("k", "a")], "key string, member string")
    snapshots.save({"sets": df}, f"file://{tmp_path}/s")
    assert snapshots.load(spark, f"file://{tmp_path}/s", "sets")["sets"].collect() == df.collect()


def test_length_prefixed_dump(spark, tmp_path):
    pairs = [(b"a", b"1"), ("é".encode(), bytes(range(256)) * 2), (b"", b"")]
    data = b"".join(struct.pack("<I", len(k)) + k + struct.pack("<I", len(v)) + v for k, v in pairs)
    (tmp_path / "d").write_bytes(data)
    got = dumps.read_pairs(spark, f"file://{tmp_path}/d").orderBy("pos").collect()
    assert [(r["key"].encode(), bytes(r["value"])) for r in got] == pairs
    again = b"".join(bytes(r[0]) for r in dumps.read_pairs(spark, f"file://{tmp_path}/d").orderBy("pos").select(dumps.packed(F.col("key"), F.col("value"))).collect())
    assert again == data
    with pytest.raises((ValueError, struct.error)):
        list(dumps.pairs_of(data[:-2]) if data[-8:] != bytes(8) else dumps.pairs_of(data[:-6]))


def test_command_log(spark, tmp_path):
    strings = spark.createDataFrame([("k", "v\r\nw", None), ("é", "", 99)], "key string, value string, etime_ms long")
    dumps.as_commands(strings).coalesce(1).write.option("lineSep", "\r\n").text(f"file://{tmp_path}/log")
    got = dumps.read_commands(spark, f"file://{tmp_path}/log/part-*").orderBy("pos").collect()
    assert [(r["op"], r["args"]) for r in got] == [("SET", ["k", "v\r\nw"]), ("SET", ["é", "", "PXAT", "99"])]
    assert list(dumps.commands_of(b"PING x\r\n*1\r\n$4\r\nQUIT\r\n")) == [[b"PING", b"x"], [b"QUIT"]]
    with pytest.raises(ValueError):
        list(dumps.commands_of(b"*2\r\n$3\r\nGET\r\n$9\r\nab"))


def run(query):
    query.processAllAvailable()
    query.stop()


def test_tail_and_windows(spark, tmp_path):
    schema = "key string, ms long, seq long"
    spark.createDataFrame([("a", 1000, 0), ("a", 61_000, 0), ("b", 2000, 0)], schema).write.parquet(f"{tmp_path}/x")
    entries = logs.tail(spark, f"{tmp_path}/x", schema)
    cursors = spark.createDataFrame([("a", 1000, 0)], "key string, after_ms long, after_seq long")
    run(logs.after(entries, cursors).writeStream.format("memory").queryName("above").start())
    assert sorted(map(tuple, spark.sql("select key, ms from above").collect())) == [("a", 61_000), ("b", 2000)]
    run(logs.counts(entries, "1 minute", "0 seconds").writeStream.format("memory").outputMode("complete").queryName("counted").start())
    assert sorted(map(tuple, spark.sql("select key, n from counted").collect())) == [("a", 1), ("a", 1), ("b", 1)]
    assert logs.sessions(entries, "5 minutes", "0 seconds").isStreaming


def test_delivery_and_latest_values(spark, tmp_path):
    spark.createDataFrame([(1, "view", "m"), (2, "other", "m")], "seq long, channel string, msg string").write.parquet(f"{tmp_path}/m")
    subs = spark.createDataFrame([("c", "v*", True)], "client string, pattern string, is_glob boolean")
    logs.deliver(logs.tail(spark, f"{tmp_path}/m", "seq long, channel string, msg string"), subs, f"{tmp_path}/out", f"{tmp_path}/ck1").awaitTermination()
    assert [(r["seq"], r["client"]) for r in spark.read.parquet(f"{tmp_path}/out/batch=0").collect()] == [(1, "c")]
    schema = "seq long, key string, value string"
    spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z")], schema).write.parquet(f"{tmp_path}/u")
    logs.keep(logs.tail(spark, f"{tmp_path}/u", schema), f"{tmp_path}/t", f"{tmp_path}/ck2").awaitTermination()
    spark.createDataFrame([(4, "b", None), (5, "c", "w")], schema).write.mode("append").parquet(f"{tmp_path}/u")
    logs.keep(logs.tail(spark, f"{tmp_path}/u", schema), f"{tmp_path}/t", f"{tmp_path}/ck2").awaitTermination()
    assert sorted((r["key"], r["value"]) for r in spark.read.parquet(f"{tmp_path}/t/version=1").collect()) == [("a", "y"), ("b", None), ("c", "w")]


def test_blocking_pops(spark, tmp_path):
    at = lambda ms: datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=ms)
    base = 1_704_067_200_000
    schema = "key string, seq long, ms long, at timestamp, kind string, value string, request string, until_ms long"
    log = [("k", 1, base, at(0), "pop", None, "r1", base + 50), ("k", 2, base + 1, at(1), "pop", None, "r2", base + 900), ("k", 3, base + 100, at(100), "push", "v", None, None), ("k", 4, base + 101, at(101), "push", "w", None, None), ("k", 5, base + 102, at(102), "pop", None, "r3", base + 500)]
    spark.createDataFrame(log, schema).coalesce(1).write.parquet(f"{tmp_path}/log")
    entries = spark.readStream.schema(schema).parquet(f"{tmp_path}/log")
    run(waiting.served(entries).writeStream.format("memory").outputMode("append").queryName("popped").start())
    assert sorted((r["request"], r["value"], r["reply"]) for r in spark.sql("select * from popped").collect() if r["value"]) == [("r2", "v", "popped"), ("r3", "w", "popped")]
    assert [r["request"] for r in spark.sql("select * from popped where reply = 'timeout'").collect()] == ["r1"]


def test_operation_logs(spark, tmp_path):
    import random

    from keystrata.sources import oplogs

    rng = random.Random(3)
    command = lambda *a: f"*{len(a)}\r\n".encode() + b"".join(b"$%d\r\n%s\r\n" % (len(x), x) for x in a)
    commands = [[b"set", b"k%d" % i, bytes(rng.choice(b"abc") for _ in range(rng.choice([3, 3, 500, 150_000])))] for i in range(40)]
    items = [struct.pack(oplogs.ITEM, 1, 1000 + i, 2, i, 7, 64 * i, len(command(*c))) + command(*c) for i, c in enumerate(commands)]
    data = oplogs.fragments_of(items)
    assert list(oplogs.items_of(data)) == items and list(oplogs.items_of(data + bytes(100))) == items
    (tmp_path / "write2file7").write_bytes(data)
    got = oplogs.read_items(spark, f"file://{tmp_path}").orderBy("pos").collect()
    assert [(r["op"], *r["args"]) for r in got] == [("SET", k.decode(), v.decode()) for _, k, v in commands]
    assert [(r["exec_time"], r["term"], r["logic_id"], r["filenum"], r["offset"]) for r in got] == [(1000 + i, 2, i, 7, 64 * i) for i in range(40)]
    for bad in (data[:-5], data[: len(data) // 2 + 3]):
        with pytest.raises(ValueError):
            list(oplogs.items_of(bad))


def test_status_texts_as_metrics(spark):
    from keystrata.sources import oplogs

    text = "# Server\r\nversion:3.5.1\r\nuptime:12\r\n\r\n# Memory\nused:10.5M\nratio: 7 %\n\n# Keyspace\ndb0:keys=5,expires=2\nnote:a:b\n"
    df = spark.createDataFrame([("h1", text), ("h2", "x:1"), ("h3", None), ("h4", "")], "host string, text string")
    got = list(tuple(r) for r in oplogs.metrics(df).collect() if r["host"] == "h1")
    assert {(s, n, f, v) for _, s, n, f, v, _ in got} == {("Server", "version", None, None), ("Server", "uptime", None, 12.0), ("Memory", "used", None, 10.5), ("Memory", "ratio", None, 7.0), ("Keyspace", "db0", "keys", 5.0), ("Keyspace", "db0", "expires", 2.0), ("Keyspace", "note", None, None)}
    assert [tuple(r) for r in oplogs.metrics(df).where("host <> 'h1'").collect()] == [("h2", None, "x", None, 1.0, "1")]
