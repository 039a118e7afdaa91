"""Binary files: length-prefixed dumps of strings, and command logs in the wire format.

Both are read by ``binaryFile``, a file to a row; a file's records are found in
one pass. Damaged ends raise an error rather than lose records in silence.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pairs_of(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(key, value) records: each length is an unsigned little-endian 32-bit integer."""
    at = 0

    def field() -> bytes:
        nonlocal at
        (n,) = struct.unpack_from("<I", data, at)
        at += 4 + n
        if at > len(data):
            raise ValueError("the dump ends inside a record")
        return data[at - n : at]

    while at < len(data):
        yield field(), field()


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, key, value) of all dumps under a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = list(pairs_of(data.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), pa.array([k.decode() for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.binary())], ["file", "pos", "key", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, pos long, key string, value binary")


def packed(key: Column, value: Column) -> Column:
    """One record of a dump."""
    size = lambda c: F.unhex(F.concat(*[F.substring(F.lpad(F.hex(F.octet_length(c)), 8, "0"), 9 - 2 * i, 2) for i in (1, 2, 3, 4)]))
    raw = [c.cast("binary") for c in (key, value)]
    return F.concat(size(raw[0]), raw[0], size(raw[1]), raw[1])


def commands_of(data: bytes) -> Iterator[list[bytes]]:
    """Commands of a log: ``*n`` and then n times ``$length`` and the bytes, each ended by CRLF; inline lines are split at blanks."""
    at = 0

    def line() -> bytes:
        nonlocal at
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("the log ends inside a command")
        out, at = data[at:end], end + 2
        return out

    while at < len(data):
        head = line()
        if not head.startswith(b"*"):
            if head.split():
                yield head.split()
            continue
        args = []
        for _ in range(int(head[1:])):
            size = line()
            if not size.startswith(b"$"):
                raise ValueError("an argument has no length")
            n = int(size[1:])
            args.append(data[at : at + n])
            if data[at + n : at + n + 2] != b"\r\n":
                raise ValueError("the log ends inside a command")
            at += n + 2
        yield args


def read_commands(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, op, args): an operation log of all command logs under a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = list(commands_of(data.as_py()))
                text = [[a.decode("utf-8", "replace") for a in r] for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), pa.array([r[0].upper() for r in text], pa.string()), pa.array([r[1:] for r in text], pa.list_(pa.string()))], ["file", "pos", "op", "args"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, pos long, op string, args array<string>")


def as_commands(strings: DataFrame) -> DataFrame:
    """(command): strings as SET, or SETEX-like PXAT, commands in the wire format; a text sink with CRLF line ends makes a log of them."""
    word = lambda c: F.concat(F.lit("$"), F.octet_length(c).cast("string"), F.lit("\r\n"), c)
    plain = F.concat_ws("\r\n", F.lit("*3"), F.lit("$3\r\nSET"), word(F.col("key")), word(F.col("value")))
    timed = F.concat_ws("\r\n", F.lit("*5"), F.lit("$3\r\nSET"), word(F.col("key")), word(F.col("value")), F.lit("$4\r\nPXAT"), word(F.col("etime_ms").cast("string")))
    return strings.select(F.when(F.col("etime_ms").isNull(), plain).otherwise(timed).alias("command"))
