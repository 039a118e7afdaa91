"""Binary operation logs, and status texts as metrics."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dumps import commands_of

# Fixed values of the format: bytes of a block; a fragment's head (length in 3
# bytes, time in 4, kind in 1); kinds of fragments; an item's head (type, time,
# term, logic id, file number, offset, length; little-endian).
BLOCK = 64 * 1024
HEAD = 8
WHOLE, FIRST, MIDDLE, LAST = 1, 2, 3, 4
ITEM = "<HIIQIQI"


def items_of(data: bytes) -> Iterator[bytes]:
    """Items of a log: fragments never cross a block, and what a block has no room for a head in is skipped. A fragment of no kind or length ends the log."""
    at, parts = 0, None
    while at < len(data):
        room = BLOCK - at % BLOCK
        if room <= HEAD:
            at += room
            continue
        if at + HEAD > len(data):
            raise ValueError("the log ends inside a fragment")
        size, kind = int.from_bytes(data[at : at + 3], "little"), data[at + HEAD - 1]
        if not kind or not size:
            break
        if size > room - HEAD or at + HEAD + size > len(data):
            raise ValueError("a fragment is longer than its block or log")
        body = data[at + HEAD : at + HEAD + size]
        at += HEAD + size
        if kind not in (WHOLE, FIRST, MIDDLE, LAST):
            parts = None  # marked as bad by the writer
        elif kind in (WHOLE, FIRST):
            parts = [body]
        elif parts is not None:
            parts.append(body)
        if kind in (WHOLE, LAST) and parts is not None:
            yield b"".join(parts)
            parts = None
    if parts is not None:
        raise ValueError("the log ends inside an item")


def fragments_of(items: list[bytes], time: int = 0) -> bytes:
    """The log of some items; the reverse of :func:`items_of`."""
    out = bytearray()
    for item in items:
        at, first = 0, True
        while first or at < len(item):
            room = BLOCK - len(out) % BLOCK
            if room <= HEAD:
                out += bytes(room)
                continue
            body = item[at : at + room - HEAD]
            at += len(body)
            kind = (WHOLE if at == len(item) else FIRST) if first else (LAST if at == len(item) else MIDDLE)
            out += len(body).to_bytes(3, "little") + time.to_bytes(4, "little") + bytes([kind]) + body
            first = False
    return bytes(out)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, exec_time, term, logic_id, filenum, offset, op, args) of all operation logs under a path, a row for each command.

    A file is one row to a task, which logs, being cut by size, allow; damaged
    files raise an error.
    """
    schema = "file string, pos long, exec_time long, term long, logic_id long, filenum long, offset long, op string, args array<string>"
    types = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.list_(pa.string())]
    names = [f.split()[0] for f in schema.split(", ")]

    def rows(file: str, data: bytes):
        pos = 0
        for item in items_of(data):
            if len(item) < struct.calcsize(ITEM):
                raise ValueError("an item has no head")
            _, exec_time, term, logic_id, filenum, offset, size = struct.unpack_from(ITEM, item)
            if len(item) != struct.calcsize(ITEM) + size:
                raise ValueError("an item's length differs")
            for command in commands_of(item[struct.calcsize(ITEM) :]):
                text = [a.decode("utf-8", "replace") for a in command]
                yield file, pos, exec_time, term, logic_id, filenum, offset, text[0].upper(), text[1:]
                pos += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = list(rows(file, data.as_py()))
                for at in range(0, len(found), 1 << 14):
                    some = zip(*found[at : at + (1 << 14)], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(some, types, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def metrics(texts: DataFrame, text: str | Column = "text") -> DataFrame:
    """``texts``' other columns with (section, name, field, value, label): status texts, ``# Section`` lines and ``name:value`` ones, as metrics.

    A value of ``a=1,b=2`` is a row for each field, else ``field`` is null.
    ``value`` is the number at its beginning (a unit or percent sign behind it
    is left out), null for other text; ``label`` is the text itself.
    """
    source = F.col(text) if isinstance(text, str) else text
    lines = F.posexplode(F.split(source, r"\r?\n"))
    keep = [c for c in texts.columns if c != text]
    # A line's section is the last heading before it in its own text.
    heads = F.transform(F.split(source, r"\r?\n"), lambda line: F.when(line.rlike(r"^#\s*\S"), F.trim(F.regexp_replace(line, r"^#\s*", ""))))
    section = F.element_at(F.filter(F.slice("_heads", F.lit(1), F.col("_at") + 1), lambda h: h.isNotNull()), -1)
    rows = texts.select(*keep, heads.alias("_heads"), lines.alias("_at", "_line")).withColumn("section", F.when(F.exists(F.slice("_heads", F.lit(1), F.col("_at") + 1), lambda h: h.isNotNull()), section))
    rows = rows.where(F.col("_line").rlike(r"^[^#:\s][^:]*:")).withColumn("name", F.trim(F.regexp_extract("_line", r"^([^:]*):", 1))).withColumn("label", F.trim(F.regexp_extract("_line", r"^[^:]*:(.*)$", 1)))
    fields = F.when(F.col("label").rlike(r"^[^=,]+=[^=,]*(,[^=,]+=[^=,]*)*$"), F.transform(F.split("label", ","), lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("field"), F.substring_index(p, "=", -1).alias("label"))))
    one = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.col("label").alias("label")))
    rows = rows.select(*keep, "section", "name", F.explode(F.coalesce(fields, one)).alias("_f"))
    number = F.regexp_extract("_f.label", r"^\s*([-+]?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)(?:\s*[A-Za-z%]*)\s*$", 1)
    return rows.select(*keep, "section", "name", "_f.field", number.try_cast("double").alias("value"), "_f.label")
