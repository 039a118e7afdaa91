"""WARC files: a writer over Spark's text sink, and a reader that salvages damaged archives.

The writer makes one row of a record, a gzip member of its own, and lets Spark
write the rows, so archives appear by Spark's commit protocol in any store; the
line ends that the sink puts between rows are gzip members without content. The reader checks
each record's lengths and digests; after a failed check it looks for the next
version line, or the next gzip member, that starts a good record, and logs the
bytes between as a quarantined gap.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import new_path, stored

VERSION = b"WARC/1.0"
_START = re.compile(rb"WARC/1\.[01]\r\n")
_END = b"\r\n\r\n"
_GZIP = b"\x1f\x8b\x08"
#: Bytes that are unpacked at once.
STEP = 1 << 14


@dataclass
class Record:
    """A record that passed its checks; offset and length in the (unpacked) archive."""

    headers: dict[str, str]
    block: bytes
    offset: int
    length: int


@dataclass
class Gap:
    """Bytes that belong to no good record."""

    offset: int
    length: int
    reason: str


@dataclass
class Salvage:
    records: list[Record] = field(default_factory=list)
    gaps: list[Gap] = field(default_factory=list)


def parsed(data: bytes, at: int) -> Record | str:
    """The record at an offset, or why there is none."""
    if not _START.match(data, at):
        return "no version line"
    head_end = data.find(_END, at)
    if head_end < 0:
        return "headers have no end"
    headers: dict[str, str] = {}
    for line in data[at:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            return "a header has no name"
        headers[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    try:
        size = int(headers["content-length"])
    except (KeyError, ValueError):
        return "no content length"
    if size < 0:
        return "no content length"
    begin = head_end + len(_END)
    end = begin + size
    if data[end : end + len(_END)] != _END:
        return "the block doesn't end where its length says"
    block = data[begin:end]
    digest = headers.get("warc-block-digest", "")
    if digest.lower().startswith("sha256:") and digest[7:].lower() != hashlib.sha256(block).hexdigest():
        return "the block's digest differs"
    return Record(headers, block, at, end + len(_END) - at)


def _plain(data: bytes, out: Salvage, base: int = 0) -> None:
    at = 0
    while at < len(data):
        got = parsed(data, at)
        if isinstance(got, Record):
            out.records.append(Record(got.headers, got.block, base + at, got.length))
            at += got.length
            continue
        start = at
        while True:  # the next version line that starts a good record
            found = _START.search(data, at + 1)
            at = found.start() if found else len(data)
            if not found or isinstance(parsed(data, at), Record):
                break
        out.gaps.append(Gap(base + start, at - start, got))


def _unpacked(data: bytes, at: int) -> tuple[bytes, int, str]:
    """(content, end, "") of the gzip member at an offset; of a broken one, all that can be unpacked, where that ends, and what is wrong."""
    member, parts, to = zlib.decompressobj(31), [], at
    try:
        while not member.eof and to < len(data):  # in steps, since what is left over is copied
            parts.append(member.decompress(data[to : to + STEP]))
            to = min(to + STEP, len(data))
    except zlib.error as e:
        # A step that fails gives nothing: once more from the start, and this step by the byte.
        member = zlib.decompressobj(31)
        parts = [member.decompress(data[k : k + STEP]) for k in range(at, to, STEP)]
        try:
            while to < len(data):
                parts.append(member.decompress(data[to : to + 1]))
                to += 1
        except zlib.error:
            pass
        return b"".join(parts), to, str(e)
    if not member.eof:
        return b"".join(parts) + member.flush(), len(data), "the member has no end"
    return b"".join(parts), to - len(member.unused_data), ""


def _trusted(inner: Salvage, size: int, reason: str) -> list[Record]:
    """The records of a broken member's content that count.

    Digests don't cover headers: if the member's checksum fails and no record
    does, some record's headers are wrong, and which can't be told. A record at
    the very end of a member whose end is missing isn't counted either.
    """
    if "incorrect" in reason and "check" in reason and not inner.gaps:
        return []
    return [r for r in inner.records if reason != "the member has no end" or r.offset + r.length < size]


def salvaged(data: bytes) -> Salvage:
    """All good records of an archive's bytes, and the gaps between them.

    At each place a gzip member or a plain record may follow, whatever the
    archive begins with. After one that is damaged, the search goes on at the
    next member that can be unpacked or version line that starts a good record,
    whichever comes first, and the bytes between are a gap. Records inside a
    member are salvaged like a plain archive; so are those in what a broken
    member had unpacked before it broke, though its bytes stay a gap. Offsets of
    records in a member are those of the member. An empty archive has neither.
    """
    out = Salvage()
    at, bad_from, why = 0, None, ""
    next_member, next_line = -1, -1
    told: list[Record] = []  # judged in a broken member; stored blocks show the same bytes again
    told_to = 0
    while at < len(data):
        found, length = Salvage(), 0
        if data.startswith(_GZIP, at):
            content, end, reason = _unpacked(data, at)
            inner = Salvage()
            _plain(content, inner)
            if not reason:
                length = end - at
                found.records = [Record(r.headers, r.block, at, length) for r in inner.records]
                found.gaps = [Gap(at, length, g.reason) for g in inner.gaps]
            else:
                out.records += [Record(r.headers, r.block, at, end - at) for r in _trusted(inner, len(content), reason)]
                told, told_to = (told if at < told_to else []) + inner.records, max(told_to, end)
        else:
            got = parsed(data, at)
            if isinstance(got, str):
                reason = got
            elif at < told_to and any(r.headers == got.headers and r.block == got.block for r in told):
                reason = "a record of a broken member"
            else:
                found.records, length = [got], got.length
        if length:
            if bad_from is not None:
                out.gaps.append(Gap(bad_from, at - bad_from, why))
                bad_from = None
            out.records += found.records
            out.gaps += found.gaps
            at += length
            continue
        if bad_from is None:
            bad_from, why = at, reason
        if next_member <= at:
            k = data.find(_GZIP, at + 1)
            next_member = len(data) if k < 0 else k
        if next_line <= at:
            m = _START.search(data, at + 1)
            next_line = m.start() if m else len(data)
        at = min(next_member, next_line)
    if bad_from is not None:
        out.gaps.append(Gap(bad_from, at - bad_from, why))
    return out


def _header(value: Column) -> Column:
    """A value that can't break its line."""
    return F.regexp_replace(value, r"[\x00-\x1F\x7F]", " ")


def records(spark: SparkSession, pages: DataFrame, least_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(page_id, record): a WARC record, as text, for every row of ``pages`` (page_id, url, html).

    Of equal payloads of ``least_bytes`` or more, the record of the smallest
    page_id carries the payload and the others revisit it; only digests and ids
    are grouped. Null html is an empty payload; null ids and urls leave their
    header out, and a null id doesn't count as smallest beside others; rows that
    repeat id and payload are written as often as they occur, each like the
    other; a table without rows gives none.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.octet_length(payload).cast("long").alias("n"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    slim = stored(spark, rows.where(F.col("n") >= least_bytes).select("page_id", "digest").distinct(), "warc-digests")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    revisits = slim.join(first, "digest").where("page_id is null or page_id <> refers_to").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to")
    rows = rows.join(revisits, rows["page_id"].eqNullSafe(revisits["p"]) & (rows["digest"] == revisits["d"]) & (rows["n"] >= least_bytes), "left")
    again = F.col("refers_to").isNotNull()
    block = F.when(again, F.lit("")).otherwise(F.col("html"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    uuid = lambda c: F.regexp_replace(F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    head = F.concat_ws(
        "\r\n",
        F.lit(VERSION.decode()),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), uuid(F.col("page_id")), F.lit(">"))),
        F.lit(f"WARC-Date: {date}"),
        line("WARC-Target-URI", _header(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        F.when(again, line("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), uuid(F.col("refers_to")), F.lit(">")))),
        F.when(again, line("X-Refers-To-Page", F.col("refers_to").cast("string"))),
        line("X-Page", F.col("page_id").cast("string")),
        line("X-Payload-Length", F.col("n").cast("string")),
        F.lit("Content-Type: text/html"),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    return rows.select("page_id", F.concat(head, F.lit("\r\n\r\n"), block, F.lit("\r\n")).alias("record"))


#: A gzip member without content.
NOTHING = b"\x1f\x8b\x08\0\0\0\0\0\0\xff\x03\0\0\0\0\0\0\0\0\0"


def member(record: bytes) -> bytes:
    """One gzip member, the same bytes for the same record."""
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def written(spark: SparkSession, made: DataFrame, path: str, file_bytes: int = 32 << 20) -> str:
    """Write records under ``path`` to archives that end with the record that fills ``file_bytes``: a reader's task holds one archive at a time."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        volume = size = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                members, volumes = [], []
                for r in whole.slice(at, 256).column(0):
                    members.append(member(r.as_py().encode("utf-8", "surrogatepass") + b"\r\n"))
                    volumes.append(volume)
                    size += len(members[-1])
                    if size >= file_bytes:
                        volume, size = volume + 1, 0
                yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary()), pa.array(volumes, pa.int32())], ["record", "volume"])

    out = made.select("record").mapInArrow(packed, "record binary, volume int").select(F.col("record").cast("string"), "volume")
    out.write.option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1")).partitionBy("volume").text(path)
    return path


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, gaps) of all archives under ``path``.

    records: page_id, payload_bytes, payload_digest, record_type, refers_to,
    block, file, offset; a response's payload digest is checked against its
    block, and one that differs is a gap. gaps: file, offset, length, reason.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, block binary, file string, offset long, gap long, reason string"
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def rows(file: str, data: bytes):
        got = salvaged(data)
        for r in got.records:
            h = r.headers
            kind, digest = h.get("warc-type"), h.get("warc-payload-digest", "")[7:]
            number = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
            if kind == "response" and digest != hashlib.sha256(r.block).hexdigest():
                yield None, None, None, None, None, None, file, r.offset, r.length, "the payload's digest differs"
                continue
            yield number("x-page"), number("x-payload-length") if kind == "revisit" else len(r.block), digest, kind, number("x-refers-to-page"), r.block, file, r.offset, None, None
        for g in got.gaps:
            yield None, None, None, None, None, None, file, g.offset, g.length, g.reason

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = list(rows(file, data.as_py()))
                for at in range(0, len(found), 256):
                    part = found[at : at + 256]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names)

    out = files.mapInArrow(parse, schema)
    return out.where("gap is null").drop("gap", "reason"), out.where("gap is not null").select("file", "offset", F.col("gap").alias("length"), "reason")


def round_trip(spark: SparkSession, pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archives of ``pages`` and read them back."""
    got, _ = read(spark, written(spark, records(spark, pages), path or new_path(spark, "warc")))
    return got
