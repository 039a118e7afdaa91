"""Document fingerprints by winnowing, and their likeness to an edited and to the next document.

Every k-gram of code points gets a 44-bit rolling hash. In each window of ``w``
successive hashes the smallest is kept, the rightmost of equal ones, with its
position: so two texts that share ``w + k - 1`` characters share a fingerprint
entry, at the matching places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .util import asked, stored

K, WINDOW = 24, 77
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_POS_BITS = np.uint64(20)
#: Hashes that windows are slid over at once; a hash and its place among them share 64 bits meanwhile.
_SPAN = 1 << 20


def _powers(k: int) -> list[tuple[int, np.uint64]]:
    """(length, base ** length) of the doubling steps that make up k."""
    out, length = [], 1
    while length < k:
        add = min(length, k - length)
        out.append((add, np.uint64(pow(int(_BASE), add, 1 << 64))))
        length += add
    return out


def kgram_hashes(codes: np.ndarray, k: int = K) -> np.ndarray:
    """44-bit hashes of all k-grams of an array of code points; of the whole, if it is shorter."""
    k = min(k, len(codes))
    if not k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
        first = h
        done: dict[int, np.ndarray] = {1: first}
        length = 1
        for add, power in _powers(k):
            tail = done[add] if add in done else _grown(first, add)
            n = len(codes) - length - add + 1
            h = h[:n] * power + tail[length : length + n]
            length += add
            done[length] = h
        h ^= h >> np.uint64(31)
        h *= _MIX
        h ^= h >> np.uint64(29)
    return h >> _POS_BITS


def _grown(first: np.ndarray, k: int) -> np.ndarray:
    h, done, length = first, {1: first}, 1
    for add, power in _powers(k):
        tail = done[add] if add in done else _grown(first, add)
        n = len(first) - length - add + 1
        h = h[:n] * power + tail[length : length + n]
        length += add
        done[length] = h
    return h


def winnow(text: str, k: int = K, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The kept entries of a text in order: their 44-bit hashes, and their positions, whatever the text's length."""
    hashes = kgram_hashes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), k)
    n = len(hashes)
    if n == 0:
        return hashes, np.empty(0, np.int64)
    w = min(w, n)
    if w > _SPAN // 2:
        raise ValueError("the window is too wide")
    kept, places = [], []
    step = _SPAN - w + 1  # windows of one stretch have places that fit 20 bits
    for at in range(0, n - w + 1, step):
        part = hashes[at : at + step + w - 1]
        local = np.arange(len(part), dtype=np.uint64)
        key = (part << _POS_BITS) | (np.uint64(_SPAN - 1) - local)
        size = 1
        while size < w:
            add = min(size, w - size)
            key = np.minimum(key[: len(key) - add], key[add:])
            size += add
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        kept.append(key >> _POS_BITS)
        places.append((np.uint64(_SPAN - 1) - (key & np.uint64(_SPAN - 1))).astype(np.int64) + at)
    out, place = np.concatenate(kept), np.concatenate(places)
    new = np.concatenate(([True], place[1:] != place[:-1]))  # a stretch may begin with what the last one ended with
    return out[new], place[new]


def shown(entries: tuple[np.ndarray, np.ndarray]) -> str:
    """20 hex digits an entry: 12 of the hash, 8 of the position."""
    raw = np.empty((len(entries[0]), 10), np.uint8)
    raw[:, :6] = entries[0].astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    raw[:, 6:] = entries[1].astype(">u4").view(np.uint8).reshape(-1, 4)
    return raw.tobytes().hex()


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Jaccard similarity of two fingerprints' hashes; 1 for two empty ones."""
    one, two = np.unique(a[0]), np.unique(b[0])
    both = len(np.intersect1d(one, two, assume_unique=True))
    whole = len(one) + len(two) - both
    return both / whole if whole else 1.0


def edited(text: str, after: str) -> str:
    """The last floor(n/2) code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None  # (part, doc_id, text, entries)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    for batch in batches:
        rows, held = [], 0
        for part, tail, doc_id, text in zip(*(batch.column(c) for c in ("part", "tail", "doc_id", "text")), strict=True):
            part, tail, doc_id, text = part.as_py(), tail.as_py(), doc_id.as_py(), text.as_py() or ""
            if tail and (last is None or last[0] != part):
                continue  # of several first rows of the next part, the first one has served
            own = winnow(text)
            if last is not None and last[0] == part:
                new = edited(last[2], text)
                other = winnow(new)
                rows.append((last[1], len(last[2]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), shown(last[3]), shown(other), likeness(last[3], other), likeness(last[3], own)))
                held += 40 * (len(last[3][0]) + len(other[0]))
            last = None if tail else (part, doc_id, text, own)
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _part(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the descending bounds lie above the id: a binary search in the plan."""
    step, found = 1, F.lit(0)
    while step * 2 <= len(bounds):
        step *= 2
    steps = []
    while step:
        steps.append(step)
        step //= 2
    array = F.array(*map(F.lit, bounds))
    search = F.aggregate(F.array(*map(F.lit, steps)), found, lambda at, s: F.when((at + s <= len(bounds)) & (F.get(array, at + s - 1) > doc_id), at + s).otherwise(at))
    return search if bounds else F.lit(0)


#: Quantiles that ranges of ids are cut at; a range between two is cut evenly into as many cells as its bytes ask for.
QUANTILES = 4096


def _cells(rows: DataFrame, part_bytes: int) -> tuple[Column, int] | None:
    """A column that puts descending ids (``at``) into ascending cells of about ``part_bytes`` of text, and the number of cells; None for no rows."""
    size, least, most = rows.agg(F.sum(F.octet_length("text")), F.min("at"), F.max("at")).first()
    if size is None:
        return None
    cells = int(max(64, size // part_bytes))
    ranges = min(cells, QUANTILES)
    inner = -(-cells // ranges)
    cuts = rows.agg(F.percentile_approx("at", [i / ranges for i in range(1, ranges)] or [0.5], 10 * ranges).alias("c")).first()["c"]
    cuts = sorted(set(cuts), reverse=True)
    part = _part(F.col("at"), cuts)
    if inner == 1:
        return part, cells
    # Ids of part p are between the cuts p (not included) and p - 1: even steps from the upper end; casts and differences keep the order.
    ends = [float(most), *map(float, cuts), float(least)]
    upper, lower = (F.get(F.array(*map(F.lit, x)), part) for x in (ends[:-1], ends[1:]))
    step = F.floor((upper - F.col("at").cast("double")) / F.greatest(upper - lower, F.lit(1.0)) * inner)
    return part.cast("long") * inner + F.least(F.greatest(step, F.lit(0)), F.lit(inner - 1)), cells


def fingerprints(spark: SparkSession, docs: DataFrame, part_bytes: int = 16 << 20) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text) and of its edited text, and their likeness.

    Next: the document after this one by descending doc_id, the first after the
    last. Ids are cut into cells of about ``part_bytes`` of text; a cell's rows
    are worked through in order by one task, and the first row of each cell is
    also sent to the cell before it, so texts are shuffled once. Null texts are
    empty, and empty texts have empty fingerprints, which are like each other
    only; null ids come last; rows of equal ids are in the order of their texts'
    hashes; very long texts are fingerprinted whole, in stretches that join up;
    other columns of ``docs``, of whatever name, are left out; a table of one
    row is its own next; an empty one gives no rows.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("at"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = _cells(rows, part_bytes)
    if found is None:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    cell, cells = found
    heads = rows.groupBy(cell.cast("long").alias("part")).agg(F.max("at").alias("at"))
    in_order = W.orderBy("part")
    last = F.max("part").over(in_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    heads = stored(spark, heads.select("at", F.coalesce(F.lag("part").over(in_order), last).alias("part")), "winnow-heads")  # a row for each cell
    own = rows.select(cell.cast("long").alias("part"), F.lit(0).alias("tail"), "at", "doc_id", "text")
    after = asked(rows, heads, "at").where("_asked").drop("_asked").join(heads, "at").select("part", F.lit(1).alias("tail"), "at", "doc_id", "text")
    dealt = own.union(after).repartition(min(cells, 1 << 16), "part").sortWithinPartitions("part", "tail", F.desc("at"), F.xxhash64("text"))
    return dealt.drop("at").mapInArrow(_compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
