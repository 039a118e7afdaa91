"""Removal of repeated strings and passages, by suffix arrays.

Each string of ``length`` bytes has an anchor: the smallest hash among its
``gram``-byte substrings, the rightmost of equal ones. Equal strings have equal
anchors, so only texts around anchors that occur twice can hold repeats. The
successive strings of one anchor occurrence are one fragment; equal fragments
are counted, not compared. The distinct fragments of an anchor meet in one
task, where a suffix array of many anchors' fragments shows which strings
repeat. An anchor with more fragments than a task should hold is dealt again:
its strings go by where they start before the anchor, in ranges of ``WIDTH``
places, and by the bytes that all strings of a range hold, so equal strings
still meet; what is too much even then goes by ranges of one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shingles import mixed
from .suffixes import block_ranks, common_prefixes, suffix_array
from .util import asked, dropped, stored

#: Text that a task works on at once.
BATCH_BYTES = 1 << 19
_POS_BITS = np.uint64(24)
_rng = np.random.default_rng(20240202)
_BYTE = [_rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_STEP = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95]
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        with np.errstate(over="ignore"):
            _powers[base] = np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(max(n, 1 << 19), np.uint64(base % 2**64)))))
    return _powers[base]


class Hashes:
    """Hashes of any substrings of some bytes, by prefix sums; which: one of two functions."""

    def __init__(self, flat: np.ndarray, which: int):
        self.step = _STEP[which]
        self.back = pow(self.step, -1, 1 << 64)
        n = len(flat)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[which][flat] * _power(self.step, n)[:n], out=self.total[1:])
        self.down = _power(self.back, n + 1)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[begin]) * self.down[begin])

    def all(self, size: int) -> np.ndarray:
        n = len(self.total) - size
        return mixed((self.total[size:] - self.total[:n]) * self.down[:n])


def fragments(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, start, strings, anchor, hash 1, hash 2) of all fragments: runs of successive strings with one anchor."""
    flat = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    empty = np.empty(0, np.int64)
    if len(flat) < length:
        return (empty,) * 3 + (np.empty(0, np.uint64),) * 3
    one, two = Hashes(flat, 0), Hashes(flat, 1)
    grams = one.all(gram)
    key = ((grams >> _POS_BITS) << _POS_BITS) | (np.uint64((1 << 24) - 1) - np.arange(len(grams), dtype=np.uint64))
    size, wide = 1, length - gram + 1
    while size < wide:
        add = min(size, wide - size)
        key = np.minimum(key[: len(key) - add], key[add:])
        size += add
    at = ((1 << 24) - 1) - (key & np.uint64((1 << 24) - 1)).astype(np.int64)  # each string's anchor place
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    whole = np.arange(len(at)) + length <= ends[owner]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new & whole)
    # A fragment ends before the next one's first string, or with its text.
    count = np.minimum(np.append(begin[1:], len(flat)), ends[owner[begin]] - length + 1) - begin
    a = at[begin]
    stop = begin + count - 1 + length
    return owner[begin], begin - (ends - sizes)[owner[begin]], count, one.of(a, a + gram), one.of(begin, stop), two.of(begin, stop)


def _slices(whole: pa.RecordBatch):
    """(place, texts as bytes) of slices of about BATCH_BYTES: no more of a batch is unpacked at once."""
    text = whole.column("text")
    size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH_BYTES, side="right")))
        yield at, [t or b"" for t in text.slice(at, stop - at).to_pylist()]
        at = stop


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _found(length: int, gram: int):
    slab = (1 << 24) - 1 - 4 * length - BATCH_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "h", "start", "n", "anchor", "f1", "f2"]
        for whole in batches:
            ids, hs = whole.column("id").to_numpy(zero_copy_only=False), whole.column("h").to_numpy(zero_copy_only=False)
            for at, raw in _slices(whole):
                # A text longer than positions allow goes in overlapping parts; a string is in one of them only.
                parts = [(i, o, t[o : o + slab + length - 1]) for i, t in enumerate(raw) for o in range(0, max(1, len(t) - length + 1), slab)]
                for some in ([parts] if len(parts) == len(raw) else [[p] for p in parts]):
                    row, start, n, anchor, f1, f2 = fragments([p[2] for p in some], length, gram)
                    if not len(row):
                        continue
                    of = np.array([p[0] for p in some])[row] + at
                    start = start + np.array([p[1] for p in some])[row]
                    arrays = [ids[of], hs[of], start, n, anchor.view(np.int64), f1.view(np.int64), f2.view(np.int64)]
                    for k in range(0, len(of), 1 << 15):
                        yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 15)].astype(np.int64)) for x in arrays], names)

    return run


def repeated_strings(texts: list[bytes], counts: list[int], weights: list[int], length: int) -> list[np.ndarray]:
    """Per fragment, which of its first ``counts`` strings also start elsewhere in the fragments; a fragment counts as often as its weight."""
    flat = np.frombuffer(b"".join(texts), np.uint8)
    blocks = block_ranks(flat, length)
    order = suffix_array(flat, length, blocks)
    lcp = common_prefixes(flat, order, length, blocks)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    weight = np.zeros(len(flat), np.int64)
    for b, n, w in zip(begin, counts, weights, strict=True):
        weight[b : b + n] = w
    run = np.cumsum(lcp < length) - 1
    total = np.bincount(run, weight[order])
    again = np.zeros(len(flat), bool)
    again[order] = total[run] >= 2
    return [again[b : b + n] for b, n in zip(begin, counts, strict=True)]


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()


def _judged(length: int):
    """Fragments of whole anchors to their repeated runs, many anchors to one suffix array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def judge(rows):
            marks = repeated_strings([r[5] for r in rows], [r[3] for r in rows], [r[4] for r in rows], length)
            out = [(*r[:3], *_runs(m)) for r, m in zip(rows, marks, strict=True) if m.any()]
            if out:
                types = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["anchor", "f1", "f2", "at", "len"])

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("anchor", "f1", "f2", "n", "weight", "text")), strict=True):
                if size >= BATCH_BYTES and r[0] != held[-1][0]:
                    yield from judge(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[5])
        if held:
            yield from judge(held)

    return run


def _pieces(length: int, gram: int, width: int):
    """Fragments to pieces: runs of strings that start in one range of ``width`` places before the anchor, under a hash of what all strings of the range hold.

    Columns: the fragment, the piece's first string in it (off) and strings (n),
    and as the piece's own key the group g and two hashes of its bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "f1", "f2", "weight", "off", "n", "g", "p1", "p2"]
        for b in batches:
            for anchor, f1, f2, n, weight, text in zip(*(b.column(c).to_pylist() for c in ("anchor", "f1", "f2", "n", "weight", "text")), strict=True):
                flat = np.frombuffer(text, np.uint8)
                one, two = Hashes(flat, 0), Hashes(flat, 1)
                first = np.arange(n)
                core = (first, first + length)
                if width > 1:
                    grams = one.all(gram)[: length - gram + 1] >> _POS_BITS
                    at = len(grams) - 1 - int(grams[::-1].argmin())  # the rightmost of the smallest, as in fragments()
                    range_ = (at - first) // width
                    first = np.flatnonzero(np.append(True, range_[1:] != range_[:-1]))
                    high = at - range_[first] * width  # the last place of the range
                    core = (high, high - width + 1 + length)
                size = np.diff(np.append(first, n))
                g = one.of(*core) ^ mixed((core[0] - first if width == 1 else at - high).astype(np.uint64))
                stop = first + size - 1 + length
                same = [np.full(len(first), v, np.int64) for v in (anchor, f1, f2, weight)]
                hashes = [x.view(np.int64) for x in (g, one.of(first, stop), two.of(first, stop))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*same, first, size, *hashes)], names)

    return run


#: Places before the anchor that are one range when a large anchor is dealt again.
WIDTH = 16
_KEY = ["anchor", "f1", "f2"]


def _marks(spark: SparkSession, texts: DataFrame, length: int, gram: int, most: int, width: int = WIDTH) -> DataFrame:
    """(anchor, f1, f2, at, len): the repeated runs of the fragments of ``texts`` (anchor, f1, f2, n, weight, kinds, text); ``kinds``: how many the anchor has."""
    fields = [*_KEY, "n", "weight", "text"]
    few = texts.where(F.col("kinds") <= most).select(*fields).repartition("anchor").sortWithinPartitions("anchor")
    out = few.mapInArrow(_judged(length), "anchor long, f1 long, f2 long, at array<long>, len array<long>")
    many = texts.where(F.col("kinds") > most)
    if not many.limit(1).count():
        return out
    parts = stored(spark, many.select(*fields).mapInArrow(_pieces(length, gram, width), "anchor long, f1 long, f2 long, weight long, off long, n long, g long, p1 long, p2 long"), "suffix-pieces")
    groups = stored(spark, parts.groupBy("g").agg(F.sum("weight").alias("w")).where("w > 1").select("g"), "suffix-groups")
    parts = stored(spark, parts.join(groups, "g"), "suffix-pieces")
    kinds = parts.groupBy("g", "p1", "p2").agg(F.sum("weight").alias("weight"), F.first("n").alias("n"), F.min(F.struct(*_KEY, "off")).alias("rep"))
    kinds = stored(spark, kinds, "suffix-piece-kinds")
    found = kinds.where("weight > 1").select("g", "p1", "p2", F.array(F.lit(0).cast("long")).alias("at"), F.array("n").alias("len"))
    if width > 1:  # else the strings of a group are equal
        several = stored(spark, kinds.groupBy("g").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "suffix-several")
        hard = kinds.join(several, "g").select(F.col("g").alias("_g"), "p1", "p2", F.col("n").alias("_n"), F.col("weight").alias("_w"), F.col("kinds").alias("_kinds"), "rep.*")
        cut = F.substring("text", (F.col("off") + 1).cast("int"), (F.col("_n") + length - 1).cast("int"))
        own = stored(spark, hard.join(many.select(*_KEY, "text"), _KEY).select(F.col("_g").alias("anchor"), F.col("p1").alias("f1"), F.col("p2").alias("f2"), F.col("_n").alias("n"), F.col("_w").alias("weight"), F.col("_kinds").alias("kinds"), cut.alias("text")), "suffix-piece-texts")
        found = found.union(_marks(spark, own, length, gram, most, 1))
    of_parts = parts.select(*_KEY, "off", "g", "p1", "p2").join(stored(spark, found, "suffix-piece-marks"), ["g", "p1", "p2"])
    return out.union(of_parts.select(*_KEY, F.transform("at", lambda a: a + F.col("off")).alias("at"), "len"))


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts as bytes under (id, h), which tells rows of one doc_id but different texts apart."""
    return docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))


def spans(spark: SparkSession, rows: DataFrame, length: int, gram: int, most: int = 1024) -> DataFrame:
    """(id, h, at, len): runs of strings of ``length`` bytes, by first start and number, that also start elsewhere in ``rows`` (id, h, text as bytes).

    ``most``: distinct fragments of an anchor, or of a part of it, that meet in
    one task; it bounds memory, and the result doesn't depend on it.
    """
    every = stored(spark, rows.mapInArrow(_found(length, gram), "id long, h long, start long, n long, anchor long, f1 long, f2 long"), "suffix-fragments")
    # Tables of keys are written before they are joined: Spark can then split a large key's side of the join.
    twice = stored(spark, every.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor"), "suffix-twice")
    shared = stored(spark, every.join(twice, "anchor"), "suffix-shared")
    dropped(spark, every, twice)
    kinds = stored(spark, shared.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("id", "h", "start")).alias("rep"), F.max("n").alias("n")), "suffix-kinds")
    several = stored(spark, kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "suffix-several")
    hard = kinds.join(several, "anchor").select("rep.*", *_KEY, "n", "weight", "kinds")
    wanted = stored(spark, hard.groupBy("id", "h").agg(F.collect_list(F.struct(*_KEY, "n", "weight", "kinds", "start")).alias("f")), "suffix-wanted")
    cut = F.transform("f", lambda f: F.struct(*(f[c].alias(c) for c in (*_KEY, "n", "weight", "kinds")), F.substring(F.col("text"), (f["start"] + 1).cast("int"), (f["n"] + length - 1).cast("int")).alias("text")))
    texts = asked(rows, wanted, "id", "h").where("_asked").join(wanted, ["id", "h"]).select(F.explode(cut).alias("f")).select("f.*").dropDuplicates(_KEY)
    texts = stored(spark, texts, "suffix-texts")
    whole = kinds.where("weight > 1").select(*_KEY, F.array(F.lit(0).cast("long")).alias("at"), F.array("n").alias("len"))
    found = stored(spark, _marks(spark, texts, length, gram, most).union(whole), "suffix-marks")
    dropped(spark, texts)
    runs = shared.select("id", "h", "start", *_KEY).join(found, _KEY).select("id", "h", F.explode(F.transform("at", lambda a, i: F.struct((F.col("start") + a).alias("at"), F.get("len", i).alias("len")))).alias("r"))
    return runs.select("id", "h", "r.at", "r.len")


def _regions(runs: DataFrame, rows: DataFrame, length: int, least: int) -> DataFrame:
    """(id, h, off, text): what the repeated strings of ``length`` bytes cover, where that is ``least`` bytes or more: longer repeated strings are in there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            for i, h, text, at, count in zip(b.column("id").to_pylist(), b.column("h").to_pylist(), b.column("text"), b.column("at").to_pylist(), b.column("len").to_pylist(), strict=True):
                cuts = [(s, e) for s, e in _removed(at, count, length) if e - s >= least]
                if cuts:
                    text, n = text.as_py(), len(cuts)
                    yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), pa.array([h] * n, pa.int64()), pa.array([s for s, _ in cuts], pa.int64()), pa.array([text[s:e] for s, e in cuts], pa.binary())], ["id", "h", "off", "text"])

    hit = asked(rows, runs, "id", "h").where("_asked").drop("_asked").join(runs, ["id", "h"])
    return hit.select("id", "h", "text", "at", "len").mapInArrow(run, "id long, h long, off long, text binary")


def _with_spans(spark: SparkSession, docs: DataFrame, runs: DataFrame, *keep: str) -> DataFrame:
    """The ``keep`` columns of ``docs``, its texts as bytes (_text), and the other columns of ``runs`` (id, h, ...), null where there are none."""
    lists = runs.columns[2:]
    runs = runs.withColumnsRenamed({c: f"_{c}" for c in runs.columns})
    rows = docs.select(*keep, F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"), F.xxhash64("text").alias("_h"), F.col("text").cast("binary").alias("_text"))
    # Texts that lose nothing stay where they are.
    rows = asked(rows, runs, "_id", "_h")
    cut = rows.where("_asked").join(runs, ["_id", "_h"], "left")
    whole = rows.where("not _asked").withColumns({f"_{c}": F.lit(None).cast("array<long>") for c in lists})
    return cut.unionByName(whole).drop("_asked")


def _grouped(spark: SparkSession, runs: DataFrame, at: str, count: str) -> DataFrame:
    return stored(spark, runs.groupBy("id", "h").agg(F.collect_list("at").alias(at), F.collect_list("len").alias(count)), "suffix-runs")


def _removed(at: list[int] | None, count: list[int] | None, length: int) -> list[tuple[int, int]]:
    """Maximal removed runs of bytes, in order; touching runs are one."""
    out: list[tuple[int, int]] = []
    for a, n in sorted(zip(at or (), count or (), strict=True)):
        end = a + n - 1 + length
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((a, end))
    return out


def _passages(text: bytes, at: list[int] | None, count: list[int] | None, length: int, words: int) -> list[tuple[int, int]]:
    """Of the maximal runs, those of more than ``words`` words, a word that an end cuts included."""
    return [(a, b) for a, b in _removed(at, count, length) if len(text[a:b].split()) > words]  # bytes split at the blanks \x20 \x09-\x0D


def _kept(text: bytes, cuts: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in cuts:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out)


#: Strings that make up passages, and their anchors' grams, in bytes: more than fifty words of prose are more than 200 bytes.
PASSAGE, PASSAGE_GRAM, PASSAGE_WORDS = 200, 64, 50


def digests(spark: SparkSession, docs: DataFrame, length: int = 400, gram: int = 200, most: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_bytes, chars_left) of every row of ``docs`` (doc_id, text).

    n_removed to kept_sha256: the removal of all bytes that a repeated string of
    ``length`` bytes covers. n_passages to chars_left: the removal of repeated
    passages as :func:`deduplicated` does it, which a string of ``length`` bytes
    can be too long for: their number, bytes, and the characters left.
    Strings are judged on whole input texts as UTF-8; matches never cross
    documents. First the strings of ``PASSAGE`` bytes are found; longer repeated
    strings lie in what those cover, and are looked for there alone. Null texts
    are empty; shorter texts than a string lose nothing; repeated rows lose all
    that their text's strings cover; an empty table gives no rows.
    """
    if length < PASSAGE:
        raise ValueError("strings are shorter than those of passages")
    rows = _keyed(docs)
    short = _grouped(spark, spans(spark, rows, PASSAGE, PASSAGE_GRAM, most), "p_at", "p_len")
    covered = short.select("id", "h", F.col("p_at").alias("at"), F.col("p_len").alias("len"))
    regions = stored(spark, _regions(covered, rows, PASSAGE, length).withColumn("rh", F.xxhash64("h", "off")), "suffix-regions")
    long = spans(spark, regions.select("id", F.col("rh").alias("h"), "text"), length, gram, most).withColumnRenamed("h", "rh")
    where = regions.select("id", "rh", "h", "off").distinct()
    long = _grouped(spark, long.join(where, ["id", "rh"]).select("id", "h", (F.col("at") + F.col("off")).alias("at"), "len"), "at", "len")
    runs = stored(spark, short.join(long, ["id", "h"], "left").select("id", "h", "at", "len", "p_at", "p_len"), "suffix-runs")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes", "chars_left"]
    kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            rows = []
            for text, at, count, p_at, p_count in zip(b.column("_text"), *(b.column(c).to_pylist() for c in ("_at", "_len", "_p_at", "_p_len")), strict=True):
                text = text.as_py() or b""
                cuts, gone = _removed(at, count, length), _passages(text, p_at, p_count, PASSAGE, PASSAGE_WORDS)
                left = np.frombuffer(_kept(text, gone), np.uint8)
                rows.append((len(text), sum(e - s for s, e in cuts), len(cuts), hashlib.sha256(_kept(text, cuts)).hexdigest(), len(gone), sum(e - s for s, e in gone), int(((left & 0xC0) != 0x80).sum())))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long, chars_left long"
    return _with_spans(spark, docs, runs, "doc_id").mapInArrow(run, schema)


def deduplicated(spark: SparkSession, docs: DataFrame, length: int = PASSAGE, gram: int = PASSAGE_GRAM, words: int = PASSAGE_WORDS) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``; all other columns as they are.

    A passage is a maximal run of bytes that repeated strings of ``length``
    bytes cover and that has more than ``words`` words, those that its ends cut
    included (0: every such run is one). Bytes of a character that is cut in two
    are dropped with the cut. A text that loses nothing, null included, stays as
    it is; one that loses all is empty and stays a row.
    """
    # Columns go under numbers meanwhile, so that none of their names can clash.
    names, text_at = docs.columns, docs.columns.index("text")
    inner = [f"c{i}" for i in range(len(names))]
    numbered = docs.toDF(*inner).withColumns({"doc_id": F.col(f"c{names.index('doc_id')}"), "text": F.col(f"c{text_at}")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            new = []
            for text, at, count in zip(b.column("_text"), b.column("_at").to_pylist(), b.column("_len").to_pylist(), strict=True):
                text = text.as_py()
                new.append(None if text is None else _kept(text, _passages(text, at, count, length, words)).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == text_at else b.column(c) for i, c in enumerate(inner)], inner)

    others = [c for i, c in enumerate(inner) if i != text_at]
    runs = _grouped(spark, spans(spark, _keyed(numbered), length, gram), "at", "len")
    return _with_spans(spark, numbered, runs, *others).mapInArrow(run, docs.toDF(*inner).schema).toDF(*names)
