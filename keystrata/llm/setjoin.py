"""N-gram Jaccard join with set-relation skipping, and the components of its links.

Equal sets are one class from the start, and a class most of whose shingles no
other class has is left alone: it can link with nothing. The others are indexed
under their prefixes:
their rarest shingles, as many as are needed for two similar sets to share one.
Lists are worked through in two ways. First each member is compared with one
pivot of its list, round by round; members that link with it are one component
and need no more comparing among themselves. What was found out for the pivot
then answers for sets like it: two members whose overlaps with the pivot are
too far apart can't be similar. Lists that still span several components are
cut into blocks by position, pairs of blocks are skipped by what positions
leave possible, and the pairs left are compared in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shingles import shingle_sets
from .util import WRITING, dropped, settings
from .util import stored as stored_under

#: Shingles are ordered by the load of their hash's bucket, least first: a table of this many bits, whatever the corpus.
LOAD_BITS = 18
#: Texts that one task turns into sets at once.
BATCH_BYTES = 1 << 19
#: Entries of one chunk of a list, and of one block of it.
CHUNK, BLOCK = 1024, 64
#: Pairs that a task finds before it hands them on.
PAIRS = 1 << 17
#: Python gets batches of 2 MB here: an executor holds a batch several times while its buffers double, and Python once more.
SMALL = WRITING | {"spark.sql.execution.arrow.maxBytesPerBatch": "2m"}


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table, with small batches for Python."""
    return stored_under(spark, df, name, SMALL)


def _texts(batches: Iterator[pa.RecordBatch], *columns: str):
    """Slices of about BATCH_BYTES: the named columns, and the texts as UTF-8; no more of a batch is unpacked at once."""
    for whole in batches:
        text = whole.column("text").cast(pa.binary())
        size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < whole.num_rows:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + BATCH_BYTES, side="right")))
            yield [whole.column(c).slice(at, end - at).to_pylist() for c in columns], [t or b"" for t in text.slice(at, end - at).to_pylist()]
            at = end


def _required(a, b, num: int, den: int):
    """The least overlap of sets of sizes a and b with den * overlap >= num * union."""
    return -(-num * (a + b) // (num + den))


#: Entries of a task before it hands them on, and those of one range of hashes.
HELD, RANGE = 1 << 18, 2_000_000
#: Sets of one hand-over that have a shingle, from which the shingle is known to be shared without asking.
COMMON = 64
#: Entries of a range that are sorted at once, about.
SLICE = 1 << 18


def _summed_up(docs: DataFrame, words: int, parts: int) -> DataFrame:
    """One pass over all texts, in rows of three kinds.

    0: (doc_id, n, digest) of a document. 1: part and packed entries (id of a
    set, 32 bits of a shingle) of one range of hashes. 2: (id, n): n shingles
    of a set that are known to be shared, being common among what the task
    held; two entries of each go on, so that all others see it.
    """
    names = ["kind", "part", "doc_id", "n", "digest", "ids", "sizes", "tokens"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def batch(**columns):
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in zip(names, kinds, strict=True)], names)

    def hand_on(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        h = np.concatenate([x[0] for x in held])
        n = np.concatenate([x[1] for x in held])
        ids = np.concatenate([x[2] for x in held])
        owner = np.repeat(np.arange(len(n)), n)
        # Of equal sets one speaks.
        _, first = np.unique(ids, return_index=True)
        speaks = np.zeros(len(n), bool)
        speaks[first] = True
        h, owner = h[speaks[owner]], owner[speaks[owner]]
        by = np.argsort(h, kind="stable")
        h, owner = h[by], owner[by]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
        count = np.diff(np.append(start, len(h)))
        nth = np.arange(len(h)) - np.repeat(start, count)
        local = (np.repeat(count, count) >= COMMON) & (nth >= 2)
        known = np.bincount(owner[local], minlength=len(n))
        told = np.flatnonzero(known)
        if len(told):
            yield batch(kind=np.full(len(told), 2, np.int32), doc_id=ids[told], n=known[told].astype(np.int64))
        h, owner = h[~local], owner[~local]  # still in order of hashes, so parts are runs
        part = ((h >> np.uint64(44)) * np.uint64(parts) >> np.uint64(20)).astype(np.int64)
        cuts = np.searchsorted(part, np.arange(parts + 1))
        for k in range(parts):
            some = slice(cuts[k], cuts[k + 1])
            if cuts[k] < cuts[k + 1]:
                by = np.argsort(owner[some], kind="stable")
                who, size = np.unique(owner[some], return_counts=True)
                yield batch(kind=[1], part=[k], ids=[ids[who].tobytes()], sizes=[size.astype(np.int32).tobytes()], tokens=[h[some][by].astype(np.uint32).tobytes()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for (doc_ids,), raw in _texts(batches, "doc_id"):
            h, n = shingle_sets(raw, words)
            ends = np.cumsum(n)
            digest = [hashlib.blake2b(h[e - k : e].tobytes(), digest_size=16).digest() if k else None for e, k in zip(ends, n, strict=True)]
            yield batch(kind=np.zeros(len(n), np.int32), doc_id=doc_ids, n=n.astype(np.int64), digest=digest)
            ids = np.array([int.from_bytes(d[:8], "big", signed=True) if d else 0 for d in digest], np.int64)
            held.append((h, n, ids))
            size += len(h)
            if size >= HELD:
                yield from hand_on(held)
                held, size = [], 0
        if held:
            yield from hand_on(held)

    return docs.select("doc_id", "text").mapInArrow(run, "kind int, part int, doc_id long, n long, digest binary, ids binary, sizes binary, tokens binary")


def _counted(held: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
    """(id, shared) of one range of hashes, whose packed entries (ids, sizes, tokens) are taken out of ``held``; an id may come in several batches."""
    tokens = np.concatenate([np.frombuffer(r[2], np.uint32) for r in held])
    who = np.concatenate([np.frombuffer(r[0], np.int64) for r in held])
    owner = np.repeat(np.arange(len(who), dtype=np.int32), np.concatenate([np.frombuffer(r[1], np.int32) for r in held]))
    held.clear()
    bits = (len(tokens) // SLICE).bit_length()
    for s in range(1 << bits):
        some = np.flatnonzero(tokens >> np.uint32(32 - bits) == s) if bits else np.arange(len(tokens))
        if not len(some):
            continue
        some = some[np.argsort(tokens[some], kind="stable")]
        t, ids = tokens[some], who[owner[some]]
        start = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        several = np.minimum.reduceat(ids, start) != np.maximum.reduceat(ids, start)
        size = np.diff(np.append(start, len(t)))
        mine, n = np.unique(ids[np.repeat(several, size)], return_counts=True)
        # An equal set that another task held as well counts again, which only lets more sets through.
        if len(mine):
            yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(n.astype(np.int64))], ["id", "shared"])


def _shared(packed: DataFrame, parts: int) -> DataFrame:
    """(id, shared): at least how many shingles of each set another set has as well; never fewer than there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for b in batches:
            for k, *blobs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != part and held:
                    yield from _counted(held)
                part = k
                held.append(blobs)
        if held:
            yield from _counted(held)

    entries = packed.where("kind = 1").select("part", "ids", "sizes", "tokens")
    asked = entries.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(count, "id long, shared long")
    return asked.union(packed.where("kind = 2").select("doc_id", "n")).groupBy("id").agg(F.sum("shared").alias("shared"))


def loads(docs: DataFrame, words: int) -> np.ndarray:
    """How many distinct shingles of all documents fall into each of ``2**LOAD_BITS`` buckets of their hashes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << LOAD_BITS, np.int64)
        for _, raw in _texts(batches):
            h, _ = shingle_sets(raw, words)
            n += np.bincount((h >> np.uint64(64 - LOAD_BITS)).astype(np.int64), minlength=1 << LOAD_BITS)
        seen = np.flatnonzero(n)
        for at in range(0, len(seen), 1 << 15):
            some = seen[at : at + (1 << 15)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["bucket", "n"])

    out = np.zeros(1 << LOAD_BITS, np.int64)
    with settings(docs.sparkSession, SMALL):
        got = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def sets(docs: DataFrame, load: np.ndarray, words: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, digest, last, prefix): each document's set size, a digest of the set, and its prefix as packed hashes in order; last: the place of the prefix's end in the order."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids,), raw in _texts(batches, "doc_id"):
            h, n = shingle_sets(raw, words)
            ends = np.cumsum(n)
            digest = [hashlib.blake2b(h[e - k : e].tobytes(), digest_size=16).digest() if k else None for e, k in zip(ends, n, strict=True)]
            owner = np.repeat(np.arange(len(n)), n)
            place = _places(h, load)
            order = np.lexsort((h, place, owner))
            room = np.where(n > 0, n - -(-num * n // den) + 1, 0)
            keep = np.arange(len(h)) - (ends - n)[owner] < room[owner]
            packed, stop = h[order][keep], np.cumsum(room)
            prefix = [packed[e - k : e].tobytes() for e, k in zip(stop, room, strict=True)]
            last = np.zeros(len(n), np.int64)
            last[room > 0] = place[order][keep][stop[room > 0] - 1]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n.astype(np.int64)), pa.array(digest, pa.binary()), pa.array(last), pa.array(prefix, pa.binary())], ["doc_id", "n", "digest", "last", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(build, "doc_id long, n long, digest binary, last long, prefix binary")


def _places(h: np.ndarray, load: np.ndarray) -> np.ndarray:
    """Where hashes stand in the order that prefixes are taken in: by load, then by hash; equal places are possible."""
    load = np.minimum(load[(h >> np.uint64(64 - LOAD_BITS)).astype(np.int64)], (1 << 23) - 1)
    return (load << 40) | (h >> np.uint64(24)).astype(np.int64)


def _lists(reps: DataFrame, load: np.ndarray, heavy: int) -> DataFrame:
    """(token, rep, n, pos): the index lists of all prefix hashes that two sets or more have.

    Entries travel packed, by ranges of hashes: some long blobs a task, not a
    row for each. Hashes of buckets with a load above ``heavy`` may have lists
    too long for one task; their entries travel as rows and are counted by
    Spark.
    """
    total = int(load.sum()) // 4
    parts = int(min(1 << 16, max(64, total // 500_000)))
    hot = load > heavy

    def part_of(h: np.ndarray) -> np.ndarray:
        return (((h >> np.uint64(44)) * np.uint64(parts)) >> np.uint64(20)).astype(np.int64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def flush():
            tokens = np.frombuffer(b"".join(p for _, _, p in held), np.uint64)
            counts = np.array([len(p) // 8 for _, _, p in held])
            owner = np.repeat(np.arange(len(held)), counts)
            pos = np.arange(len(tokens)) - np.repeat(np.cumsum(counts) - counts, counts)
            rep, n = (np.array([r[k] for r in held], np.int64) for k in (0, 1))
            alone = hot[(tokens >> np.uint64(64 - LOAD_BITS)).astype(np.int64)]
            part = np.where(alone, -1, part_of(tokens))
            by = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[by], np.arange(-1, parts + 1))
            for k in range(parts):
                some = by[cuts[k + 1] : cuts[k + 2]]
                if len(some):
                    who, at = np.unique(owner[some], return_inverse=True)
                    blobs = (tokens[some], rep[who], n[who], at.astype(np.int32), pos[some].astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], names)
        names = ["part", "tokens", "reps", "ns", "owner", "pos"]
        for b in batches:
            for r in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("prefix").to_pylist(), strict=True):
                held.append(r)
                size += len(r[2])
                if size >= 4 << 20:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def emit():
            tokens = np.concatenate([np.frombuffer(r[0], np.uint64) for r in held])
            owner = [np.frombuffer(r[3], np.int32) for r in held]
            rep, n = (np.concatenate([np.frombuffer(r[k], np.int64)[o] for r, o in zip(held, owner, strict=True)]) for k in (1, 2))
            pos = np.concatenate([np.frombuffer(r[4], np.int32) for r in held])
            by = np.argsort(tokens, kind="stable")
            t = tokens[by]
            same = t[1:] == t[:-1]
            by = by[np.append(same, False) | np.insert(same, 0, False)]
            for i in range(0, len(by), 1 << 15):
                s = by[i : i + (1 << 15)]
                yield pa.RecordBatch.from_arrays([pa.array(tokens[s].view(np.int64)), pa.array(rep[s]), pa.array(n[s]), pa.array(pos[s])], ["token", "rep", "n", "pos"])

        for b in batches:
            for k, *blobs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != part and held:
                    yield from emit()
                    held = []
                part = k
                held.append(blobs)
        if held:
            yield from emit()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rep, n, prefix in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("prefix").to_pylist(), strict=True):
                tokens = np.frombuffer(prefix, np.uint64)
                at = np.flatnonzero(hot[(tokens >> np.uint64(64 - LOAD_BITS)).astype(np.int64)])
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(tokens[at].view(np.int64)), pa.array(np.full(len(at), rep)), pa.array(np.full(len(at), n)), pa.array(at.astype(np.int32))], ["token", "rep", "n", "pos"])

    slim = reps.select("doc_id", "n", "prefix")
    packed = slim.mapInArrow(pack, "part int, tokens binary, reps binary, ns binary, owner binary, pos binary")
    schema = "token long, rep long, n long, pos int"
    out = packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(several, schema)
    if hot.any():
        alone = slim.mapInArrow(rows, schema)
        out = out.union(alone.join(alone.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token"), "token"))
    return out


#: Bits of the table by which rows that no pair asks for are left out before a shuffle: 1 MB, whatever the corpus.
SEEN_BITS = 1 << 23


def _wanted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, text) of the documents in ``ids`` (rep): a table of hashed ids leaves most others out where they are read, a join the rest."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(SEEN_BITS))
    ids = ids.select("rep").distinct()
    blocks = ids.select(place("rep").alias("p")).groupBy(F.expr("p div 32768").alias("b")).agg(F.bitmap_construct_agg(F.expr("p % 32768")).alias("m"))
    seen = np.zeros(SEEN_BITS // 8, np.uint8)
    for b, m in blocks.collect():  # SEEN_BITS / 32768 rows at most
        seen[b * 4096 : (b + 1) * 4096] = np.frombuffer(m, np.uint8)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column("p").to_numpy(zero_copy_only=False)
            keep = (seen[p >> 3] >> (p & 7).astype(np.uint8)) & 1
            out = b.filter(pa.array(keep.astype(bool)))
            if out.num_rows:
                yield pa.RecordBatch.from_arrays([out.column("rep"), out.column("text")], ["rep", "text"])

    some = docs.where("doc_id is not null").select(F.col("doc_id").alias("rep"), "text", place("doc_id").alias("p")).mapInArrow(sift, "rep long, text string")
    return some.join(ids, "rep", "left_semi").dropDuplicates(["rep"])


def _possible(pairs: DataFrame, signs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (x, y) whose prefixes share enough: outside what they share, the overlap lies behind the prefix that ends first."""
    of = lambda e: signs.select(*(F.col(c).alias(f"{e}_{c}") for c in ("rep", "n", "last", "rest", "tokens")))
    both = pairs.join(of("x"), F.col("x") == F.col("x_rep")).join(of("y"), F.col("y") == F.col("y_rep"))
    behind = F.when(F.col("x_last") < F.col("y_last"), F.col("x_rest")).when(F.col("y_last") < F.col("x_last"), F.col("y_rest")).otherwise(F.greatest("x_rest", "y_rest"))
    shared = F.size(F.array_intersect("x_tokens", "y_tokens"))
    sizes = den * F.least("x_n", "y_n") >= num * F.greatest("x_n", "y_n")
    return both.where(sizes & ((shared + behind) * (num + den) >= num * (F.col("x_n") + F.col("y_n")))).select("x", "y", F.col("x_n").alias("nx"), F.col("y_n").alias("ny"))


def _compared(spark: SparkSession, docs: DataFrame, pairs: DataFrame, words: int, group: int = 64) -> DataFrame:
    """``pairs`` (x, y, ...) with their overlap: a y and up to about ``group`` of its x meet in one place, where the set of y is built once."""
    parts = pairs.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("parts"))
    dealt = stored(spark, pairs.join(parts, "y").withColumn("s", F.pmod(F.hash("x"), "parts")).drop("parts"), "join-pairs")
    texts = stored(spark, _wanted(docs, dealt.select(F.col("x").alias("rep")).union(dealt.select("y"))), "join-texts")
    left = dealt.select("x", "y", "s").join(texts, F.col("x") == F.col("rep")).select("y", "s", "x", "text")
    right = dealt.select("y", "s").distinct().join(texts, F.col("y") == F.col("rep")).select("y", "s", F.lit(None).cast("long").alias("x"), "text")
    meet = left.union(right).repartition("y", "s").sortWithinPartitions("y", "s", F.col("x").asc_nulls_first())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for (ys, xs), raw in _texts(batches, "y", "x"):
            h, n = shingle_sets(raw, words)
            rows, end = [], 0
            for y, x, k in zip(ys, xs, n.tolist(), strict=True):
                some = h[end : end + k]
                end += k
                if x is None:
                    own = some
                else:
                    at = np.searchsorted(own, some)
                    rows.append((x, y, int((own[np.minimum(at, len(own) - 1)] == some).sum()) if len(own) else 0))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["x", "y", "overlap"])

    found = stored(spark, meet.mapInArrow(count, "x long, y long, overlap long"), "join-overlaps")
    dropped(spark, texts)
    return dealt.drop("s").join(found, ["x", "y"])


def _candidates(lists: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y), x < y: pairs of different components of one list that its positions and the pivot's answers leave possible.

    A list of more than CHUNK entries is dealt to pairs of chunks. In a chunk
    pair, blocks of entries in order of what follows them in their sets are
    skipped together once the rest can't reach the overlap that is needed.
    """
    chunks = F.ceil(F.count(F.lit(1)) / CHUNK).cast("int")
    dealt = lists.join(lists.groupBy("token").agg(chunks.alias("k")), "token").withColumn("c", F.pmod(F.hash("rep"), "k"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    dealt = dealt.withColumn("d", other).withColumn("lo", F.least("c", "d")).withColumn("hi", F.greatest("c", "d")).drop("d", "k")
    columns = ["token", "lo", "hi", "c", "rep", "n", "pos", "comp", "pivot_overlap"]
    dealt = dealt.select(*columns).repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", F.desc(F.col("n") - F.col("pos")), "rep")

    def pairs_of(g: dict[str, np.ndarray]) -> Iterator[np.ndarray]:
        rest, n, rep, comp, c, o = g["n"] - g["pos"], g["n"], g["rep"], g["comp"], g["c"], g["pivot_overlap"]
        across = g["lo"][0] != g["hi"][0]
        for a in range(0, len(n), BLOCK):
            i = np.arange(a, min(a + BLOCK, len(n)))
            for b in range(a, len(n), BLOCK):
                j = np.arange(b, min(b + BLOCK, len(n)))
                if den * rest[b] < num * n[i].min():
                    break  # entries are in order of their rest and no set is smaller than its rest: none further on is large enough
                if rest[b] < _required(n[i].min(), n[j].min(), num, den):
                    continue  # later blocks have a smaller rest, but their sets may be smaller as well
                p, q = (m.ravel() for m in np.meshgrid(i, j, indexing="ij"))
                if a == b:
                    p, q = p[p < q], q[p < q]
                need = _required(n[p], n[q], num, den)
                ok = (comp[p] != comp[q]) & (np.minimum(rest[p], rest[q]) >= need)
                ok &= den * np.minimum(n[p], n[q]) >= num * np.maximum(n[p], n[q])
                known = (o[p] >= 0) & (o[q] >= 0)
                ok &= ~known | ((n[p] - o[p] + o[q] >= need) & (n[q] - o[q] + o[p] >= need))
                if across:
                    ok &= c[p] != c[q]
                x, y = rep[p[ok]], rep[q[ok]]
                if len(x):
                    yield np.stack((np.minimum(x, y), np.maximum(x, y)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        found: list[np.ndarray] = []
        size = 0

        def emit():
            xy = np.unique(np.concatenate(found, 1), axis=1)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(xy[0]), pa.array(xy[1])], ["x", "y"])

        def pairs(rows: dict[str, np.ndarray]):
            nonlocal size
            for xy in pairs_of(rows):
                found.append(xy)
                size += xy.shape[1]
                if size >= PAIRS:
                    yield emit()
                    size = 0

        def groups(rows: dict[str, np.ndarray], last: bool):
            key = np.stack((rows["token"], rows["lo"], rows["hi"]))
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            bounds = [0, *cut.tolist(), len(rows["n"])]
            ends = bounds if last else bounds[:-1]
            for s, e in zip(ends[:-1], ends[1:], strict=True):
                yield {k: v[s:e] for k, v in rows.items()}
            return {k: v[bounds[-2] :] for k, v in rows.items()}

        for b in batches:
            if not b.num_rows:
                continue
            rows = {k: b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in columns}
            if held:
                rows = {k: np.concatenate((held[k], v)) for k, v in rows.items()}
            gen = groups(rows, False)
            while True:
                try:
                    yield from pairs(next(gen))
                except StopIteration as stop:
                    held = stop.value
                    break
        if held:
            yield from pairs(held)
        if found:
            yield emit()

    return dealt.mapInArrow(run, "x long, y long").distinct()


def joined(spark: SparkSession, docs: DataFrame, words: int = 5, num: int = 75, den: int = 100, rounds: int = 3, heavy: int = 4_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    Two documents link when ``den * intersection >= num * union`` of their
    shingle sets; ``component_id`` is the smallest id reachable by links. A set
    is the distinct runs of ``words`` lower-cased words; the whole sequence, if
    it has fewer. Null texts and texts without a word have empty sets and link
    with nothing; a null id counts as larger than all; repeated rows are
    members of one class; an empty table gives no rows. ``rounds``: pivots that
    a list's members are compared with at most before its remaining pairs are.
    ``heavy``: the load of a bucket from which its lists are made by Spark alone.
    """
    docs = docs.select("doc_id", "text")
    with settings(spark, SMALL):
        size, = docs.agg(F.sum(F.octet_length("text"))).first()
    parts = int(min(1 << 16, max(64, (size or 0) // 6 // RANGE)))
    packed = stored(spark, _summed_up(docs, words, parts), "join-packed")
    every = stored(spark, packed.where("kind = 0").select("doc_id", "n", "digest"), "join-digests")
    classes = stored(spark, every.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "join-classes")
    id_of = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    near = classes.withColumn("id", id_of).join(_shared(packed, parts), "id").where(F.col("shared") * den >= F.col("n") * num)
    near = stored(spark, near.select("rep"), "join-near")
    dropped(spark, packed)
    docs = stored(spark, _wanted(docs, near).withColumnRenamed("rep", "doc_id"), "join-texts")
    load = loads(docs, words)
    full = stored(spark, sets(docs, load, words, num, den), "join-sets")
    reps = full
    lists = stored(spark, _lists(reps, load, heavy), "join-lists")
    # What a set shares with any other; the set that shares most of its prefix is the pivot of its lists.
    ends = full.select(F.col("doc_id").alias("rep"), "n", "last").dropDuplicates(["rep"])
    rest = F.ceil(F.col("n") * num / den) - 1
    signs = lists.groupBy("rep").agg(F.collect_set("token").alias("tokens")).join(ends, "rep").withColumn("rest", rest.cast("long"))
    signs = stored(spark, signs, "join-signs")
    shares = signs.select("rep", (F.size("tokens") / (F.col("n") - F.col("rest"))).alias("share"))
    lists = stored(spark, lists.join(shares, "rep").withColumn("comp", F.col("rep")).withColumn("pivot_overlap", F.lit(-1).cast("long")), "join-lists")
    dropped(spark, full)

    similar = den * F.col("overlap") >= num * (F.col("nx") + F.col("ny") - F.col("overlap"))
    link = lambda known: known.where(similar).select(F.col("x").alias("a"), F.col("y").alias("b"))
    links: DataFrame | None = None
    for r in range(rounds):
        order = F.struct(-F.col("share"), "n", "rep") if r == 0 else F.struct(F.xxhash64("rep", F.lit(r)).alias("h"), F.col("rep"))
        pivots = lists.groupBy("token").agg(F.min_by(F.struct("rep", "n", "pos", "comp"), order).alias("p"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("token", "p")
        lists = stored(spark, lists.drop("p").join(pivots, "token"), "join-lists")  # lists of one component are done
        reach = F.least(F.col("n") - F.col("pos"), F.col("p.n") - F.col("p.pos"))
        fits = (F.col("comp") != F.col("p.comp")) & (reach * (num + den) >= num * (F.col("n") + F.col("p.n")))
        pairs = lists.where(fits).select(F.col("rep").alias("x"), F.col("p.rep").alias("y")).distinct()
        known = stored(spark, _compared(spark, docs, _possible(pairs, signs, num, den), words), "join-known")
        new = link(known)
        links = new if links is None else links.union(new)
        merged = new.limit(1).count()
        told = known.select(F.col("x").alias("rep"), F.col("y").alias("_y"), F.col("overlap").alias("_o"))
        lists = lists.withColumn("_y", F.col("p.rep")).drop("pivot_overlap").join(told, ["rep", "_y"], "left")
        overlap = F.when(F.col("rep") == F.col("p.rep"), F.col("n")).otherwise(F.coalesce("_o", F.lit(-1)))
        lists = lists.withColumn("pivot_overlap", overlap.cast("long")).drop("p", "_y", "_o")
        if merged:
            comp = stored(spark, components(spark, links), "join-components")
            now = comp.select(F.col("node").alias("rep"), "component")
            lists = lists.join(now, "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
        lists = stored(spark, lists, "join-lists")
        if not merged:
            break
    left = lists.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("token")
    pairs = stored(spark, _candidates(lists.join(left, "token"), num, den), "join-candidates")
    known = stored(spark, _compared(spark, docs, _possible(pairs, signs, num, den), words), "join-known")
    links = link(known) if links is None else links.union(link(known))
    comp = stored(spark, components(spark, links), "join-components")
    of_class = classes.join(comp, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("c"))
    out = every.join(of_class, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))


def one_of_each(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest; of rows that repeat an id, one."""
    found = stored(spark, joined(spark, docs, **options), "join-joined")
    gone = stored(spark, found.where("doc_id <> component_id").select("doc_id").distinct(), "join-gone")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 and doc_id is not null").limit(1).count():
        kept = kept.where("doc_id is null").union(kept.where("doc_id is not null").dropDuplicates(["doc_id"]))
    return kept
