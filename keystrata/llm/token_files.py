"""Token ids in Parquet files made for selective reads.

A document's ids are one list column in delta encoding (ids without a fixed
vocabulary order compress as differences within miniblocks) or dictionary
encoding; metadata columns have dictionary or delta encodings of their own.
Files hold ascending ranges of ids with row groups and data pages of a bounded
size, column and offset indexes and checksums, so readers can fetch a few
documents' tokens or the metadata alone.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import new_path, stored

#: Stretches whose ids are kept; those met in one batch only go when there are more.
CACHED = 500_000
#: Stretches that the tokenizer sees as one text.
RUN = 128
#: Characters that Python or the vocabulary's pre-tokenizer takes as white space.
_SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts that can't be cut at their blanks: a blank at either end or beside white space, white space at the end.
_WHOLE = rf"\A |[{_SPACE}]\z| [{_SPACE}]|[{_SPACE}] |\x{{0}}"

_LETTER = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]"
#: Stretches of letters: one piece to the pre-tokenizer, which needs no search for where it ends.
_LETTERS = rf"\A{_LETTER}+\z"
#: In front of a stretch without a blank; texts that hold it are not cut.
_MARK = "\0"
#: Where the pre-tokenizer always cuts: from letters to points, and from one line break behind a point to letters.
_MARKED = [(rf"({_LETTER})([.,;:!?])", rf"\1 {_MARK}\2"), (rf"([.,;:!?]\n)({_LETTER})", rf"\1 {_MARK}\2")]


class Encoder:
    """Ids by the tokenizers library, each distinct stretch from one blank to the next encoded once.

    A byte-level vocabulary's pre-tokenizer never joins characters across a
    blank that stands between two others, and gives that blank to what follows.
    So a text is cut before each such blank, and where letters end at a point
    or begin behind one and a line break, which the pre-tokenizer never joins
    either; such a stretch begins with a mark. Stretches not met before are
    encoded in runs, and told apart by the bytes that each id stands for; runs
    of letters alone are cut at their blanks and at nothing else. Stretches met
    before have their ids in one pool. Texts in which a blank touches
    other white space are one stretch, and so are those that hold one of the
    vocabulary's special strings, which get its ids as the library has it.
    """

    def __init__(self, file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        self.tokenizer, self.at_blanks = Tokenizer.from_file(file), Tokenizer.from_file(file)
        # Runs of stretches, which may put a special string together that no text has, are read as ordinary text.
        self.runs = Tokenizer.from_file(file)
        self.runs.encode_special_tokens = self.at_blanks.encode_special_tokens = True
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.whole = "|".join([_WHOLE, *map(re.escape, special)])
        self.at_blanks.pre_tokenizer = Sequence([Split(" ", "merged_with_next"), ByteLevel(add_prefix_space=False, use_regex=False)])
        # In a byte-level vocabulary each character of an entry stands for one byte.
        self.width = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for entry, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(entry)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.empty(0, np.int32)
        self.begin, self.size, self.batches = (np.empty(0, np.int64) for _ in range(3))

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, fresh: list[str], lengths: np.ndarray, letters: int, marked: int) -> None:
        """Keep the ids of stretches (without their blank) of so many bytes each; the first ``letters`` are letters alone, the last ``marked`` have a mark instead of a blank."""
        runs, counts = [], []
        for tokenizer, first, last in ((self.at_blanks, 0, letters), (self.runs, letters, len(fresh) - marked)):
            for at in range(first, last, RUN):
                some = slice(at, min(at + RUN, last))
                ids = self._ids(tokenizer, [" " + " ".join(fresh[some])])[0]
                ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(lengths[some] + 1)) + 1
                runs.append(ids)
                counts.append(np.diff(ends, prepend=0))
        own = self._ids(self.runs, [w[1:] for w in fresh[len(fresh) - marked :]])
        runs += own
        counts.append(np.array([len(ids) for ids in own], np.int64))
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        size = np.concatenate(counts)
        self.begin = np.concatenate((self.begin, len(self.pool) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.batches = np.concatenate((self.batches, np.zeros(len(fresh), np.int64)))
        self.pool = np.concatenate((self.pool, *runs))

    def _shrink(self) -> None:
        """Keep what was met in several batches; nothing, if that is most of it."""
        stay = np.flatnonzero(self.batches > 1)
        if len(stay) > CACHED * 3 // 4:
            self._forget()
            return
        words = list(self.known)
        self.known = {words[i]: k for k, i in enumerate(stay.tolist())}
        self.pool = self.pool[_spread(self.begin[stay], self.size[stay])]
        self.size, self.batches = self.size[stay], self.batches[stay]
        self.begin = np.cumsum(self.size) - self.size

    def encode(self, texts: pa.Array, end: list[int] = ()) -> pa.ListArray:
        """Each text's ids with those of ``end`` after them; a null text is empty."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, self.whole)
        plain = pc.if_else(whole, "", texts)
        for pattern, put in _MARKED:
            plain = pc.replace_substring_regex(plain, pattern, put)
        cut = pc.split_pattern(plain, " ")
        offsets, words = np.asarray(cut.offsets).astype(np.int64), cut.flatten()
        offsets = offsets - offsets[0]
        heads = offsets[:-1]
        firsts = self._ids(self.tokenizer, pc.if_else(whole, texts, words.take(pa.array(heads))).to_pylist())
        coded = words.dictionary_encode()
        index, distinct = np.asarray(coded.indices), coded.dictionary
        inner = np.ones(len(words), bool)
        inner[heads] = False
        used = np.flatnonzero(np.bincount(index[inner], minlength=len(distinct)))
        names = distinct.take(pa.array(used))
        listed = names.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) + len(listed) > CACHED:
            self._shrink()
        place = np.fromiter(map(self.known.get, listed, repeat(-1)), np.int64, len(listed))
        new = np.flatnonzero(place < 0)
        if len(new):
            some = names.take(pa.array(new))
            kind = np.where(pc.match_substring_regex(some, _LETTERS).to_numpy(zero_copy_only=False), 0, np.where(pc.starts_with(some, _MARK).to_numpy(zero_copy_only=False), 2, 1))
            new = new[np.argsort(kind, kind="stable")]
            place[new] = np.arange(len(self.known), len(self.known) + len(new))
            self._learn([listed[i] for i in new.tolist()], pc.binary_length(names.take(pa.array(new))).to_numpy().astype(np.int64), int((kind == 0).sum()), int((kind == 2).sum()))
        self.batches[place] += 1
        # First stretches and the end are behind the pool for this batch only.
        of = np.zeros(len(distinct), np.int64)
        of[used] = place
        at = of[index]
        at[heads] = len(self.size) + np.arange(len(heads))
        at = np.insert(at, offsets[1:], len(self.size) + len(heads))
        more = [*firsts, np.array(end, np.int32)]
        pool = np.concatenate((self.pool, *more))
        more_size = np.array([len(m) for m in more], np.int64)
        size = np.concatenate((self.size, more_size))[at]
        begin = np.concatenate((self.begin, len(self.pool) + np.cumsum(more_size) - more_size))[at]
        upto = np.concatenate(([0], np.cumsum(size)))
        ends = offsets + np.arange(len(offsets))
        return pa.ListArray.from_arrays(pa.array(upto[ends].astype(np.int32)), pa.array(pool[_spread(begin, size)]))


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of runs of so many places each."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


@functools.cache
def _encoder(file: str) -> Encoder:
    """One for each Python worker: what its tasks have met stays known."""
    return Encoder(file)


def _encoded(file: str, end_id: int, batch_bytes: int = 4 << 20):
    """Batches of (doc_id, text) to batches of (doc_id, ids): ids of each whole text with the end id; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(file)
        for whole in batches:
            text = whole.column("text")
            size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(size):
                stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + batch_bytes, side="right")))
                ids = encoder.encode(text.slice(at, stop - at), [end_id])
                yield pa.RecordBatch.from_arrays([whole.column("doc_id").slice(at, stop - at).cast(pa.int64()), ids], ["doc_id", "ids"])
                at = stop

    return run


def written(spark: SparkSession, docs: DataFrame, file: str, end_id: int, path: str, parts: int | None = None, row_group: int = 32 << 20, page: int = 256 << 10, page_rows: int = 1024, encoding: str = "delta") -> str:
    """Write ids of ``docs`` (doc_id, text) in ascending id order as Parquet files under ``path``.

    Columns: part (the file's place among all), seq (the row's place in its
    part), doc_id, n_tokens, ids list<int>. Each part is one range of ids; there are
    ``parts`` of them, or as many as ``docs`` has. ``row_group``, ``page``:
    bytes of a row group and of a page, which has ``page_rows`` rows at most.
    ``encoding``: delta or dictionary for the ids. A null or empty text has the
    end id alone; a very long one is encoded whole, as one row; rows of equal
    ids keep one order in the file; null ids come first.
    """
    if encoding not in ("delta", "dictionary"):
        raise ValueError(encoding)
    parts = parts or max(docs.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    ranged = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            ids = b.column("ids")
            sizes = np.diff(np.asarray(ids.offsets))
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), b.column("doc_id"), pa.array(sizes.astype(np.int64)), ids], ["part", "seq", "doc_id", "n_tokens", "ids"])
            seq += n

    def both(batches):
        return numbered(_encoded(file, end_id)(batches))

    out = ranged.mapInArrow(both, "part int, seq long, doc_id long, n_tokens long, ids array<int>")
    writer = out.write.option("parquet.writer.version", "v2").option("parquet.block.size", row_group).option("parquet.page.size", page).option("parquet.page.row.count.limit", page_rows).option("parquet.page.write-checksum.enabled", "true")
    writer = writer.option("parquet.enable.dictionary#ids.list.element", str(encoding == "dictionary").lower()).option("parquet.enable.dictionary#doc_id", "false").option("parquet.enable.dictionary#seq", "false")
    writer.parquet(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files. A filter on doc_id or seq reaches the row groups' and pages' indexes, and columns that aren't asked for aren't read."""
    return spark.read.schema("part int, seq long, doc_id long, n_tokens long, ids array<int>").parquet(path)


def placed(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, read from their ids.

    ``start``: the ids of all documents before it, by sums over parts and then
    inside each part, so no task sees more than one part.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            values = np.asarray(ids.values).astype("<u4", copy=False)
            at = np.asarray(ids.offsets)
            crc = [zlib.crc32(values[i:j].tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("seq"), b.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "n_tokens", "ids_crc32"])

    from pyspark.sql import Window as W

    slim = read(spark, path).select("part", "seq", "doc_id", "ids").mapInArrow(sums, "part int, seq long, doc_id long, n_tokens long, ids_crc32 long")
    slim = stored(spark, slim, "token-sums")
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = slim.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", before.alias("from"))
    inside = F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq"))
    return slim.withColumn("upto", inside).join(parts, "part").select("doc_id", (F.col("from") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(spark: SparkSession, docs: DataFrame, file: str, end_id: int) -> DataFrame:
    """Write the ids of all documents and read them back: see :func:`written` and :func:`placed`. Other columns of ``docs``, of whatever name, are left out; a table without rows gives none."""
    return placed(spark, written(spark, docs, file, end_id, new_path(spark, "tokens")))
