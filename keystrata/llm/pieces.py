"""Encoding to pieces and decoding from them.

An Aho-Corasick automaton over a SentencePiece vocabulary reads the text once.
At each position its output links give the pieces that end there, longest
first, and each relaxes the best score of the position: a single-pass Viterbi.
Blanks become ``▁`` with one put before the text; a character of no piece
becomes the pieces of its UTF-8 bytes; so does a ``▁`` of the text itself, and
decoding returns every text exactly.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLANK = "▁"
#: Stretches whose best pieces are kept; those met in one text only go when there are more.
CACHED = 200_000


class Pieces:
    """A vocabulary with its automaton.

    If no piece holds a ``▁`` after another character, pieces never cross the
    start of a run of ``▁``, so the best pieces of a text are the best pieces of
    the stretches between; each distinct stretch is worked out once.
    """

    def __init__(self, names: list[str], scores: list[float], normal: list[bool], byte_ids: list[int]):
        self.names, self.byte_ids = names, byte_ids
        usable = [i for i, ok in enumerate(normal) if ok]
        self.words = [(names[i], (len(names[i]), scores[i], i)) for i in usable]
        self.single = {names[i] for i in usable if len(names[i]) == 1}
        self.unknown = min((scores[i] for i in usable), default=0.0) - 10.0
        apart = all(BLANK not in names[i].lstrip(BLANK) for i in usable)
        self.stretch = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+" if apart else r"(?s).+")
        self.known: dict[str, bytes] = {}
        self.once: set[str] = set()
        self.decoded = np.array([n.replace(BLANK, " ") for n in names], object)
        self.is_byte = np.zeros(len(names), bool)
        self.is_byte[byte_ids] = True
        self.byte_of = {i: b for b, i in enumerate(byte_ids)}

    @functools.cached_property
    def automaton(self):
        """Of all pieces; made when something is encoded."""
        import ahocorasick

        out = ahocorasick.Automaton()
        for name, piece in self.words:
            out.add_word(name, piece)
        out.make_automaton()
        return out

    @classmethod
    def load(cls, file: str) -> Pieces:
        """The model in a file; a task reads its own, so that idle workers hold none."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=file)
        every = range(m.get_piece_size())
        bytes_ = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        normal = [not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i)) for i in every]
        scores = [m.get_score(i) for i in every]
        if all(x.is_integer() for x, ok in zip(scores, normal, strict=True) if ok):
            # The scores of a model of merges are their ranks, not log-probabilities: the fewest pieces are best, and ranks decide between as many.
            scores = [-1.0 + max(x, -float(len(scores))) * 1e-9 for x in scores]
        return cls([m.id_to_piece(i) for i in every], scores, normal, bytes_)

    def best(self, text: str) -> tuple[int, ...]:
        """The ids of the best-scored segmentation of escaped text; of equal scores, the one whose last pieces are longer."""
        n = len(text)
        score, back = [-np.inf] * (n + 1), [None] * (n + 1)
        score[0] = 0.0
        if self.single.issuperset(text):  # every position is reached by pieces
            for last, piece in self.automaton.iter(text):
                new = score[last + 1 - piece[0]] + piece[1]
                if new > score[last + 1]:
                    score[last + 1], back[last + 1] = new, piece
        else:
            found: list[list] = [[] for _ in text]
            for last, piece in self.automaton.iter(text):
                found[last].append(piece)
            for last, some in enumerate(found):
                if text[last] not in self.single:
                    some.append((1, self.unknown, -1))
                for piece in some:
                    new = score[last + 1 - piece[0]] + piece[1]
                    if new > score[last + 1]:
                        score[last + 1], back[last + 1] = new, piece
        out: list[int] = []
        while n:
            length, _, i = back[n]
            if i >= 0:
                out.append(i)
            else:
                out += [self.byte_ids[b] for b in reversed(text[n - 1].encode("utf-8", "surrogatepass"))]
            n -= length
        out.reverse()
        return tuple(out)

    def packed(self, text: str) -> bytes:
        """The text's ids as little-endian 32-bit integers."""
        out = []
        if not text:
            return b""
        literal = np.array([self.byte_ids[b] for b in BLANK.encode()], "<i4").tobytes()
        for k, part in enumerate(text.split(BLANK)):
            if k:
                out.append(literal)
            stretches = self.stretch.findall(("" if k else BLANK) + part.replace(" ", BLANK))
            met = set(stretches)
            fresh = met.difference(self.known)
            self.once -= met
            if len(self.known) + len(fresh) > CACHED:
                for w in self.once if len(self.once) > CACHED // 4 else list(self.known):
                    del self.known[w]
                self.once = set()
                fresh = met.difference(self.known)
            self.known.update([(w, array("i", self.best(w)).tobytes()) for w in fresh])
            self.once |= fresh
            out += map(self.known.__getitem__, stretches)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<i4").tolist()

    def decode(self, ids: list[int] | np.ndarray) -> str:
        if not len(ids):
            return ""
        ids = np.asarray(ids)
        if not self.is_byte[ids].any():
            return "".join(self.decoded[ids].tolist())[1:]
        raw = b"".join([bytes((self.byte_of[i],)) if i in self.byte_of else self.decoded[i].encode() for i in ids.tolist()])
        return raw.decode("utf-8", "surrogatepass")[1:]


def free_name(rows: DataFrame, name: str) -> str:
    """``name``, or with the first number behind it that makes it a name of no column; Spark's names differ by more than case."""
    taken = {c.lower() for c in rows.columns}
    tries = [name, *(f"{name}_{i}" for i in range(1, len(taken) + 2))]
    return next(n for n in tries if n.lower() not in taken)


def _encoding(pieces: Pieces, batches: Iterator[pa.RecordBatch], text: str, ids: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            b = whole.slice(at, 512)
            got = [None if t is None else pieces.packed(t) for t in b.column(text).to_pylist()]
            ends = np.cumsum([0] + [len(g or b"") // 4 for g in got]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join([g or b"" for g in got]), "<i4"))
            lists = pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([g is None for g in got]))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, ids])


def _decoding(pieces: Pieces, batches: Iterator[pa.RecordBatch], ids: str, text: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            b = whole.slice(at, 512)
            lists = b.column(ids)
            flat, ends = np.asarray(lists.values), np.asarray(lists.offsets)
            got = [pieces.decode(flat[i:j]) if ok else None for i, j, ok in zip(ends[:-1], ends[1:], lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], [*b.schema.names, text])


def encoded(docs: DataFrame, file: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of its texts' piece ids, array<int>; null for a null text, empty for an empty one.

    ``file``: the model's path, which every executor can read. All columns of
    ``docs`` are kept; where one is named ``ids`` already, the new one is called
    by the first free of ``ids_1``, ``ids_2``. Rows that are repeated get equal
    ids; a very long text is encoded whole; of equal scores the segmentation
    with the longer last pieces wins; an empty table gives no rows.
    """
    ids = free_name(docs, ids)
    return docs.mapInArrow(lambda batches: _encoding(Pieces.load(file), batches, text, ids), f"{docs._jdf.schema().toDDL()}, `{ids}` array<int>")


def decoded(rows: DataFrame, file: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with a column of the texts that its piece ids stand for; null for null. A name that is taken gets a number, as in :func:`encoded`."""
    text = free_name(rows, text)
    return rows.mapInArrow(lambda batches: _decoding(Pieces.load(file), batches, ids, text), f"{rows._jdf.schema().toDDL()}, `{text}` string")


def round_trip(docs: DataFrame, file: str, text: str = "text") -> DataFrame:
    """``docs`` with the columns ``ids`` of :func:`encoded` and ``decoded`` of :func:`decoded`, which are made from nothing but those ids.

    Both steps are one pass, so a task needs one Python worker and one vocabulary, and texts cross once.
    """
    ids, back = free_name(docs, "ids"), free_name(docs, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(file)
        return _decoding(pieces, _encoding(pieces, batches, text, ids), ids, back)

    return docs.mapInArrow(run, f"{docs._jdf.schema().toDDL()}, `{ids}` array<int>, `{back}` string")
