"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded
sample of labelled rows. It labels every byte position of a text; a document's
probabilities are its positions' mean. Texts are cut into stretches of
``STRETCH`` bytes that are read side by side, so a batch of any texts is a few
large matrix products per position, and memory doesn't depend on text length.
No state goes from one stretch to the next: the network is trained on stretches
of this length, which are some ten words, and a state carried on would make the
reading of a long text one step after the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STRETCH = 64
HIDDEN = 10
#: Stretches that are read side by side.
LANES = 4096
_LETTER = re.compile(r"[^\W\d_]")


class Network:
    """Embeds bytes straight into the gates; p: parameters by name, f and b for the two directions."""

    def __init__(self, langs: list[str], p: dict[str, np.ndarray]):
        self.langs, self.p = langs, p

    @classmethod
    def fresh(cls, langs: list[str], hidden: int, rng: np.random.Generator) -> Network:
        p = {}
        for d in "fb":
            p["E" + d] = rng.normal(0, 0.3, (256, 3 * hidden))
            p["U" + d] = rng.normal(0, hidden**-0.5, (hidden, 2 * hidden))
            p["C" + d] = rng.normal(0, hidden**-0.5, (hidden, hidden))
            p["V" + d] = rng.normal(0, hidden**-0.5, (hidden, len(langs)))
        p["v"] = np.zeros(len(langs))
        return cls(langs, {k: v.astype(np.float32) for k, v in p.items()})

    def _run(self, x: np.ndarray, d: str, keep: bool = False):
        """x: (steps, lanes) bytes in reading order. Hidden states, and what backpropagation needs."""
        e, u, c = self.p["E" + d], self.p["U" + d], self.p["C" + d]
        h_n = c.shape[0]
        h = np.zeros((x.shape[1], h_n), np.float32)
        out = np.empty((*x.shape, h_n), np.float32)
        tape = []
        for t in range(len(x)):
            a = e[x[t]]
            g = h @ u
            g += a[:, : 2 * h_n]
            np.negative(g, out=g)
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            r, z = g[:, :h_n], g[:, h_n:]
            rh = r * h
            n = rh @ c
            n += a[:, 2 * h_n :]
            np.tanh(n, out=n)
            new = h - n
            new *= z
            new += n
            if keep:
                tape.append((h, r, z, rh, n))
            out[t] = h = new
        return out, tape

    def logits(self, x: np.ndarray) -> np.ndarray:
        """(steps, lanes, languages) for x of shape (steps, lanes): each position's label scores."""
        fwd, _ = self._run(x, "f")
        bwd, _ = self._run(x[::-1], "b")
        return fwd @ self.p["Vf"] + bwd[::-1] @ self.p["Vb"] + self.p["v"]

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of all unmasked positions; y: (lanes,)."""
        states = {d: self._run(x if d == "f" else x[::-1], d, keep=True) for d in "fb"}
        s = states["f"][0] @ self.p["Vf"] + states["b"][0][::-1] @ self.p["Vb"] + self.p["v"]
        s = softmax(s)
        s[:, np.arange(len(y)), y] -= 1
        s *= (mask / mask.sum())[..., None]
        grad = {"v": s.sum((0, 1))}
        for d in "fb":
            out, tape = states[d]
            xs, ds = (x, s) if d == "f" else (x[::-1], s[::-1])
            e, u, c, v = (self.p[k + d] for k in "EUCV")
            h_n = c.shape[0]
            gu, gc = np.zeros_like(u), np.zeros_like(c)
            gates = np.empty((*xs.shape, 3 * h_n), e.dtype)
            grad["V" + d] = np.einsum("tlh,tlk->hk", out, ds)
            dh = np.zeros_like(out[0])
            for t in range(len(xs) - 1, -1, -1):
                h, r, z, rh, n = tape[t]
                dh = dh + ds[t] @ v.T
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                drh = dn @ c.T
                dr = drh * h * r * (1 - r)
                dg = np.concatenate((dr, dz), 1)
                gc += rh.T @ dn
                gu += h.T @ dg
                gates[t, :, : 2 * h_n], gates[t, :, 2 * h_n :] = dg, dn
                dh = dh * z + drh * r + dg @ u.T
            grad |= {"E" + d: _by_byte(xs.ravel(), gates.reshape(-1, 3 * h_n)), "U" + d: gu, "C" + d: gc}
        return grad


def _by_byte(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of the rows of each byte."""
    out = np.zeros((256, rows.shape[1]), rows.dtype)
    by = np.argsort(at, kind="stable")
    at = at[by]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    out[at[first]] = np.add.reduceat(rows[by], first)
    return out


def softmax(s: np.ndarray) -> np.ndarray:
    s = np.exp(s - s.max(-1, keepdims=True))
    return s / s.sum(-1, keepdims=True)


def train(samples: list[tuple[bytes, str]], hidden: int = HIDDEN, epochs: int = 6, lanes: int = 256, rate: float = 0.02, seed: int = 7) -> Network:
    """From (bytes, language) samples, each read up to ``STRETCH`` bytes; Adam, the rate falling to a tenth."""
    langs = sorted({k for _, k in samples})
    rng = np.random.default_rng(seed)
    net = Network.fresh(langs, hidden, rng)
    x, mask = lanes_of([b for b, _ in samples])
    y = np.array([langs.index(k) for _, k in samples])
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(v) for k, v in net.p.items()}
    steps, total = 0, epochs * -(-len(samples) // lanes)
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for at in range(0, len(order), lanes):
            some = order[at : at + lanes]
            steps += 1
            lr = rate * (1 - 0.9 * steps / total)
            for k, g in net.gradients(x[:, some], y[some], mask[:, some]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.p[k] -= (lr * (m[k] / (1 - 0.9**steps)) / (np.sqrt(v[k] / (1 - 0.99**steps)) + 1e-8)).astype(np.float32)
    return net


def lanes_of(stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(STRETCH, n) bytes padded with zeros, and 1.0 where there is a byte."""
    flat = np.zeros((len(stretches), STRETCH), np.uint8)
    for i, b in enumerate(stretches):
        flat[i, : len(b)] = np.frombuffer(b[:STRETCH], np.uint8)
    size = np.array([min(len(b), STRETCH) for b in stretches])
    mask = (np.arange(STRETCH)[:, None] < size).astype(np.float32)
    return np.ascontiguousarray(flat.T), mask


def pooled(net: Network, texts: list[str]) -> np.ndarray:
    """(texts, languages): the mean of the positions' probabilities over each whole text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    counts = np.array([-(-len(b) // STRETCH) for b in raw], np.int64)
    flat = np.frombuffer(b"".join(b.ljust(int(n) * STRETCH, b"\0") for b, n in zip(raw, counts, strict=True)), np.uint8).reshape(-1, STRETCH)
    owner = np.repeat(np.arange(len(raw)), counts)
    first = np.cumsum(counts) - counts
    left = np.array([len(b) for b in raw])[owner] - (np.arange(len(owner)) - first[owner]) * STRETCH
    sums = np.zeros((len(raw), len(net.langs)))
    for at in range(0, len(flat), LANES):
        x = np.ascontiguousarray(flat[at : at + LANES].T)
        s = net.logits(x)
        s -= s.max(-1, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(-1, keepdims=True)
        s *= (np.arange(STRETCH)[:, None] < left[at : at + LANES])[..., None]
        np.add.at(sums, owner[at : at + LANES], s.sum(0))
    size = np.maximum(1, [len(b) for b in raw])
    return sums / size[:, None]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sample(docs: DataFrame, per_lang: int = 600, stretches: int = 4) -> list[tuple[bytes, str]]:
    """Training stretches: of ``per_lang`` documents of each language at most (those of the smallest hashes; copies of a text count as one), ``stretches`` places in each text."""
    from pyspark.sql import Window as W

    room = F.greatest(F.length("text") - STRETCH + 1, F.lit(1))
    at = F.transform(F.sequence(F.lit(0), F.lit(stretches - 1)), lambda i: F.substring("text", (F.pmod(F.hash("h", i), room) + 1).cast("int"), F.lit(STRETCH)))
    rows = docs.where("lang is not null and length(text) > 0").select("lang", "text", F.xxhash64("text").alias("h")).select("lang", "h", at.alias("s"))
    # By hash about half as many again as are wanted, so that few rows of a language meet in one task. A row per language is broadcast: the network has an output for each.
    n = docs.where("lang is not null and length(text) > 0").groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("n"))
    place = F.pmod(F.col("h"), F.lit(1 << 30))
    near = place * F.col("n") < F.lit((1.5 * per_lang + 100) * (1 << 30))
    once = rows.join(F.broadcast(n), "lang").where(near).groupBy("lang", "h").agg(F.first("s").alias("s"))
    some = once.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(place, "h"))).where(F.col("rank") <= per_lang)
    got = some.select("lang", "h", "s").collect()
    return [(s.encode("utf-8", "surrogatepass")[:STRETCH], r["lang"]) for r in sorted(got, key=lambda r: (r["lang"], r["h"])) for s in r["s"] if s]


def predicted(spark: SparkSession, docs: DataFrame, learn: DataFrame, per_lang: int = 600) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs`` (doc_id, text), learned from ``learn`` (doc_id, text, lang).

    The training sample is bounded by ``per_lang`` distinct texts a language; every
    whole text is predicted. ``und`` with score 0 for a null text, one without a
    letter, or if there was nothing to learn from. Of equal probabilities the
    language first by name wins; repeated rows get equal answers and are one
    text in training; a very long text is read whole, some stretches at a time;
    other columns of ``docs``, of whatever name, are left out; empty tables give
    no rows.
    """
    samples = sample(learn, per_lang)
    net = train(samples) if samples else None

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column("text").to_pylist()
                known = [i for i, t in enumerate(texts) if net and t and _LETTER.search(t)]
                lang, score = ["und"] * len(texts), [0.0] * len(texts)
                if known:
                    for i, p in zip(known, pooled(net, [texts[i] for i in known]), strict=True):
                        best = int(p.argmax())
                        lang[i], score[i] = net.langs[best], float(min(1.0, p[best]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")
