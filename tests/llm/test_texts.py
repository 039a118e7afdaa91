"""Operators over documents against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keystrata.llm import langid, mixing, pieces, quality, setjoin, shingles, suffix_dedup, token_files, winnow
from keystrata.llm.queries import tokenizer_file
from keystrata.llm.suffixes import common_prefixes, suffix_array
from keystrata.llm.util import asked

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def some_docs(n=60, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeñüß") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.2:
            t = (rng.choice([x for x in texts if x]) or "x").split(" ")
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            t = " ".join(t)
        elif texts and kind < 0.35:
            t = " ".join(rng.choice(words) for _ in range(80)) + " " + rng.choice([x for x in texts if x])[:700] + " end " + rng.choice(words)
        else:
            t = " ".join(rng.choice(words) + rng.choice(["", "", "", ".", "\n", "#"]) for _ in range(rng.randint(1, 260)))
        texts.append(t)
    texts += [None, "", "   \n ", "A b\tC", "One two three four five six", "one TWO three four five six", "### $$$ 12", "日本語 テキスト ▁ x", "x" * 3000]
    rows = [(i * 3, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s2", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [rows[0]]  # one row twice


@pytest.fixture(scope="module")
def rows():
    return some_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(spark, docs, rows, none):
    got = {r["doc_id"]: r for r in quality.with_verdicts(spark, docs).collect()}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        c = Counter(zip(w, w[1:], w[2:]))
        inside = {k + j for k in range(len(w) - 2) for j in range(3) if c[tuple(w[k : k + 3])] > 1}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(inside) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality.with_verdicts(spark, none).count() == 0
    assert quality.passed(spark, docs).columns == docs.columns


def test_quality_rejects_outliers(spark):
    rng = random.Random(1)
    clean = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(80)), "en", "s", 0) for i in range(300)]
    odd = [(1000 + i, " ".join("ab###$$" + str(k) for k in range(80)), "en", "s", 0) for i in range(10)]
    repeated = [(2000, ("a b c d e f g h i j " * 40).strip(), "en", "s", 0)]
    df = spark.createDataFrame(clean + odd + repeated, SCHEMA)
    kept = {r["doc_id"] for r in quality.passed(spark, df).collect()}
    assert kept == set(range(300))


def test_quality_rejects_repeated_lines_and_repeated_words(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    words = lambda n: " ".join(word() for _ in range(n))
    texts = {i: "\n".join(words(10) for _ in range(8)) for i in range(300)}
    one = [words(10) for _ in range(8)]
    texts[1000] = "\n".join([*one, one[3]])  # one repeated line
    texts[2000] = "\n".join([words(10) for _ in range(8)] + [w for _ in range(30) for w in ("abcd", word())])  # half of its lines
    texts[2001] = "\n".join([words(30) for _ in range(8)] + ["abcd efgh"] * 40)  # nearly all of its lines
    run = words(200)
    texts[2002] = "\n".join([words(450), run, run])  # 47 % of its words
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], SCHEMA)
    got = {r["doc_id"]: r for r in quality.with_verdicts(spark, df).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert {i for i, r in got.items() if not r["kept"]} == {2000, 2001, 2002}


def brute_mcd(x, half, floors, above, prior, rng, starts=60):
    """The least determinant that concentration from random starts finds: (mean, covariance, log determinant of its factor)."""
    best = None
    for _ in range(starts):
        inside = x[rng.permutation(len(x))[: max(3, len(x) // 8)]]
        for _ in range(12):
            n = len(inside)
            m1, m2 = inside.mean(0), inside.T @ inside / n
            if above is not None:
                m1, m2 = (n * m1 + prior * above[0]) / (n + prior), (n * m2 + prior * above[1]) / (n + prior)
            cov = m2 - np.outer(m1, m1) + np.diag(floors**2)
            d = ((x - m1) @ np.linalg.inv(cov) * (x - m1)).sum(1)
            inside = x[np.argsort(d)[: -(-int(half * len(x) * 1000) // 1000)]]
        det = np.linalg.slogdet(cov)[1] / 2
        if best is None or det < best[0]:
            best = det, m1, m2, cov
    return best


def test_quality_estimates_have_the_least_determinant(spark):
    rng = np.random.default_rng(3)
    floors = np.array(list(quality.VECTOR.values()))
    parts = {("=a", "=s"): 300, ("=a", "=t"): 12, ("=b", "=s"): 90}
    x, tags = [], []
    for k, (tag, n) in enumerate(parts.items()):
        good = rng.normal(0, 0.1, (n, 4)) @ rng.normal(0, 1, (4, 4)) + k * 0.1
        good[: n // 5] += rng.normal(2.0, 0.3, (n // 5, 4))  # a fifth far away
        x.append(good)
        tags += [tag] * n
    fixed = np.round(np.concatenate(x) * quality.UNIT).astype(int)
    json = lambda *t: "[" + ",".join(f'"{v}"' for v in t) + "]"
    df = spark.createDataFrame([(json(a, b), json(a), *map(int, v)) for (a, b), v in zip(tags, fixed)], "g string, g1 string, x0 long, x1 long, x2 long, x3 long")
    got = {(r["level"], r["g"]): r for r in quality._mcd(spark, df, 50.0, 0.75, 6).collect()}
    assert len(got) == 1 + 2 + 3
    v = fixed / quality.UNIT
    levels = [{"[]": v}, {json(t): v[[a == t for a, _ in tags]] for t in ("=a", "=b")}, {json(a, b): v[[t == (a, b) for t in tags]] for a, b in parts}]
    up = {json("=a"): "[]", json("=b"): "[]"} | {json(a, b): json(a) for a, b in parts}
    above = {}
    for level, groups in enumerate(levels):
        for g, rows in groups.items():
            det, m1, m2, cov = brute_mcd(rows, 0.75, floors, above.get(up.get(g)), 50.0, rng)
            above[g] = m1, m2
            r = got[level, g]
            low = np.array([[r[f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
            assert r["log_det"] <= det + 0.1, g
            assert np.abs([r[f"m{i}"] - m1[i] for i in range(4)]).max() < 0.1, g
            assert np.abs(low @ low.T - cov).max() < 0.1 * np.abs(cov).max(), g


def test_quality_steps_are_planned_once(spark):
    """A step is a job, and one for what it broadcasts: plans that Spark makes anew after each shuffle fill the driver."""
    df = spark.createDataFrame([(f"g{i % 6}", f"g{i % 2}", i % 7, i % 5, i % 3, i) for i in range(60)], "g string, g1 string, x0 long, x1 long, x2 long, x3 long")
    names = ["spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions"]
    before = [spark.conf.get(k) for k in names]

    def jobs(steps):
        spark.sparkContext.setJobGroup(f"steps-{steps}", "")
        assert quality._mcd(spark, df, 50.0, 0.75, steps).count() == 9
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"steps-{steps}"))

    try:
        assert jobs(3) - jobs(1) <= 2 * 2
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [spark.conf.get(k) for k in names] == before


def test_quality_repeats_with_clashing_hashes(spark, monkeypatch):
    monkeypatch.setattr(quality, "_POS_BITS", 60)  # four bits of hash are left: nearly all clash
    w = [random.Random(3).choice("abc") for _ in range(60)]
    df = spark.createDataFrame([(1, " ".join(w), "en", "s", 0)], SCHEMA)
    c = Counter(zip(w, w[1:], w[2:]))
    want = len({k + j for k in range(58) for j in range(3) if c[tuple(w[k : k + 3])] > 1})
    assert quality.statistics(df).first()["n_repeat_words"] == want


def brute_winnow(text, k, w):
    h = winnow.kgram_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32), k).tolist()
    out, width = [], min(w, len(h))
    for i in range(len(h) - width + 1 if h else 0):
        p = max(range(i, i + width), key=lambda j: (-h[j], j))
        if not out or out[-1] != (h[p], p):
            out.append((h[p], p))
    return out


def test_winnow_matches_brute_force(monkeypatch):
    rng = random.Random(2)
    for n in (0, 1, 5, 30, 200, 700):
        t = "".join(rng.choice("abé") for _ in range(n))
        want = brute_winnow(t, 5, 9)
        assert list(zip(*(x.tolist() for x in winnow.winnow(t, 5, 9)))) == want
    t = "".join(rng.choice("ab") for _ in range(500))
    monkeypatch.setattr(winnow, "_SPAN", 64)  # long texts go in stretches
    monkeypatch.setattr(winnow, "_POS_BITS", np.uint64(6))
    assert list(zip(*(x.tolist() for x in winnow.winnow(t, 5, 9)))) == [(h & (2**58 - 1), p) for h, p in brute_winnow(t, 5, 9)]


def test_winnow_of_a_very_long_text():
    rng = np.random.default_rng(5)
    t = bytes(rng.integers(97, 100, (1 << 20) + 300_000).astype(np.uint8)).decode()
    hashes, places = winnow.winnow(t)
    assert (np.diff(places) > 0).all() and places[-1] > 1 << 20 and np.diff(places).max() <= winnow.WINDOW
    h = winnow.kgram_hashes(np.frombuffer(t.encode("utf-32-le"), np.uint32))
    assert (h[places] == hashes).all()
    for a in [0, (1 << 20) - 200, (1 << 20) - 40, (1 << 20) + 5, len(h) - winnow.WINDOW]:
        window = h[a : a + winnow.WINDOW]
        assert a + int(np.flatnonzero(window == window.min())[-1]) in places
    assert len(winnow.shown((hashes, places))) == 20 * len(places)


def test_winnow_guarantee():
    rng = random.Random(4)
    part = "".join(rng.choice("abcdefgh ") for _ in range(winnow.K + winnow.WINDOW - 1))
    a, b = ("".join(rng.choice("xyz") for _ in range(300)) for _ in range(2))
    one, two = winnow.winnow(a + part + b), winnow.winnow(b + part + a)
    assert set(one[0].tolist()) & set(two[0].tolist())


@pytest.mark.parametrize("quantiles", [4096, 7])
def test_fingerprints(spark, docs, rows, none, monkeypatch, quantiles):
    monkeypatch.setattr(winnow, "QUANTILES", quantiles)
    got = {}
    for r in winnow.fingerprints(spark, docs.selectExpr("*", "1 as part", "2 as at", "3 as tail"), part_bytes=1000).collect():
        got.setdefault(r["doc_id"], []).append(r)
    ordered = sorted(rows, key=lambda r: -r[0])
    assert sum(map(len, got.values())) == len(rows)
    for (i, t, *_), (_, after, *_) in zip(ordered, ordered[1:] + ordered[:1]):
        t, after = t or "", after or ""
        if len(got[i]) > 1:
            continue
        r, new = got[i][0], winnow.edited(t, after)
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == winnow.shown(winnow.winnow(t)) and r["edited_fingerprint"] == winnow.shown(winnow.winnow(new))
        assert r["near_next"] == winnow.likeness(winnow.winnow(t), winnow.winnow(after))
    assert winnow.fingerprints(spark, none).count() == 0
    alone = winnow.fingerprints(spark, docs.where("doc_id = 3")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_token_files(spark, docs, rows, none, tmp_path, encoding):
    from tokenizers import Tokenizer

    file = tokenizer_file("byte_bpe_50k.json")
    path = token_files.written(spark, docs, file, 2, f"file://{tmp_path}/t", encoding=encoding)
    plain = Tokenizer.from_file(file)
    ids = {i: plain.encode(t or "", add_special_tokens=False).ids + [2] for i, t, *_ in rows}
    stored = sorted((r["part"], r["seq"], r["doc_id"], r["ids"]) for r in token_files.read(spark, path).collect())
    assert [s[2] for s in stored] == sorted(r[0] for r in rows)
    at = 0
    want = []
    for _, _, i, found in stored:
        assert found == ids[i]
        want.append((i, at, len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
        at += len(found)
    assert sorted(map(tuple, token_files.placed(spark, path).collect())) == sorted(want)
    assert token_files.round_trip(spark, none, file, 2).count() == 0


def test_token_files_layout(spark, docs, tmp_path):
    import pyarrow.parquet as pq

    path = token_files.written(spark, docs, tokenizer_file("byte_bpe_50k.json"), 2, f"file://{tmp_path}/t")
    meta = [pq.ParquetFile(p).metadata for p in tmp_path.glob("t/part-*")]
    columns = [m.row_group(0).column(c) for m in meta if m.num_row_groups for c in range(m.num_columns)]
    ids = [c for c in columns if c.path_in_schema.startswith("ids")]
    assert ids and all("DELTA_BINARY_PACKED" in c.encodings and c.has_offset_index and c.has_column_index for c in ids)


def _scanned(df):
    """Rows that the file scan of a plan handed on."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            p = p.executedPlan()
        if p.getClass().getSimpleName() == "FileSourceScanExec":
            found.append(p.metrics().apply("numOutputRows").value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(plan)
    return sum(found)


def test_token_files_are_read_in_part(spark, tmp_path):
    import pyarrow.parquet as pq

    df = spark.range(20_000).selectExpr("id as doc_id", "concat('text number ', id, ' of many') as text")
    file = tokenizer_file("byte_bpe_50k.json")
    path = token_files.written(spark, df, file, 2, f"file://{tmp_path}/t", parts=2, row_group=64 << 10, page=4 << 10, page_rows=100)
    some = token_files.read(spark, path).where("doc_id between 7000 and 7009")
    assert [r["doc_id"] for r in sorted(some.collect())] == list(range(7000, 7010))
    assert 10 <= _scanned(some.select("doc_id", "ids")) <= 300  # a page or two of 20,000 rows
    groups = [pq.ParquetFile(p).metadata.row_group(0) for p in tmp_path.glob("t/part-*")]
    size = lambda name: sum(g.column(c).total_compressed_size for g in groups for c in range(g.num_columns) if g.column(c).path_in_schema.startswith(name))
    assert (size("doc_id") + size("n_tokens")) * 4 < size("ids")  # what a read of the metadata alone leaves out
    assert "ids" not in token_files.read(spark, path).select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_encoder_equals_plain_encoding(monkeypatch):
    from tokenizers import Tokenizer

    file = tokenizer_file("byte_bpe_50k.json")
    encoder, plain = token_files.Encoder(file), Tokenizer.from_file(file)
    rng = random.Random(6)
    parts = ["a", "b ", " c", "  ", "\n", "é", "'s", "12", ".", "日", "\t", "x y", "\0", " wörd", "\x1c", "\x85", "\u3000", " ", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)] + [None]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>\n<|endoftext|> y", "a <|endof text|> b <|endoftext| >"]
    assert plain.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    monkeypatch.setattr(token_files, "CACHED", 300)  # so that stretches are forgotten as well
    for at in range(0, len(texts), 7):
        some = texts[at : at + 7]
        for got, t in zip(encoder.encode(pa.array(some), [2]).to_pylist(), some, strict=True):
            assert got == [*plain.encode(t or "", add_special_tokens=False).ids, 2], repr(t)


def test_encoder_knows_words_without_their_points():
    import pyarrow as pa
    from tokenizers import Tokenizer

    file = tokenizer_file("byte_bpe_50k.json")
    plain, rng = Tokenizer.from_file(file), random.Random(23)
    words = ["".join(rng.choice(["th", "er", "é", "ou", "Ab"]) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    ends = ["", ".", ",", "...", ".\n", "!\n", ".\n\n", "\n", ".'s", "'t.", ".5", "5.\n", ".\u0301", "\u0301.", ";-", "-;\n", "\t", ".\r\n"]
    texts = ["".join(rng.choice(words) + rng.choice(ends) + rng.choice(["", " ", " ", " ", " ."]) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    texts += ["a.\nb.\nc", "a.b.c", ".\na", "a .\nb c", "a.\0b", None, "", ".", "a", "a.\n"]
    encoder = token_files.Encoder(file)
    for at in range(0, len(texts), 400):
        some = texts[at : at + 400]
        assert encoder.encode(pa.array(some, pa.string()), [2]).to_pylist() == [plain.encode(t or "", add_special_tokens=False).ids + [2] for t in some]
    encoder = token_files.Encoder(file)
    encoder.encode(pa.array([" ".join(["a", *(w + e for w in words)]) for e in ("", ".", ",", "!", ".\nWas")], pa.string()))
    assert len(encoder.known) <= len(set(words)) + 5


def test_asked_misses_no_key(spark):
    rows = spark.range(20_000).selectExpr("id", "id * 7 as h")
    keys = rows.where("id % 50 = 3")
    got = asked(rows, keys, "id", "h").groupBy((F.col("id") % 50 == 3).alias("key"), "_asked").count().collect()
    found = {(r["key"], r["_asked"]): r["count"] for r in got}
    assert found[True, True] == 400 and (True, False) not in found and found[False, False] > 19_500
    assert asked(rows, keys.limit(0), "id", "h").where("_asked").count() == 0


def test_suffix_array_and_prefixes():
    rng = random.Random(7)
    for _ in range(120):
        b = bytes(rng.choice([0, 1, 1, 2, 255]) for _ in range(rng.randint(1, 90)))
        t, depth = np.frombuffer(b, np.uint8), rng.choice([8, 24, 200, 400])
        order = suffix_array(t, depth)
        assert sorted(order.tolist()) == list(range(len(b)))
        cut = [b[i : i + depth] for i in order]
        assert cut == sorted(cut)
        padded = b + bytes(depth)
        for k, n in enumerate(common_prefixes(t, order, depth).tolist()):
            if k:
                x, y = (padded[order[j] : order[j] + depth] for j in (k - 1, k))
                assert n == next((m for m in range(depth) if x[m] != y[m]), depth)


def brute_removed(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(bytes(gone))
    return out


def brute_digests(rows, length=400, passage=200, words=50):
    raw = [(t or "").encode() for _, t, *_ in rows]
    for (i, *_), t, gone, short in zip(rows, raw, brute_removed(raw, length), brute_removed(raw, passage)):
        cuts = [m.span() for m in re.finditer(b"\1+", short) if len(t[slice(*m.span())].split()) > words]
        left = bytes(c for k, c in enumerate(t) if not any(a <= k < b for a, b in cuts))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        yield (i, len(t), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest(), len(cuts), len(t) - len(left), sum(c & 0xC0 != 0x80 for c in left))


@pytest.mark.parametrize("most", [0, 1, 4096])
def test_suffix_dedup(spark, docs, rows, none, most):
    assert sorted(map(tuple, suffix_dedup.digests(spark, docs, most=most).collect())) == sorted(brute_digests(rows))
    assert suffix_dedup.digests(spark, none).count() == 0


@pytest.mark.parametrize("most", [0, 3, 4096])
def test_suffix_dedup_of_one_passage_in_many_texts(spark, most):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdeü") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    part = text(90)
    rows = []
    for i in range(60):
        a, b = rng.randrange(0, 40), rng.randrange(50, len(part))
        rows.append((i, text(20) + part[a:b] + rng.choice(["", "a", "ab", "abc"]) + text(20), None, None, None))
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, suffix_dedup.digests(spark, df, most=most).collect())) == sorted(brute_digests(rows))


def test_passages_of_over_fifty_words_go_and_others_stay(spark):
    rng = random.Random(15)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows, planted, cut = [], {}, {}
    for k in range(40):
        part = text(rng.randint(51, 80))
        for copy in range(2 + k % 3):
            i, before, after = 10 * k + copy, text(60), text(60)
            planted[i], cut[i] = part, before + "\n" + "\n" + after
            rows.append((i, before + "\n" + part + "\n" + after, None, None, None))
    clean = {1000 + i: text(rng.randint(60, 200)) for i in range(60)}
    short = text(40)
    clean |= {2000 + i: text(60) + "\n" + short + "\n" + text(60) for i in range(3)}  # forty shared words
    df = spark.createDataFrame(rows + [(i, t, None, None, None) for i, t in clean.items()], SCHEMA)
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.deduplicated(spark, df).collect()}
    assert all(got[i] == t for i, t in clean.items())
    assert all(planted[i] not in got[i] and len(got[i]) <= len(cut[i]) and got[i][:200] == cut[i][:200] for i in planted)


def test_suffix_dedup_keeps_columns_and_whole_characters(spark):
    part = "ü" * 300
    df = spark.createDataFrame([(1, "a" + part + "z", "x"), (2, "b" + part, "y"), (3, None, "z")], "doc_id long, text string, _len string")
    assert sorted(map(tuple, suffix_dedup.deduplicated(spark, df, words=0).collect())) == [(1, "az", "x"), (2, "b", "y"), (3, None, "z")]


def brute_components(rows, words=5, num=75, den=100):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            both = len(a & b)
            if i < j and both and den * both >= num * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("options", [{}, {"rounds": 0}, {"heavy": 3}])
def test_jaccard_join(spark, docs, rows, none, options):
    want = brute_components(rows)
    got = setjoin.joined(spark, docs, **options).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    if not options:
        assert setjoin.joined(spark, none).count() == 0
        assert sorted(r["doc_id"] for r in setjoin.one_of_each(spark, docs).collect()) == sorted({i for i, (_, c) in want.items() if i == c})


def test_jaccard_join_of_one_large_group(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(90):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(t), None, None, None))
    df = spark.createDataFrame(rows, SCHEMA)
    for chunk in (1024, 16):
        monkeypatch.setattr(setjoin, "CHUNK", chunk)
        monkeypatch.setattr(setjoin, "BLOCK", 8)
        for options in ({}, {"rounds": 0}):
            assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.joined(spark, df, **options).collect()} == brute_components(rows)


def test_candidates_of_lists_with_mixed_sizes(spark):
    rng = random.Random(12)
    sized = [(85, 0)] * 64 + [(106, 25)] * 64 + [(81, 1)] * 64
    lists = [(0, n, pos) for n, pos in sized]
    for token in range(1, 4):
        for _ in range(500):
            n = rng.randint(20, 120)
            lists.append((token, n, rng.randint(0, n - -(-75 * n // 100))))
    rows = [(t, rep, n, pos, rep, -1) for rep, (t, n, pos) in enumerate(lists)]
    want = set()
    for x, (t, n, pos) in enumerate(lists):
        for y, (u, m, at) in enumerate(lists):
            if x < y and t == u and min(n - pos, m - at) * 175 >= 75 * (n + m) and 100 * min(n, m) >= 75 * max(n, m):
                want.add((x, y))
    df = spark.createDataFrame(rows, "token long, rep long, n long, pos int, comp long, pivot_overlap long")
    assert set(map(tuple, setjoin._candidates(df, 75, 100).collect())) == want


def test_shingles_depend_on_words_alone():
    a, n = shingles.shingle_sets([b"A b  c d e f", b"x", b"", b"a B c\td e\nF", b"\n"])
    assert n.tolist() == [2, 1, 0, 2, 0]
    assert a[:2].tolist() == a[3:].tolist()


def brute_targets(sizes, most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return out | share
        out |= {s: most * sizes[s] for s in over}
        free -= over


def test_mix(spark, docs, rows, none):
    got = mixing.mix(spark, docs).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = brute_targets(dict(sizes))
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], rel=0.02, abs=60)
    again = mixing.mix(spark, docs.repartition(7)).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(spark, none).count() == 0
    assert mixing.mixed(spark, docs).columns == docs.columns


def test_mixed_documents_meet_the_targets(spark):
    rng = random.Random(16)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), "en", rng.choice(["s1", "s1", "s1", "s2", "s3", None]), None) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(t.split())
    got = mixing.mixed(spark, df).select("source", F.size(F.split("text", " ")).alias("n")).groupBy("source").agg(F.sum("n").alias("n")).collect()
    want = brute_targets(dict(sizes))
    assert {r["source"]: r["n"] for r in got} == pytest.approx(want, rel=0.06)


def test_targets_with_capped_sources(spark):
    sizes = {"a": 1000, "b": 10, "c": 5, "d": 0, None: 40}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def brute_best(p, text):
    score, back = [0.0], [()]
    for e in range(1, len(text) + 1):
        best = None
        for a in range(e):
            i = p.index.get(text[a:e])
            if i is not None and (best is None or score[a] + p.scores[i] > best[0]):
                best = (score[a] + p.scores[i], (*back[a], i))
        if text[e - 1] not in p.single and (best is None or score[e - 1] + p.unknown > best[0]):
            best = (score[e - 1] + p.unknown, (*back[e - 1], *(p.byte_ids[b] for b in text[e - 1].encode())))
        score.append(best[0])
        back.append(best[1])
    return back[-1]


def test_pieces_find_the_best_segmentation():
    names = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), "▁", "a", "b", "ab", "▁a", "▁ab", "ba", "aba", "bab", "▁▁"]
    rng = random.Random(9)
    scores = [0.0] * 257 + [-float(rng.randint(1, 9)) for _ in names[257:]]
    p = pieces.Pieces(names, scores, [i > 256 for i in range(len(names))], list(range(1, 257)))
    p.index, p.scores = {n: i for i, n in enumerate(names) if i > 256}, scores
    for _ in range(300):
        t = "".join(rng.choice("▁aabbé") for _ in range(rng.randint(1, 12)))
        assert p.best(t) == brute_best(p, t)


def test_pieces_of_a_model_of_merges_are_the_fewest():
    import sentencepiece

    file = tokenizer_file("piece_bpe_32k.model")
    p, library = pieces.Pieces.load(file), sentencepiece.SentencePieceProcessor(model_file=file)
    rng = random.Random(17)
    for _ in range(200):
        t = " ".join("".join(rng.choice(["the", "tion", "er", "in", "ou", "w", "é"]) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 8)))
        ids = p.encode(t)
        assert "".join(library.id_to_piece(i) for i in ids) == "▁" + t.replace(" ", "▁") and len(ids) <= len(library.encode(t))


def test_pieces_round_trip(spark, docs, rows, none):
    file = tokenizer_file("piece_bpe_32k.model")
    clash = docs.selectExpr("*", "1 as ids", "2 as decoded")
    for r in pieces.decoded(pieces.encoded(clash, file), file, ids="ids_1").collect():
        assert (r["ids"], r["decoded"]) == (1, 2) and r["decoded_1"] == r["text"] and (r["ids_1"] is None) == (r["text"] is None)
    for r in pieces.decoded(pieces.encoded(docs, file), file).collect():
        assert r["decoded"] == r["text"] and (r["ids"] is None) == (r["text"] is None)
    p = pieces.Pieces.load(file)
    rng = random.Random(10)
    for _ in range(300):
        t = "".join(rng.choice(["a", " ", "  ", "▁", "é", "\n", "日本", "\ufffd", "\0", "the "]) for _ in range(rng.randint(0, 30)))
        assert p.decode(p.encode(t)) == t
    assert pieces.encoded(none, file).count() == 0


def test_pieces_there_and_back_are_one_pass(spark, docs):
    import corpus_pipeline

    file = tokenizer_file("piece_bpe_32k.model")
    for some in (docs, docs.selectExpr("*", "1 as ids", "2 as decoded")):
        one, two = pieces.round_trip(some, file), pieces.decoded(pieces.encoded(some, file), file, ids="ids_1" if "ids" in some.columns else "ids")
        assert one.columns == two.columns and sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
    whole = docs.selectExpr("doc_id", "text", "'l' as lang", "'s' as source")
    plan = corpus_pipeline.piece_ids(spark, whole, "")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # a second one would hold a second worker and vocabulary a core


def test_language(spark, none):
    rng = random.Random(11)
    parts = {"en": ["the", "and", "of", "ing", "wh"], "es": ["ción", "que", "ñ", "os", "ar"], "de": ["sch", "ung", "ü", "der", "ein"]}
    rows = []
    for i in range(420):
        k = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[k]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60))), k, None, None))
    df = spark.createDataFrame([*rows, (1000, None, "en", None, None), (1001, "12 !!", "en", None, None), (1002, "", None, None, None)], SCHEMA)
    held = langid.held_out(df["doc_id"])
    got = {r["doc_id"]: r for r in langid.predicted(spark, df, df.where(~held)).collect()}
    assert len(got) == 423
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in test) >= 0.95 * len(test)
    assert {r["lang_pred"] for r in langid.predicted(spark, df, none).collect()} == {"und"}
    assert langid.predicted(spark, none, none).count() == 0


def test_language_sample_takes_copies_once(spark):
    texts = [(f"text number {i} " * 9, "en" if i % 2 else "de") for i in range(60)]
    df = spark.createDataFrame(texts, "text string, lang string")
    got = langid.sample(spark.createDataFrame(texts * 40, "text string, lang string"), per_lang=10)
    assert len(got) == 2 * 10 * 4 and got == langid.sample(df, per_lang=10)


def test_language_gradients():
    rng = np.random.default_rng(0)
    net = langid.Network.fresh(["a", "b"], 3, rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, 5, (6, 4)).astype(np.uint8), np.array([0, 1, 1, 0])
    mask = np.ones((6, 4))
    mask[4:, 1] = 0

    def loss():
        s = langid.softmax(net.logits(x))
        return -(np.log(s[:, np.arange(4), y]) * mask).sum() / mask.sum()

    grad = net.gradients(x, y, mask)
    for k, g in grad.items():
        at = tuple(rng.integers(0, min(n, 5)) for n in g.shape)
        old, e = net.p[k][at], 1e-4
        net.p[k][at] = old + e
        up = loss()
        net.p[k][at] = old - e
        down = loss()
        net.p[k][at] = old
        assert g[at] == pytest.approx((up - down) / 2 / e, rel=0.05, abs=2e-4), k


def test_clashing_column_names(spark, rows):
    names = ["_id", "_h", "_t", "_n", "_copies", "at", "len", "_len", "_text", "id", "h", "tokens", "rep", "g", "x0", "kept"]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *(f"doc_id + {i} as `{n}`" for i, n in enumerate(names)))
    for f in (quality.passed, setjoin.one_of_each, suffix_dedup.deduplicated, mixing.mixed):
        out = f(spark, df)
        assert out.columns == df.columns
        assert all(r[n] == r["doc_id"] + i for r in out.collect() for i, n in enumerate(names))


def test_operators_leave_other_columns_out(spark, rows):
    names = ["ids", "part", "seq", "n_tokens", "start", "h", "s", "n", "rank", "lang_pred", "score", "at", "tail"]
    plain = spark.createDataFrame(rows, SCHEMA)
    df = plain.selectExpr("*", *(f"'x' as `{n}`" for n in names))
    file = tokenizer_file("byte_bpe_50k.json")
    assert sorted(map(tuple, token_files.round_trip(spark, df, file, 2).collect())) == sorted(map(tuple, token_files.round_trip(spark, plain, file, 2).collect()))
    one, two = (sorted(map(tuple, langid.predicted(spark, d, d).collect())) for d in (df, plain))
    assert one == two and len(one) == len(rows)


def test_language_of_long_and_repeated_texts(spark):
    rows = [(i, f"{w} " * 40, w) for i in range(40) for w in ("alpha", "omega")]
    docs = spark.createDataFrame(rows + [(100, "omega " * 300_000, None), (101, "omega " * 300_000, None), (101, "omega " * 300_000, None)], "doc_id long, text string, lang string")
    got = langid.predicted(spark, docs, docs).where("doc_id >= 100").collect()
    assert len(got) == 3 and {r["lang_pred"] for r in got} == {"omega"} and len({r["score"] for r in got}) == 1


def test_jaccard_join_over_many_hand_overs(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(setjoin, "HELD", 300)
    monkeypatch.setattr(setjoin, "COMMON", 3)
    monkeypatch.setattr(setjoin, "BATCH_BYTES", 2000)
    got = setjoin.joined(spark, docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


def test_shared_counts_are_never_too_low(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(setjoin, "HELD", 300)
    monkeypatch.setattr(setjoin, "COMMON", 3)
    packed = setjoin._summed_up(docs, 5, 64).cache()
    got = {r["id"]: r["shared"] for r in setjoin._shared(packed, 64).collect()}
    texts = {(t or "").encode() for _, t, *_ in rows}
    sets = {}
    for t in texts:
        h, n = shingles.shingle_sets([t])
        if n[0]:
            sets[hashlib.blake2b(h.tobytes(), digest_size=16).digest()] = set(h.tolist())
    df = Counter(x for s in sets.values() for x in s)
    for d, s in sets.items():
        want = sum(df[x] > 1 for x in s)
        assert got.get(int.from_bytes(d[:8], "big", signed=True), 0) >= want


def test_jaccard_join_gives_python_small_batches(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(10**5)}" for _ in range(50)) + " same" * 20_000) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))

    def seen(batches):
        for b in batches:
            with open(tmp_path / "sizes", "a") as f:
                f.write(f"{b.nbytes}\n")
            yield b

    docs = spark.read.parquet(str(tmp_path / "docs")).mapInArrow(seen, "doc_id long, text string")
    assert setjoin.joined(spark, docs).count() == 200
    setjoin.loads(docs, 5)
    assert max(map(int, (tmp_path / "sizes").read_text().split())) < 4_000_000


def test_shared_shingles_are_counted_a_slice_at_a_time():
    rng = np.random.default_rng(3)
    ids, size = np.arange(3000), np.full(3000, 600, np.int32)
    tokens = rng.integers(0, 1 << 32, 1_800_000, np.uint32)
    tokens[::7] = tokens[0]
    packed = [[ids[a : a + 500].tobytes(), size[a : a + 500].tobytes(), tokens[a * 600 : (a + 500) * 600].tobytes()] for a in range(0, 3000, 500)]
    tracemalloc.start()
    got = Counter()
    for b in setjoin._counted(packed):
        for i, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got[i] += n
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    owner = np.repeat(ids, size)
    _, token = np.unique(tokens, return_inverse=True)
    pairs = np.unique(np.stack((token, owner)), axis=1)
    several = np.bincount(pairs[0]) > 1
    want = np.bincount(owner[several[token]], minlength=3000)
    assert got == Counter({i: n for i, n in enumerate(want.tolist()) if n})
    assert not packed and peak < 40_000_000


def test_candidates_are_handed_on_in_parts(spark, monkeypatch):
    rng = random.Random(13)
    rows = [(i % 3, i, 40, rng.randint(0, 10), i, -1) for i in range(150)]
    df = spark.createDataFrame(rows, "token long, rep long, n long, pos int, comp long, pivot_overlap long")
    want = {(x, y) for x, (t, _, _, p, _, _) in enumerate(rows) for y, (u, _, _, q, _, _) in enumerate(rows) if x < y and t == u and (40 - max(p, q)) * 175 >= 75 * 80}
    for pairs in (1, 50, 1 << 17):
        monkeypatch.setattr(setjoin, "PAIRS", pairs)
        got = list(map(tuple, setjoin._candidates(df, 75, 100).collect()))
        assert len(got) == len(want) and set(got) == want
