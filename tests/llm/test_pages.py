"""WARC files and URL filters against brute force."""

import gzip
import hashlib
import random
from collections import Counter, defaultdict

import pytest

from keystrata.llm import urltree, warc
from keystrata.llm.queries import URL_RULES


def pages(spark):
    body = "<p>" + "same text " * 20 + "</p>"
    rows = [(5, "http://a/x", body), (3, "http://b/y\r\nz", body), (9, None, body), (1, "u", "short"), (2, "u", "short"), (4, "v", None), (6, "w", ""), (7, "é", "WARC/1.0\r\nWARC-Type: response\r\n\r\n" * 9), (9, None, body), (None, "n", "x" * 200)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    got, gaps = warc.read(spark, warc.written(spark, warc.records(spark, df), f"file://{tmp_path}/w", 500))
    assert gaps.count() == 0
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == raw and j is not None]
        first = min(same) if same else None
        again = len(raw) >= 100 and len([1 for _, _, h in rows if h == html]) > 1 and first is not None and i != first
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())) == sorted(map(key, want))
    names = [p for p in tmp_path.glob("w/volume=*/part-*")]
    assert names and all(gzip.decompress(p.read_bytes()).startswith(b"WARC/1.0\r\n") for p in names)
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_warc_leaves_other_columns_out(spark):
    _, df = pages(spark)
    more = df.selectExpr("*", *(f"'x' as `{n}`" for n in ("record", "n", "digest", "refers_to", "p", "d", "volume", "copies")))
    key = lambda d: sorted(map(repr, d.drop("file", "offset", "block").collect()))
    assert key(warc.round_trip(spark, more)) == key(warc.round_trip(spark, df))


def one(n, body=b"hello"):
    digest = hashlib.sha256(body).hexdigest()
    return f"WARC/1.0\r\nWARC-Type: response\r\nX-Page: {n}\r\nWARC-Block-Digest: sha256:{digest}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def numbers(s):
    return [r.headers["x-page"] for r in s.records]


def test_salvage_of_plain_archives():
    a, b, c = one(1), one(2, b"x" * 500), one(3)
    assert numbers(warc.salvaged(a + b + c)) == ["1", "2", "3"]
    assert warc.salvaged(b"") == warc.Salvage()
    hurt = bytearray(a + b + c)
    hurt[len(a) + len(b) - 100] ^= 1
    s = warc.salvaged(bytes(hurt))
    assert numbers(s) == ["1", "3"]
    assert [(g.offset, g.length) for g in s.gaps] == [(len(a), len(b))] and "digest" in s.gaps[0].reason
    s = warc.salvaged(b"junk" + a + b[:-60])
    assert numbers(s) == ["1"] and [(g.offset, g.length) for g in s.gaps] == [(0, 4), (4 + len(a), len(b) - 60)]
    s = warc.salvaged(a + b[: len(b) // 2] + c)
    assert numbers(s) == ["1", "3"] and s.gaps[0].offset == len(a)


def test_salvage_of_gzip_archives():
    parts = [gzip.compress(one(n, bytes(random.Random(n).choices(range(256), k=300)))) for n in range(4)]
    hurt = bytearray(b"".join(parts))
    hurt[len(parts[0]) + 40] ^= 255
    s = warc.salvaged(bytes(hurt))
    assert numbers(s) == ["0", "2", "3"]
    assert [(g.offset, g.length) for g in s.gaps] == [(len(parts[0]), len(parts[1]))]
    s = warc.salvaged(b"".join(parts)[:-5])
    assert numbers(s) == ["0", "1", "2"] and s.gaps[0].length == len(parts[3]) - 5


def test_salvage_goes_on_behind_any_damage():
    noise = lambda n: bytes(random.Random(n).choices(range(256), k=3000)).hex().encode()
    parts = [gzip.compress(one(n, noise(n))) for n in range(4)]
    whole = b"".join(parts)
    hurt = b"\0" + whole[1:]  # the first member's header
    s = warc.salvaged(hurt)
    assert numbers(s) == ["1", "2", "3"] and [(g.offset, g.length) for g in s.gaps] == [(0, len(parts[0]))]
    s = warc.salvaged(b"some junk" + whole)
    assert numbers(s) == ["0", "1", "2", "3"] and [(g.offset, g.length) for g in s.gaps] == [(0, 9)]
    single = gzip.compress(b"".join(one(n, noise(n)) for n in range(9)))
    cut = single[: len(single) * 3 // 5]
    s = warc.salvaged(cut)
    assert numbers(s) == ["0", "1", "2", "3", "4"] and [(g.offset, g.length) for g in s.gaps] == [(0, len(cut))]
    broken = bytearray(single)
    broken[len(single) // 2] ^= 255
    got = numbers(warc.salvaged(bytes(broken) + one(20) + parts[1]))
    assert got[:4] == ["0", "1", "2", "3"] and got[-2:] == ["20", "1"]
    stored = gzip.compress(one(5) + one(6, noise(6)), 0)  # bytes as they are: no record is found twice
    assert numbers(warc.salvaged(stored[:-2000])) == ["5"]
    mixed = one(7) + parts[0] + one(8) + parts[1]
    assert numbers(warc.salvaged(mixed)) == ["7", "0", "8", "1"] and not warc.salvaged(mixed).gaps


def brute_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[end:]
    for c in "?#":
        path = path.split(c)[0]
    return "".join(c.lower() if c.isascii() else c for c in rest[:end]), path


def brute_rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def test_urls_and_rules(spark):
    urls = [None, "", "nothing", "http://", "HTTP://A.Example.COM/en/71?x#y", "x://example.com/en/8", "a://net/de/", "b://q.example.net/de/81", "c://example.net/de/7", "d://myexample.net/de/8", "e://x.org/es/1/2/3/4/5/6/7/8/9", "f://x.org?p=/es/", "g://ÄÖ.org#/es/", "h://x.net/de/9://q/"]
    rng = random.Random(1)
    urls += [f"http://{rng.choice(['a.', '', 'b.'])}example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randrange(99)}" for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in urltree.judged(spark, df, URL_RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = brute_split(u)
        rule = brute_rule(host, path)
        assert (got[i]["host"], got[i]["path"]) == (host, path), u
        assert got[i]["rule"] == (rule.name if rule else None)
        if rule:
            assert got[i]["verdict"] == rule.verdict
    assert urltree.judged(spark, df.limit(0), URL_RULES).count() == 0


def test_templates_are_rejected_by_purity(spark):
    rows = [(i, f"http://h/spam/{i}/x") for i in range(60)] + [(100 + i, f"http://h/news/{i}") for i in range(60)] + [(200, "http://h/spam/999/x"), (201, "http://h/news/999")]
    labels = spark.createDataFrame([(i, i < 60) for i, _ in rows if i < 200], "page_id long, bad boolean")
    got = {r["page_id"]: r for r in urltree.judged(spark, spark.createDataFrame(rows, "page_id long, url string"), [], labels).collect()}
    assert got[200]["verdict"] == "block" and got[201]["verdict"] == "allow"
    assert got[200]["template"] == "/spam/*/*" and got[0]["purity"] == pytest.approx(65 / 70)


def brute_tree(rows, apart=0.3, weight=10.0, prior_weight=10.0):
    """(host, segments, label or None) of all pages to each one's (template, purity), by recursion from each host's root."""
    out = [None] * len(rows)
    profile = lambda some, k: (
        Counter({True: "bad", False: "good", None: "none"}[rows[i][2]] for i in some),
        Counter("end" if len(rows[i][1]) == k else "varies" if rows[i][1][k] == "*" else "fixed" for i in some),
    )

    def far(some, others, k):
        way = [sum(abs(a[x] / len(some) - b[x] / len(others)) for x in {*a, *b}) / 2 for a, b in zip(profile(some, k), profile(others, k))]
        return max(way) * len(some) / (len(some) + weight) * len(others) / (len(others) + weight)

    def grow(some, k, template):
        ended = [i for i in some if len(rows[i][1]) == k]
        for i in ended:
            out[i] = template
        children = defaultdict(list)
        for i in some:
            if len(rows[i][1]) > k:
                children[rows[i][1][k]].append(i)
        every = [i for c in children.values() for i in c]
        merged = []
        for s, c in children.items():
            others = [i for i in every if rows[i][1][k] != s]
            if s != "*" and others and far(c, others, k + 1) >= apart:
                grow(c, k + 1, f"{template}/{s}")
            else:
                merged += c
        if merged:
            grow(merged, k + 1, f"{template}/*")

    for host in {h for h, _, _ in rows}:
        grow([i for i, r in enumerate(rows) if r[0] == host], 0, "")
    labels = defaultdict(list)
    for (host, _, bad), t in zip(rows, out):
        labels[host, t] += [bad] if bad is not None else []
    return [(t, (sum(labels[r[0], t]) + prior_weight / 2) / (len(labels[r[0], t]) + prior_weight)) for r, t in zip(rows, out)]


def random_pages(n, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        host = rng.choice(["a", "a", "a", "b", "c"])
        first = rng.choice(["en", "en", "spam", "de", "tag"])
        seg = [first]
        if first == "spam":
            seg += [rng.choice(["x", "y"]), "*"]
        elif first == "tag":
            seg += rng.choice([[], ["one"], ["two"]])
        else:
            seg += ["*"] * rng.randint(0, 2)
        seg += [rng.choice("pqr") for _ in range(rng.choice([0, 0, 0, 7]))]
        bad = rng.random() < (0.95 if first == "spam" else 0.1)
        rows.append((host, seg, bad if rng.random() < (0.9 if first == "spam" and "x" in seg else 0.2) else None))
    return rows


@pytest.mark.parametrize("n, seed", [(900, 1), (150, 2)])
def test_tree_against_brute_force(spark, n, seed):
    rows = random_pages(n, seed)
    url = lambda h, seg: f"http://{h}/" + "/".join(str(10_000 + k) if s == "*" else s for k, s in enumerate(seg))
    df = spark.createDataFrame([(i, url(h, seg), "x") for i, (h, seg, _) in enumerate(rows)], "page_id long, url string, template string")
    labels = spark.createDataFrame([(i, bad) for i, (_, _, bad) in enumerate(rows) if bad is not None], "page_id long, bad boolean")
    got = {r["page_id"]: r for r in urltree.judged(spark, df, [], labels).collect()}
    want = brute_tree(rows)
    assert [got[i]["template"] for i in range(n)] == [t for t, _ in want]
    assert [got[i]["purity"] for i in range(n)] == pytest.approx([p for _, p in want])
    assert all(got[i]["verdict"] == ("block" if p > 0.8 else "allow") for i, (_, p) in enumerate(want))
    if n == 900:
        assert len({t for t, _ in want}) > 12 and any(p > 0.8 for _, p in want)


def test_tree_goes_on_below_wildcards(spark):
    rng = random.Random(5)
    rows = [("a", ["*", rng.choice(["spam", "news"]), "*"]) for _ in range(120)]  # no literal at the first level
    rows += [("b", [f"u{i // 2}", "x", "y", rng.choice(["spam", "news"])] + ["*"] * (i % 3)) for i in range(120)]  # few pages a branch, one branch, then two
    rows += [("c", ["one"] * 40 + ["*", s, "end"]) for s in ["spam", "news"] * 20] + [("d", ["*"] * k) for k in range(5)]
    rows = [(h, seg, None if rng.random() < 0.2 else "spam" in seg) for h, seg in rows]
    df = spark.createDataFrame([(i, f"http://{h}/" + "/".join(str(10_000 + k) if s == "*" else s for k, s in enumerate(seg))) for i, (h, seg, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, bad) for i, (_, _, bad) in enumerate(rows) if bad is not None], "page_id long, bad boolean")
    got = {r["page_id"]: r for r in urltree.judged(spark, df, [], labels).collect()}
    want = brute_tree(rows)
    assert [got[i]["template"] for i in range(len(rows))] == [t for t, _ in want]
    assert {"/*/spam/*", "/*/*/*/spam", "/*" * 41 + "/spam/*"} <= {t for t, _ in want}
    assert all(got[i]["verdict"] == ("block" if p > 0.8 else "allow") for i, (_, p) in enumerate(want))


def test_verdicts_do_not_turn_with_the_number_of_pages(spark):
    for times in (1, 8):
        rows = [(k, f"http://h/{lang}/{i}") for k, (lang, i) in enumerate((lang, i) for lang in ("en", "de", "fr") for i in range(20 * times))]
        labels = spark.createDataFrame([(k, True) for k, u in rows if "/en/" in u], "page_id long, bad boolean")
        got = urltree.judged(spark, spark.createDataFrame(rows, "page_id long, url string"), [], labels).collect()
        assert {(r["path"][:4], r["verdict"]) for r in got} == {("/en/", "block"), ("/de/", "allow"), ("/fr/", "allow")}
        assert {r["template"] for r in got if r["verdict"] == "block"} == {"/en/*"}


def test_urls_long_repeated_and_with_clashing_columns(spark):
    long = "http://h/" + "a/" * 3000 + "x" * 50_000
    df = spark.createDataFrame([(1, long, "a", 1), (1, long, "b", 2), (2, None, "c", 3), (2, "http://h/a", None, 4)], "page_id long, url string, host string, n long")
    got = urltree.judged(spark, df, URL_RULES).collect()
    assert sorted((r["page_id"], r["host"], r["verdict"]) for r in got) == [(1, "h", "allow"), (1, "h", "allow"), (2, "", "allow"), (2, "h", "allow")]
