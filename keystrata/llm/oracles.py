"""SQL that gives the rows of the queries that SQL can express."""

from __future__ import annotations

from . import mixing, urltree

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANK = r"[\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"[x for x in regexp_split_to_array({text}, '{_BLANK}') if x <> '']"


def jaccard_join() -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words(f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')")} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS t FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * c >= 75 * (len(a.sh) + len(b.sh) - c)),
n AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT n.y, r.c FROM r JOIN n ON n.x = r.doc_id)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, min(c) AS component_id FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, sh"""


def _covered(k: str, length: int) -> str:
    """r{k} (doc_id, a, z): maximal runs of bytes that repeated strings of so many bytes cover."""
    return f"""
i{k} AS (SELECT doc_id, b, unnest(range(1, n - {length} + 2)) AS i FROM d WHERE n >= {length}),
h{k} AS (SELECT doc_id, i, md5(array_slice(b, i, i + {length - 1})) AS h FROM i{k}),
g{k} AS (SELECT h FROM h{k} GROUP BY h HAVING count(*) > 1),
m{k} AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {length} THEN 1 ELSE 0 END AS new FROM h{k} JOIN g{k} USING (h)),
k{k} AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m{k}),
r{k} AS (SELECT doc_id, min(i) AS a, max(i) + {length - 1} AS z FROM k{k} GROUP BY doc_id, k)"""


def _left(k: str, runs: str) -> str:
    """t{k} (doc_id, n_removed, n_spans, kept): what is left in hex without the runs."""
    return f"""
q{k} AS (SELECT doc_id, a, z, lag(z) OVER (PARTITION BY doc_id ORDER BY a) AS y, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS x FROM {runs}),
t{k} AS (SELECT q.doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans, string_agg(hex(array_slice(b, coalesce(y, 0) + 1, a - 1)), '' ORDER BY a) || coalesce(max(CASE WHEN x IS NULL AND z < n THEN hex(array_slice(b, z + 1, n)) END), '') AS kept FROM q{k} q JOIN d ON d.doc_id = q.doc_id GROUP BY q.doc_id)"""


def suffix_dedup(length: int = 400, passage: int = 200, words: int = 50) -> str:
    # As text, a blob has other bytes than printable ones as \\xHH.
    shown = r"(?: |\\x09|\\x0A|\\x0B|\\x0C|\\x0D)+"
    n_words = f"len([x for x in regexp_split_to_array(CAST(array_slice(b, a, z) AS VARCHAR), '{shown}') if x <> ''])"
    n_chars = lambda blob: rf"length(regexp_replace(regexp_replace(CAST({blob} AS VARCHAR), '\\x[89AB][0-9A-F]', '', 'g'), '\\x[0-9A-F][0-9A-F]', 'x', 'g'))"
    return f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),{_covered("1", length)},{_covered("2", passage)},
p AS (SELECT r2.doc_id, a, z FROM r2 JOIN d ON d.doc_id = r2.doc_id WHERE {n_words} > {words}),{_left("1", "r1")},{_left("2", "p")}
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(t1.n_removed, 0) AS BIGINT) AS n_removed, coalesce(t1.n_spans, 0) AS n_spans, CASE WHEN t1.doc_id IS NULL THEN sha256(b) ELSE sha256(unhex(t1.kept)) END AS kept_sha256,
coalesce(t2.n_spans, 0) AS n_passages, CAST(coalesce(t2.n_removed, 0) AS BIGINT) AS passage_bytes, CASE WHEN t2.doc_id IS NULL THEN {n_chars("b")} ELSE {n_chars("unhex(t2.kept)")} END AS chars_left
FROM d LEFT JOIN t1 ON t1.doc_id = d.doc_id LEFT JOIN t2 ON t2.doc_id = d.doc_id"""


def mix() -> str:
    point = f"((k // {2**20}) * {mixing.PHI_20!r}::DOUBLE + (k % {2**20}) * {mixing.PHI!r}::DOUBLE)"
    return f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len({_words("coalesce(text, '')")}), 0) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents),
v AS (SELECT sum(size) AS words, greatest(1, CAST(sum(size) AS BIGINT) // (16 * count(*))) AS block FROM d),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, cap / weight AS cut FROM s1),
s3 AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cut, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cut, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM s2),
s4 AS (SELECT *, max(CASE WHEN cut >= level THEN level END) OVER () AS final FROM s3),
s5 AS (SELECT *, least(cap, coalesce(final * weight, cap)) AS target FROM s4),
s AS (SELECT source, source_size, target, (sum(target) OVER (ORDER BY source NULLS LAST) - target) / sum(target) OVER () AS lo, sum(target) OVER (ORDER BY source NULLS LAST) / sum(target) OVER () AS hi FROM s5),
k AS (SELECT unnest(range(CAST(words AS BIGINT) // block)) AS k FROM v),
u AS (SELECT k, {point} - floor({point}) AS u FROM k),
r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY k) - 1 AS r, source_size FROM u JOIN s ON u >= lo AND u < hi),
n AS (SELECT source, r % ((source_size + block - 1) // block) AS blk, count(*) AS visits FROM r, v WHERE r < 3 * ((source_size + block - 1) // block) GROUP BY 1, 2),
a AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS a FROM d),
p AS (SELECT doc_id, source, size, a, block, unnest(range(a // block, (a + size - 1) // block + 1)) AS blk FROM a, v WHERE size > 0),
t AS (SELECT p.doc_id, sum((least(a + size, (p.blk + 1) * block) - greatest(a, p.blk * block)) * visits) AS taken FROM p JOIN n ON n.source IS NOT DISTINCT FROM p.source AND n.blk = p.blk GROUP BY 1)
SELECT d.doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source LEFT JOIN t ON t.doc_id = d.doc_id"""


def url_tree(rules: list[urltree.Rule], depth: int = 4, apart: float = 0.3, weight: float = 10.0, prior_weight: float = 10.0, limit: float = 0.8) -> str:
    """The tree of paths of up to ``depth`` segments, which is more than ``pages`` has; a test holds deeper ones against brute force."""
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    ordered = sorted(rules, key=lambda r: -len(r.name))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in ordered) + " END"
    ruled = "CASE rule " + " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in rules) + " END"
    # RE2 has no lookahead: a mixed id is a long run of its characters that holds a digit.
    ending = r"(\.[A-Za-z0-9]{1,5})?"
    variable = f"regexp_full_match(x, '([0-9]+|[0-9a-fA-F]{{8,}}|[0-9]{{4}}-[0-9]{{2}}(-[0-9]{{2}})?){ending}') OR (regexp_full_match(x, '[A-Za-z0-9_-]{{16,}}{ending}') AND regexp_matches(x, '[0-9]'))"
    counts = ("n", "l", "b", "e", "v")
    far = urltree.distance({c: f"h.{c}" for c in counts}, {c: f"(a.{c} - h.{c})" for c in counts}, weight)
    sums = ", ".join(f"sum({c}) AS {c}" for c in counts)
    steps = []
    for k in range(depth):
        steps.append(f"""
h{k} AS (SELECT host, template, seg[{k + 1}] AS s, sum(n) AS n, sum(l) AS l, sum(b) AS b, sum(CASE WHEN len(seg) = {k + 1} THEN n ELSE 0 END) AS e, sum(CASE WHEN seg[{k + 2}] = '*' THEN n ELSE 0 END) AS v FROM t{k} WHERE len(seg) > {k} GROUP BY 1, 2, 3),
a{k} AS (SELECT host, template, {sums} FROM h{k} GROUP BY 1, 2),
l{k} AS (SELECT h.host, h.template, s, true AS literal FROM h{k} h JOIN a{k} a ON a.host = h.host AND a.template = h.template WHERE s <> '*' AND a.n > h.n AND {far} >= {apart}),
t{k + 1} AS (SELECT t.host, t.shape, t.seg, t.n, t.l, t.b, CASE WHEN len(t.seg) <= {k} THEN t.template ELSE t.template || '/' || CASE WHEN l.literal THEN t.seg[{k + 1}] ELSE '*' END END AS template FROM t{k} t LEFT JOIN l{k} l ON l.host = t.host AND l.template = t.template AND l.s = t.seg[{k + 1}] AND len(t.seg) > {k})""")
    return f"""
WITH p0 AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p1 AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_UPPER.lower()}') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM p0),
p2 AS (SELECT *, {rule} AS rule FROM p1),
p3 AS (SELECT *, {ruled} AS ruled, [CASE WHEN {variable} THEN '*' ELSE x END for x in string_split(path, '/') if x <> ''] AS q FROM p2),
p AS (SELECT page_id, host, path, rule, ruled, array_to_string(q, '/') AS shape FROM p3),
t0 AS (SELECT host, shape, CASE WHEN shape = '' THEN [] ELSE string_split(shape, '/') END AS seg, count(*) AS n, count(ruled) AS l, count(*) FILTER (WHERE ruled = 'block') AS b, '' AS template FROM p GROUP BY host, shape),{",".join(steps)},
u AS (SELECT host, template, (sum(b) + {prior_weight / 2}::DOUBLE) / (sum(l) + {prior_weight}::DOUBLE) AS purity FROM t{depth} GROUP BY host, template)
SELECT page_id, p.host, path, rule, coalesce(ruled, CASE WHEN purity > {limit} THEN 'block' ELSE 'allow' END) AS verdict, t.template, purity
FROM p JOIN t{depth} t ON t.host = p.host AND t.shape = p.shape JOIN u ON u.host = t.host AND u.template = t.template"""


def warc(least: int = 100) -> str:
    again = f"payload_bytes >= {least} AND page_id <> first"
    return f"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN {again} THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN {again} THEN first END AS refers_to FROM f"""
