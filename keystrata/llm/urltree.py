"""URL filters: explicit host and path rules, then a tree of path templates per host (DataFrame functions only).

Rules decide the urls they fit. Their verdicts (or verdicts given with the
rows) also label urls, and the labels teach the tree: level by level, segments
that look generated become ``*``, branches that are like their siblings become
``*`` as well, and a template is rejected if its smoothed share of bad labels
exceeds a limit. Branches are compared by all their pages: how many of them have
a bad, a good or no label, and how many end next or go on with a varying or a
fixed segment.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import stored


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: A segment of these forms varies from page to page: numbers, dates, hex or mixed ids, with or without a file ending.
VARIABLE = r"^(?:\d+|[0-9a-fA-F]{8,}|(?=[^/]*\d)[A-Za-z0-9_-]{16,}|\d{4}-\d{2}(?:-\d{2})?)(?:\.[A-Za-z0-9]{1,5})?$"
def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://``; both empty for null or without it."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(raw, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule's name whose host is this one or a parent of it and whose path begins this one; else null."""
    fits = lambda r: ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
    ordered = sorted(rules, key=lambda r: -len(r.name))
    return F.coalesce(*[F.when(fits(r), F.lit(r.name)) for r in ordered], F.lit(None).cast("string"))


#: Counts of a branch: its pages, labels, bad labels, pages that end next, and pages whose next segment varies.
_COUNTS = ("n", "l", "b", "e", "v")


def distance(here: dict[str, str], rest: dict[str, str], weight: float) -> str:
    """SQL of how unlike two branches are, 0 to 1, from SQL of their counts: the larger total variation of their labels and of what comes next.

    A branch of n pages counts as n / (n + weight) of that: few pages show little.
    """
    kinds = lambda c: ([f"({c['b']})", f"({c['l']} - {c['b']})", f"({c['n']} - {c['l']})"], [f"({c['e']})", f"({c['v']})", f"({c['n']} - {c['e']} - {c['v']})"])
    far = [" + ".join(f"abs({x} * CAST(1.0 AS DOUBLE) / {here['n']} - {y} * CAST(1.0 AS DOUBLE) / {rest['n']})" for x, y in zip(xs, ys, strict=True)) for xs, ys in zip(kinds(here), kinds(rest), strict=True)]
    seen = lambda n: f"({n} / ({n} + CAST({weight} AS DOUBLE)))"
    return f"greatest({far[0]}, {far[1]}) / 2 * {seen(here['n'])} * {seen(rest['n'])}"


def _starred(done: int, level: int | None = None) -> Column:
    """The template, known for ``done`` segments, with ``*`` for those up to ``level`` or the last."""
    upto = "size(seg)" if level is None else f"least(size(seg), {level})"
    return F.expr(f"concat(template, repeat('/*', greatest({upto} - {done}, 0)))")


def judged(
    spark: SparkSession,
    pages: DataFrame,
    rules: list[Rule],
    labels: DataFrame | None = None,
    apart: float = 0.3,
    weight: float = 10.0,
    prior_weight: float = 10.0,
    limit: float = 0.8,
) -> DataFrame:
    """(page_id, host, path, rule, template, purity, verdict) of every row of ``pages`` (page_id, url).

    ``labels``: (page_id, bad boolean), else the rules' own verdicts label the
    urls that they fit. Under each node a literal segment stays literal if its
    :func:`distance` from all its siblings together, each counting ``weight``
    pages less, is ``apart`` or more; all others merge into ``*``. ``purity`` is
    ``(bad + prior_weight / 2) / (labels + prior_weight)`` of the template's own
    labels; above ``limit`` the method blocks, so a template without labels is
    allowed whatever its host's others are. A rule's verdict comes first. Paths
    are followed at every level, below ``*`` too, at which some branch has pages
    enough to be told apart; at all others segments are ``*``. Null urls and those without ``://`` have an empty host
    and path and are judged as those of one host; rows that are repeated count
    as often and get equal answers; very long urls are like others; other
    columns of ``pages`` are left out; an empty table gives no rows.
    """
    host, path = split_url(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    seen = seen.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    by_rule = reduce(lambda c, r: c.when(F.col("rule") == r.name, F.lit(r.verdict)), rules, F.when(F.lit(False), F.lit("")))
    seen = seen.withColumn("ruled", by_rule)
    if labels is None:
        labelled = seen.withColumn("bad", F.col("ruled") == "block")
    else:
        labelled = seen.join(labels.groupBy("page_id").agg(F.max("bad").alias("bad")), "page_id", "left")
    shaped = F.filter(F.split("path", "/"), lambda s: s != "")
    shape = F.concat_ws("/", F.transform(shaped, lambda s: F.when(s.rlike(VARIABLE), F.lit("*")).otherwise(s)))

    # One row per host and shape carries all that the tree needs.
    counts = labelled.groupBy("host", shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("l"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("b"))
    tree = stored(spark, counts.withColumn("seg", F.expr("if(shape = '', cast(array() as array<string>), split(shape, '/'))")).withColumn("template", F.lit("")), "url-shapes")
    least = ceil(apart * weight / (1 - apart))  # a branch of fewer pages can't be apart, nor can one whose siblings have fewer
    # Levels at which some host has a literal of so many pages beside others of so many; at all others every segment becomes *.
    places = tree.select("host", "n", F.posexplode("seg").alias("k", "s")).groupBy("host", "k", "s").agg(F.sum("n").alias("n"))
    fewest = F.min(F.when((F.col("s") != "*") & (F.col("n") >= least), F.col("n")))
    open_ = places.groupBy("host", "k").agg((F.sum("n") - fewest).alias("others")).where(F.col("others") >= least)
    done = 0
    for level in sorted(r["k"] for r in open_.select("k").distinct().collect()):
        tree = tree.withColumn("template", _starred(done, level))
        tree = tree.withColumns({"s": F.expr(f"get(seg, {level})"), "e": F.expr(f"if(size(seg) = {level + 1}, n, 0)"), "v": F.expr(f"if(get(seg, {level + 1}) = '*', n, 0)")})
        here = tree.where("s is not null").groupBy("host", "template", "s").agg(*(F.sum(c).alias(c) for c in _COUNTS))
        large = here.where((F.col("s") != "*") & (F.col("n") >= least))
        above = here.groupBy("host", "template").agg(*(F.sum(c).alias(f"p{c}") for c in _COUNTS))
        far = distance({c: c for c in _COUNTS}, {c: f"(p{c} - {c})" for c in _COUNTS}, weight)
        kept = large.join(above, ["host", "template"]).where("pn > n").where(f"{far} >= {apart}D").select("host", "template", "s", F.lit(True).alias("literal"))
        grown = F.when(F.col("s").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.when(F.col("literal"), F.col("s")).otherwise(F.lit("*"))))
        tree = tree.drop("e", "v").join(kept, ["host", "template", "s"], "left").withColumn("template", grown).drop("s", "literal")
        tree = stored(spark, tree, "url-tree")
        done = level + 1
    tree = tree.withColumn("template", _starred(done))
    purity = tree.groupBy("host", "template").agg(F.sum("l").alias("l"), F.sum("b").alias("b")).select("host", "template", ((F.col("b") + prior_weight / 2) / (F.col("l") + prior_weight)).alias("purity"))
    decided = stored(spark, tree.select("host", "shape", "template").join(purity, ["host", "template"]), "url-templates")
    verdict = F.coalesce("ruled", F.when(F.col("purity") > limit, F.lit("block")).otherwise(F.lit("allow")))
    return seen.withColumn("shape", shape).join(decided, ["host", "shape"]).select("page_id", "host", "path", "rule", "template", "purity", verdict.alias("verdict"))
