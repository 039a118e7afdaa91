"""Quality rules: text statistics, base limits, and robust multivariate outliers (DataFrame functions only).

Per language and source, a minimum-covariance-determinant estimate of the
transformed statistics is found by concentration steps, small groups leaning on
their language's; documents far from it by Mahalanobis distance go. Every step is a histogram of distances per group
(to find the half-sample's limit) and a sum of moments per group, so a group's
rows never meet in one task, and integers are summed, so reruns agree.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import let, pieces, settings, stored

#: The transformed statistics, in the order of the vector, and the least standard deviation that each is given; each alone can reach the limit.
VECTOR = {"mean_word": 0.05, "symbols": 0.05, "dup_lines": 0.12, "repeats": 0.12}
#: Clean lines and words that a text counts as having besides its own: one repeated line of a short text is little evidence.
LINES, WORDS = 10, 100
DIMS = len(VECTOR)
#: Estimates, of some 200 bytes each, that may be broadcast.
FEW = 50_000
#: Estimates whose histograms, of some thousand rows each at most, one partition counts.
SHARE = 32
#: Fixed-point units of the vector: sums of integers don't depend on their order.
UNIT = 4096
_POS_BITS = 20


def chi2(p: int, q: float) -> float:
    """The q-quantile of chi-square with p degrees of freedom (Wilson and Hilferty)."""
    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(q) * (2 / (9 * p)) ** 0.5) ** 3


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in an array of words."""
    window = lambda ws: F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))

    def exact(hs: Column) -> Column:
        """Positions of repeated windows, by sorting hashes with their positions."""
        both = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        near = lambda s, i, j: F.coalesce(F.get(s, j)["h"] == F.get(s, i)["h"], F.lit(False))
        return let(both, lambda s: F.filter(F.transform(s, lambda x, i: F.when(near(s, i, i - 1) | near(s, i, i + 1), x["i"])), lambda p: p.isNotNull()))

    def packed(hs: Column) -> Column:
        """The same with hash and position in one long, which sorts faster; the shortened hashes must agree in full."""
        high = lambda x: F.shiftright(x, _POS_BITS)
        at = lambda x: x.bitwiseAND(F.lit(2**_POS_BITS - 1)).cast("int")
        keys = F.sort_array(F.transform(hs, lambda h, i: F.shiftleft(F.shiftright(h, _POS_BITS), _POS_BITS).bitwiseOR(i.cast("long"))))

        def found(s: Column) -> Column:
            same = lambda x, j: F.coalesce(high(F.get(s, j)) == high(x), F.lit(False))
            return F.filter(F.transform(s, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x)), lambda x: x.isNotNull())

        def checked(some: Column) -> Column:
            clash = F.exists(F.sequence(F.lit(1), F.size(some) - 1), lambda i: (high(F.get(some, i)) == high(F.get(some, i - 1))) & (F.get(hs, at(F.get(some, i))) != F.get(hs, at(F.get(some, i - 1)))))
            return F.when(F.size(some) == 0, F.array().cast("array<int>")).when(clash, exact(hs)).otherwise(F.transform(some, at))

        return let(let(keys, found), checked)

    def covered(ps: Column) -> Column:
        """Words of the windows at these positions; windows overlap."""
        return let(F.sort_array(ps), lambda s: F.aggregate(F.transform(s, lambda p, i: F.least(F.coalesce(F.get(s, i + 1) - p, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x))

    places = lambda hs: F.when(F.size(hs) < 2**_POS_BITS, packed(hs)).otherwise(exact(hs))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(covered(let(window(words), places)))


def statistics(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, h (the text's xxhash64), lang, source and the statistics of each whole text, and ``more``; a null text has none of anything."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    of_words = lambda ws: F.struct(F.size(ws).alias("n_words"), _repeat_words(ws).alias("n_repeat_words"))
    of_pieces = lambda ps: F.struct(F.size(ps).alias("n_pieces"), let(F.filter(ps, lambda w: w != ""), of_words).alias("w"))
    of_lines = lambda ls: F.struct(F.size(ls).alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("n_dup_lines"))
    found = docs.select(*more, "doc_id", F.xxhash64("text").alias("h"), "lang", "source", F.length(text).alias("n_chars"), (F.size(F.split(text, r"[#*$%&|<>]")) - 1).alias("n_symbols"), let(pieces(text), of_pieces).alias("p"), let(lines, of_lines).alias("l"))
    long = lambda c, name: c.cast("long").alias(name)
    return found.select(
        *found.columns[: len(more)],
        "doc_id", "h", "lang", "source", long(F.col("p.w.n_words"), "n_words"), long(F.col("n_chars") - F.col("p.n_pieces") + 1, "word_chars"), long(F.col("n_symbols"), "n_symbols"),
        long(F.col("l.n_lines"), "n_lines"), long(F.col("l.n_dup_lines"), "n_dup_lines"), long(F.col("p.w.n_repeat_words"), "n_repeat_words"),
    )


def with_verdicts(spark: SparkSession, docs: DataFrame, prior: float = 200.0, half: float = 0.75, steps: int = 6, keep: float = 0.999) -> DataFrame:
    """The statistics of every row of ``docs`` with base_failed, distance2 and kept.

    Every language and source has an estimate of its own from its rows that pass
    the base limits (null is a value like others), and ``prior`` rows' weight of
    its language's estimate beside them, which in turn has as much of all
    documents': so a small group leans on its language, a large one doesn't, and
    no size changes the rule. ``half``: the part of a group that its estimate
    rests on. ``steps``: concentration steps, from the medians and from the
    means; the smaller determinant wins. ``keep``: the chi-square quantile of
    the squared distance, scaled by the group's median, up to which a document
    is kept; only documents on the bad side (more symbols, repeats or odd word
    lengths) are far from documents that are close to what is usual, since every
    variance has a floor added (``VECTOR``, squared; the determinant that is
    minimised has the floors in it). Shares of repeated lines and words are
    taken of the text's own and of ``LINES`` or ``WORDS`` clean ones. Null and
    empty texts fail the base limits. Rows that are repeated are judged alike;
    an empty table gives no rows.
    """
    return _judged(spark, docs, prior, half, steps, keep)


def passed(spark: SparkSession, docs: DataFrame, prior: float = 200.0, half: float = 0.75, steps: int = 6, keep: float = 0.999) -> DataFrame:
    """The rows of ``docs`` that :func:`with_verdicts` keeps, with their own columns; a row stays beside its statistics, so no join moves texts."""
    return _judged(spark, docs, prior, half, steps, keep, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")).where("kept").select("_row.*")


def _judged(spark: SparkSession, docs: DataFrame, prior: float, half: float, steps: int, keep: float, *more: Column) -> DataFrame:
    stats = statistics(docs, *more)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    fixed = lambda c: F.round(c * UNIT).cast("long")
    x = [fixed(F.log(F.greatest(ratio("word_chars", "n_words"), F.lit(0.5)))), fixed(F.sqrt(ratio("n_symbols", "word_chars"))), fixed(F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + LINES))), fixed(F.sqrt(F.col("n_repeat_words") / (F.col("n_words") + WORDS)))]
    tag = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    stats = stats.withColumn("base_failed", failed).withColumns({f"x{i}": c for i, c in enumerate(x)})
    stats = stored(spark, stats.withColumn("g1", F.to_json(F.array(tag("lang")))).withColumn("g", F.to_json(F.array(tag("lang"), tag("source")))), "quality-statistics")
    vectors = stored(spark, stats.where(~F.col("base_failed")).select("g", "g1", *(f"x{i}" for i in range(DIMS))), "quality-vectors")
    estimate = _mcd(spark, vectors, prior, half, steps).where("level = 2").drop("level")
    judged = stats.join(estimate, "g", "left").withColumn("distance2", F.when(~F.col("base_failed"), F.expr(_distance2()) * F.col("scale")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= chi2(DIMS, keep), F.lit(True))
    return judged.withColumn("kept", kept).drop(*(f"x{i}" for i in range(DIMS)), "n_lines", "g1", *estimate.columns)


# What follows is written as SQL expressions: a step has hundreds of operations, and each Column operation is a call to the JVM.


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(DIMS) for j in range(i + 1)]


def _names() -> list[str]:
    return [f"{i}" for i in range(DIMS)] + [f"{i}{j}" for i, j in _pairs()]


def _distance2() -> str:
    """Squared Mahalanobis distance from means m0.. and the Cholesky factor l00, l10, ..: forward substitution."""
    z: list[str] = []
    for i in range(DIMS):
        rest = "".join(f" - l{i}{j} * {z[j]}" for j in range(i))
        z.append(f"((x{i} / {UNIT}D - m{i}{rest}) / l{i}{i})")
    return " + ".join(f"{v} * {v}" for v in z)


def _factored(moments: DataFrame, *keys: str) -> DataFrame:
    """Means, Cholesky factor of the covariance (variances have their floors added) and log determinant from mean moments a0.., a00.. ."""
    floors = list(VECTOR.values())
    made = [f"a{i} as m{i}" for i in range(DIMS)]
    for i, j in _pairs():
        rest = f"a{i}{j} - m{i} * m{j}" + (f" + {floors[i] ** 2!r}D" if i == j else "") + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        made.append(f"sqrt(greatest({rest}, {floors[i] ** 2 / 4!r}D)) as l{i}{j}" if i == j else f"({rest}) / l{j}{j} as l{i}{j}")
    return moments.selectExpr(*keys, *made, " + ".join(f"ln(l{i}{i})" for i in range(DIMS)) + " as log_det")


def _leaning(sums: DataFrame, prior: float) -> DataFrame:
    """Mean moments a.. of groups (level, g, g1, start, n, s..): each group's sums and ``prior`` rows' weight of the group above it. One row per group."""
    own = {s: f"cast(s{s} as double) / {UNIT ** len(s)}D" for s in _names()}
    struct = lambda of: "named_struct(" + ", ".join(f"'v{s}', {of(s)}" for s in _names()) + ")"
    out = sums.selectExpr("*", struct(lambda s: f"{own[s]} / n") + " as a")
    for level, above in ((1, "start"), (2, "start, g1")):
        out = out.selectExpr("*", f"max(if(level = {level - 1}, a, null)) over (partition by {above}) as top")
        led = struct(lambda s: f"({own[s]} + {float(prior)!r}D * top.v{s}) / (n + {float(prior)!r}D)")
        out = out.selectExpr(*sums.columns, f"if(level = {level}, {led}, a) as a")
    return out.selectExpr("level", "g", "start", *(f"a.v{s} as a{s}" for s in _names()))


def _moments() -> list[Column]:
    """Number, sums and sums of products of the vectors."""
    return [F.expr("count(1) as n"), *(F.expr(f"sum(cast({' * '.join(f'x{i}' for i in s)} as decimal(38,0))) as s{s}") for s in _names())]


#: Buckets of distances: steps of 1/64 of a power of e, which bounds a histogram to a few thousand rows a group.
def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.selectExpr("*", f"cast(floor(ln(greatest({_distance2()}, 1e-12D)) * 64) as int) as bucket")


def _upto(counts: DataFrame, q: float, *keys: str) -> DataFrame:
    """The rows of ``counts`` (keys, bucket, n, ..) up to the bucket that holds the q-quantile of each group, with the group's rows (whole)."""
    by = ", ".join(keys)
    both = counts.selectExpr("*", f"sum(n) over (partition by {by} order by bucket) as upto", f"sum(n) over (partition by {by}) as whole")
    return both.where(f"upto - n < ceil(whole * {q!r}D)")


def _mcd(spark: SparkSession, vectors: DataFrame, prior: float, half: float, steps: int) -> DataFrame:
    """(level, g, means, factor, scale) of all documents (level 0), each language (1), and each language and source (2)."""
    group, keys, x = ["level", "g", "g1"], ["level", "g", "g1", "start"], [f"x{i}" for i in range(DIMS)]
    levels = "array(named_struct('level', 0, 'g', '[]', 'g1', cast(null as string)), named_struct('level', 1, 'g', g1, 'g1', g1), named_struct('level', 2, 'g', g, 'g1', g1))"
    rows = vectors.selectExpr(f"inline({levels})", *x)
    sums = rows.groupBy(*group).agg(*_moments()).selectExpr("*", "1 as start")
    # Start 0: medians from histograms of each statistic, with the floors as spreads.
    long = rows.selectExpr(*group, f"posexplode(array({', '.join(x)})) as (dim, v)").selectExpr(*group, "dim", f"cast(v div {UNIT // 256} as int) as bucket")
    mid = _upto(long.groupBy(*group, "dim", "bucket").agg(F.expr("count(1) as n")), 0.5, *group, "dim")
    mid = mid.groupBy("level", "g").agg(*(F.expr(f"max(if(dim = {i}, (bucket + 0.5D) / 256, null)) as m{i}") for i in range(DIMS)))
    floors = list(VECTOR.values())
    mid = mid.selectExpr("level", "g", "0 as start", *(f"m{i}" for i in range(DIMS)), *(f"{floors[i] if i == j else 0.0!r}D as l{i}{j}" for i, j in _pairs()), "0.0D as log_det")
    factored = lambda sums: _factored(_leaning(sums, prior), "level", "g", "start")
    now = stored(spark, mid.unionByName(factored(sums)), "quality-estimate")
    # Estimates are broadcast while they are a few MB, so that the rows of a large group stay where they are; beyond that Spark joins as it can.
    n = now.count()
    met = lambda now: _bucketed(rows.join(F.broadcast(now) if n <= FEW else now, ["level", "g"]))
    with settings(spark, _planned_once(spark, n)):
        for _ in range(steps):
            # One pass: the moments of every bucket of distances, then those of the buckets up to the limit.
            near = met(now).groupBy(*keys, "bucket").agg(*_moments())
            inside = _upto(near, half, *keys).groupBy(*keys).agg(*(F.expr(f"sum({c}) as {c}") for c in ("n", *(f"s{s}" for s in _names()))))
            now = stored(spark, factored(inside), "quality-estimate")
        best = now.groupBy("level", "g").agg(F.expr("min_by(start, struct(log_det, start)) as start"))
        now = stored(spark, now.join(best, ["level", "g", "start"]), "quality-estimate")
        # Scaled so that the median distance is what a normal distribution has, but never shrunk below the floors' spread.
        near = met(now).groupBy(*group, "bucket").agg(F.expr("count(1) as n"))
        mid = _upto(near, 0.5, *group).groupBy(*group).agg(F.expr("cast(max(bucket) as double) as at"), F.expr("first(whole) as n"))
        for level, above in ((1, "0"), (2, "g1")):
            mid = mid.selectExpr("*", f"max(if(level = {level - 1}, at, null)) over (partition by {above}) as top")
            mid = mid.selectExpr(*group, "n", f"if(level = {level}, (n * at + {float(prior)!r}D * top) / (n + {float(prior)!r}D), at) as at")
        scale = f"least({chi2(DIMS, 0.5)!r}D / exp((at + 1) / 64), 1.0D) as scale"
        return stored(spark, now.join(mid.select("level", "g", "at"), ["level", "g"]).selectExpr("level", "g", *(f"m{i}" for i in range(DIMS)), *(f"l{i}{j}" for i, j in _pairs()), scale, "log_det"), "quality-scaled")


def _planned_once(spark: SparkSession, n: int) -> dict[str, str]:
    """Settings for the steps of ``n`` estimates, whose histograms don't grow with the corpus.

    Spark would plan a step anew after each of its shuffles, and each time the
    driver holds another copy of a plan of hundreds of operations. Where
    estimates are too many to be broadcast it goes on doing so.
    """
    if n > FEW:
        return {}
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(8, n // SHARE))
    return {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(parts)}
