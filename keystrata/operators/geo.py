"""Places: (key, member, score), the score being a 52-bit cell number: 26 bits of latitude and longitude in turn. All in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.binding import let

# Fixed values of the grid, the earth's radius in metres, units in metres, and the text alphabet.
STEP = 26
LON, LAT = (-180.0, 180.0), (-85.05112878, 85.05112878)
RADIUS = 6372797.560856
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "mi": 1609.34}
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"

_MASKS = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]


def _spread(v: Column) -> Column:
    for shift, mask in _MASKS:
        v = let(v, lambda x: x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask)))  # noqa: B023
    return v


def _squeeze(v: Column) -> Column:
    v = v.bitwiseAND(F.lit(_MASKS[-1][1]))
    for (shift, _), mask in zip(reversed(_MASKS), [m for _, m in reversed(_MASKS[:-1])] + [0xFFFFFFFF], strict=True):
        v = let(v, lambda x: x.bitwiseOR(F.shiftright(x, shift)).bitwiseAND(F.lit(mask)))  # noqa: B023
    return v


def _cell(value: Column, low: float, high: float) -> Column:
    return F.floor((value - low) / (high - low) * (1 << STEP)).cast("long")


def encode(lon: Column, lat: Column, lat_range: tuple[float, float] = LAT) -> Column:
    return _spread(_cell(lat, *lat_range)).bitwiseOR(F.shiftleft(_spread(_cell(lon, *LON)), 1))


def decode(score: Column) -> tuple[Column, Column]:
    """(lon, lat) of the cell's centre."""
    edge = lambda i, low, high: low + i / float(1 << STEP) * (high - low)
    centre = lambda i, low, high: let(i, lambda x: (edge(x, low, high) + edge(x + 1, low, high)) / 2)
    return centre(_squeeze(F.shiftright(score, 1)), *LON), centre(_squeeze(score), *LAT)


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on the sphere."""
    u = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    v = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return 2.0 * RADIUS * F.asin(F.sqrt(u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v))


def geoadd(places: DataFrame) -> DataFrame:
    """(key, member, score) of (key, member, lon, lat)."""
    return places.select("key", "member", encode(F.col("lon"), F.col("lat")).alias("score"))


def geopos(g: DataFrame, asked: DataFrame) -> DataFrame:
    lon, lat = decode(F.col("score"))
    return asked.join(g, ["key", "member"], "left").select(*asked.columns, lon.alias("lon"), lat.alias("lat"))


def geodist(g: DataFrame, asked: DataFrame, unit: str = "m") -> DataFrame:
    """``distance`` between the asked (key, a, b), to four places; null if one is missing."""
    where = lambda name: g.select("key", F.col("member").alias(name), F.col("score").alias(f"_{name}"))
    both = asked.join(where("a"), ["key", "a"], "left").join(where("b"), ["key", "b"], "left")
    d = distance(*decode(F.col("_a")), *decode(F.col("_b"))) / UNITS[unit]
    return both.select(*asked.columns, F.round(d, 4).alias("distance"))


def geohash(g: DataFrame, asked: DataFrame, length: int = 10) -> DataFrame:
    """The usual text of each asked member's place, whose latitudes reach from -90 to 90."""
    lon, lat = decode(F.col("score"))
    bits = encode(lon, lat, (-90.0, 90.0))
    letter = lambda v, i: F.substring(F.lit(ALPHABET), (F.shiftright(v, 52 - 5 * (i + 1)).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    return asked.join(g, ["key", "member"], "left").select(*asked.columns, F.when(F.col("score").isNotNull(), let(bits, lambda v: F.concat(*[letter(v, i) for i in range(length)]))).alias("geohash"))


def georadius(g: DataFrame, asked: DataFrame, unit: str = "m", count: int | None = None, desc: bool = False) -> DataFrame:
    """Members within a radius of each asked (request, key, lon, lat, radius), nearest first, with distance and place.

    Each request looks into the nine cells around it, of a grid as fine as its
    radius allows, so it meets only what lies near, by an equality join.
    """
    metres = F.col("radius") * UNITS[unit]
    deg = F.degrees(metres / RADIUS)
    near_pole = F.cos(F.radians(F.least(F.abs("lat") + deg, F.lit(89.9))))
    fits = lambda span, size: F.floor(F.log2(F.lit(span) / F.greatest(size, F.lit(1e-9))))
    step = F.greatest(F.least(fits(LAT[1] - LAT[0], deg), fits(360.0, deg / near_pole), F.lit(STEP - 1)), F.lit(0)).cast("int")
    step = F.when(F.abs("lat") + deg >= 89.9, 0).otherwise(step)
    sized = asked.withColumn("step", step).withColumnsRenamed({"lon": "clon", "lat": "clat"})
    side = F.pow(F.lit(2.0), F.col("step")).cast("long")
    cell = lambda c, low, high: F.floor((c - low) / (high - low) * side).cast("long")
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    tiles = sized.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
    x = F.pmod(cell(F.col("clon"), *LON) + F.col("dx"), side)
    y = cell(F.col("clat"), *LAT) + F.col("dy")
    tiles = tiles.withColumn("x", x).withColumn("y", y).drop("dx", "dy").distinct().where("y >= 0")
    steps = tiles.select("key", "step").distinct()
    lon, lat = decode(F.col("score"))
    power = F.pow(F.lit(2.0), STEP - F.col("step")).cast("long")
    spots = g.join(steps, "key").withColumn("x", F.floor(_squeeze(F.shiftright("score", 1)) / power).cast("long")).withColumn("y", F.floor(_squeeze(F.col("score")) / power).cast("long"))
    met = spots.join(tiles, ["key", "step", "x", "y"]).withColumns({"lon": lon, "lat": lat})
    d = distance(F.col("clon"), F.col("clat"), F.col("lon"), F.col("lat"))
    hit = met.withColumn("d", d).where(F.col("d") <= F.col("radius") * UNITS[unit]).withColumn("distance", F.round(F.col("d") / UNITS[unit], 4))
    order = [F.desc("d") if desc else F.asc("d"), F.asc("member")]
    hit = hit.withColumn("nth", F.row_number().over(W.partitionBy("request").orderBy(*order)))
    hit = hit.where(F.col("nth") <= count) if count is not None else hit
    return hit.select("request", "key", "nth", "member", "score", "distance", "lon", "lat")


def georadiusbymember(g: DataFrame, asked: DataFrame, unit: str = "m", count: int | None = None, desc: bool = False) -> DataFrame:
    """The same around a member; ``asked``: (request, key, member, radius)."""
    at = geopos(g, asked).where("lon is not null").select("request", "key", "lon", "lat", "radius")
    return georadius(g, at, unit, count, desc)
