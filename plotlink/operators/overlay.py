"""Polygon overlay as Spark jobs on edges: no geometry library behind a UDF.

Area. A polygon is the signed sum of the regions below its edges, so the area that two polygons share is the sum, over all
pairs of their edges, of the area below the lower of the two where their x ranges overlap, with the product of the
signs. Holes, several parts, common edges and slanted ones need no special case, and every pair of edges is one row of
compiled arithmetic.

Outlines of what two or more footprints leave or cover are in arrange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotlink.functions import geometry as G

#: Pairs with more combinations of edges than this meet by slabs.
LONG = 4096


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _long_met(long: DataFrame, ids: list[str]) -> DataFrame:
    """ids, ox, oy, a, b, left, right: edges of long outlines that share a slab of x, with the slab's bounds. Slabs are as many as an
    eighth of the pair's edges, but so wide that an edge falls into few of them."""
    run = lambda name: F.aggregate(name, F.lit(0.0), lambda s, e: s + F.abs(e["bx"] - e["ax"]))
    xs = F.transform(F.concat("ea", "eb"), lambda e: e["ax"])  # every corner but those of upright edges starts one
    n = F.size("ea") + F.size("eb")
    slabs = long.withColumn("start", F.array_min(xs)).withColumn("width", F.greatest((F.array_max(xs) - F.col("start")) * 8 / n, (run("ea") + run("eb")) / (4 * n)))
    slab = lambda x: F.floor((x - F.col("start")) / F.col("width")).cast("long")

    def side(name: str, *more: str) -> DataFrame:
        e = slabs.select(*ids, *more, "start", "width", F.explode(f"e{name}").alias(name))
        return e.withColumn("slab", F.explode(F.sequence(slab(F.least(f"{name}.ax", f"{name}.bx")), slab(F.greatest(f"{name}.ax", f"{name}.bx")))))

    met = side("a", "ox", "oy").join(side("b").drop("start", "width"), [*ids, "slab"])
    return met.select(*ids, "ox", "oy", "a", "b", (F.col("start") + F.col("slab") * F.col("width")).alias("left"), (F.col("start") + (F.col("slab") + 1) * F.col("width")).alias("right"))


def shared_area(pairs: DataFrame, ids: list[str], rings_a: str, rings_b: str) -> DataFrame:
    """ids, shared: area common to the two footprints (a ring, rings or polygons, see geometry.shape_edges) of each pair.

    The edges of short outlines meet within their row; those of pairs with more than `LONG` combinations meet by an equi-join on
    slabs of x, each slab counting what lies inside it. pairs is read for both, so it should be a stored table.
    """
    upright = lambda name: F.filter(G.shape_edges(F.col(name), _kind(pairs, name)), lambda e: e["ax"] != e["bx"])  # noqa: E731  others have nothing below them

    def sides(of: DataFrame) -> DataFrame:
        # Places count from a corner of the pair's own, so that large coordinates cost no digits.
        return of.select(*ids, upright(rings_a).alias("ea"), upright(rings_b).alias("eb")).withColumn("ox", F.col("ea")[0]["ax"]).withColumn("oy", F.col("ea")[0]["ay"])

    combinations = G.shape_corners(F.col(rings_a), _kind(pairs, rings_a)).cast("long") * G.shape_corners(F.col(rings_b), _kind(pairs, rings_b))
    short = sides(pairs.where(combinations <= LONG)).withColumn("a", F.explode("ea")).withColumn("b", F.explode("eb"))
    met = short.select(*ids, "ox", "oy", "a", "b", F.lit(float("-inf")).alias("left"), F.lit(float("inf")).alias("right")).unionByName(_long_met(sides(pairs.where(combinations > LONG)), ids))
    met = met.select(*ids, *[(F.col(f"{e}.{end}{c}") - F.col(f"o{c}")).alias(f"{e}{end}{c}") for e in "ab" for end in "ab" for c in "xy"], *[(F.col(c) - F.col("ox")).alias(c) for c in ("left", "right")])
    low = F.greatest(F.least("aax", "abx"), F.least("bax", "bbx"), "left")
    high = F.least(F.greatest("aax", "abx"), F.greatest("bax", "bbx"), "right")
    met = met.withColumn("low", low).withColumn("high", F.greatest(low, high))
    at = lambda e, x: F.col(f"{e}ay") + (F.col(x) - F.col(f"{e}ax")) * (F.col(f"{e}by") - F.col(f"{e}ay")) / (F.col(f"{e}bx") - F.col(f"{e}ax"))
    met = met.select(*ids, (F.col("high") - F.col("low")).alias("width"), *[at(e, x).alias(f"{e}_{x}") for e in "ab" for x in ("low", "high")], (F.signum(F.col("aax") - F.col("abx")) * F.signum(F.col("bax") - F.col("bbx"))).alias("sign"))
    d0, d1 = F.col("a_low") - F.col("b_low"), F.col("a_high") - F.col("b_high")
    t = d0 / F.nullif(d0 - d1, F.lit(0.0))
    y = F.col("a_low") + t * (F.col("a_high") - F.col("a_low"))
    crossed = (t * (F.least("a_low", "b_low") + y) + (1 - t) * (y + F.least("a_high", "b_high"))) / 2
    below = F.when(d0 * d1 < 0, crossed).otherwise(F.least(F.col("a_low") + F.col("a_high"), F.col("b_low") + F.col("b_high")) / 2)
    return met.groupBy(*ids).agg(F.sum(F.col("sign") * F.col("width") * below).alias("shared"))


def discrete_hausdorff(pairs: DataFrame, ids: list[str], ring_a: str, ring_b: str, parts: int = 10) -> DataFrame:
    """ids, hausdorff: the largest distance of a boundary sample (parts samples an edge) of either ring from the other."""

    def one_way(source: str, target: str) -> DataFrame:
        # Samples meet edges as rows: plain arithmetic is compiled, functions over arrays are not.
        sides = pairs.select(*ids, F.posexplode(G.shape_edges(F.col(source), _kind(pairs, source))).alias("k", "e"), G.shape_edges(F.col(target), _kind(pairs, target)).alias("others"))
        met = sides.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("o", F.explode("others"))
        t = F.col("i") / F.lit(float(parts))
        x, y = F.col("e.ax") + t * (F.col("e.bx") - F.col("e.ax")), F.col("e.ay") + t * (F.col("e.by") - F.col("e.ay"))
        near = met.select(*ids, "k", "i", G.segment_distance(x, y, F.col("o.ax"), F.col("o.ay"), F.col("o.bx"), F.col("o.by")).alias("d"))
        return near.groupBy(*ids, "k", "i").agg(F.min("d").alias("d")).select(*ids, "d")

    return one_way(ring_a, ring_b).unionByName(one_way(ring_b, ring_a)).groupBy(*ids).agg(F.max("d").alias("hausdorff"))
