"""Which buildings lie in the areas whose map data were loaded.

Bounds come in degrees and are curved once projected, so their sides get points in between. A building that no side of an area comes
near is told by one of its corners; only those on a border are cut against the union of the areas there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotlink.functions import crs
from plotlink.functions import geometry as G
from plotlink.operators import arrange, gridjoin
from plotlink.operators.scratch import cut_lineage
from plotlink.params import DEFAULTS, Params

#: Pieces of each side of projected bounds (fixed value).
SIDE_PIECES = 16


def boxed(areas: DataFrame) -> DataFrame:
    """ring, x0..y1 of areas that come as rings."""
    return areas.withColumn("box", G.envelope(F.col("ring"))).select("ring", "box.*")


def projected(bounds: DataFrame, zone: int) -> DataFrame:
    """ring, x0..y1 in metres of bounds in degrees (min_lat, min_lon, max_lat, max_lon); null and collapsed ones go."""
    south, west, north, east = (F.col(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon"))
    corners = [(south, west), (south, east), (north, east), (north, west)]

    def side(k: int) -> Column:
        (lat, lon), (to_lat, to_lon) = corners[k], corners[(k + 1) % 4]
        steps = F.sequence(F.lit(0), F.lit(SIDE_PIECES - 1))
        return F.transform(steps, lambda i: crs.project(lat + (to_lat - lat) * i / SIDE_PIECES, lon + (to_lon - lon) * i / SIDE_PIECES, zone))

    around = F.concat(*[side(k) for k in range(4)])
    ring = G.let(around, lambda p: F.flatten(F.transform(F.concat(p, F.slice(p, 1, 1)), lambda q: F.array(q["x"], q["y"]))))
    return boxed(bounds.where((south < north) & (west < east)).select(ring.alias("ring")))


def split(official: DataFrame, areas: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """official (id, ring or polygons, x0..y1) with covered: whether its footprint lies in the union of the areas (x0..y1, and ring
    unless they are rectangles). Borders count as inside, and so do gaps of under a square millimetre.

    A footprint on a border is one group with the areas whose sides come near it; areas that are alike count once.
    """
    shape = "polygons" if "polygons" in official.columns else "ring"
    if "ring" not in areas.columns:
        areas = areas.withColumn("ring", G.rectangle(*[F.col(c) for c in gridjoin.BOX]))
    hit = gridjoin.envelope_join(official.select("id", F.col(shape).alias("shape"), *gridjoin.BOX), areas.select(F.col("ring"), *gridjoin.BOX), prefix="a_", size=params.cell, few=True)
    over = lambda e: (F.least(e["ax"], e["bx"]) <= F.col("x1")) & (F.greatest(e["ax"], e["bx"]) >= F.col("x0")) & (F.least(e["ay"], e["by"]) <= F.col("y1")) & (F.greatest(e["ay"], e["by"]) >= F.col("y0"))
    bordered = F.exists(G.edges(F.col("a_ring")), over)
    told = hit.withColumn("bordered", bordered).withColumn("within", ~F.col("bordered") & G.contains_point(F.col("a_ring"), F.col("x0"), F.col("y0")))
    told = cut_lineage(told.where("bordered or within").select("id", "shape", *gridjoin.BOX, "a_ring", "within"))
    inside = told.where("within").select("id").distinct()
    near = told.join(inside, "id", "left_anti").groupBy("id").agg(F.first("shape").alias("shape"), F.collect_set("a_ring").alias("rings"), *[F.first(c).alias(c) for c in gridjoin.BOX])
    # Rays go to the right, so sides above, below and to the left of a footprint tell nothing about it.
    seen = lambda e: (F.least(e["ay"], e["by"]) <= F.col("y1") + 1) & (F.greatest(e["ay"], e["by"]) >= F.col("y0") - 1) & (F.greatest(e["ax"], e["bx"]) >= F.col("x0") - 1)
    sides = F.filter(F.flatten(F.transform("rings", lambda r: arrange.tagged_edges(r, "array<double>", "b"))), seen)
    near = cut_lineage(near.select("id", F.concat(arrange.tagged_edges(F.col("shape"), near.schema["shape"].dataType.simpleString(), "a"), sides).alias("edges")))
    left = arrange.polygons(near, ["id"], "edges", lambda x, y: (x != 0) & (y == 0)).select("id")
    covered = inside.unionByName(near.select("id").join(left, "id", "left_anti")).withColumn("covered", F.lit(True))
    # Footprints without an edge leave nothing and lie nowhere.
    sound = F.size(F.col(shape)) > 0
    return official.join(covered, "id", "left").withColumn("covered", F.coalesce(F.col("covered") & sound, F.lit(False)))
