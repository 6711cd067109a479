"""Queries of slanted, holed and multi-part footprints, fitting and image scores, with DuckDB counterparts.

Footprints are put together from unit cells and then sheared (x + y / 2), which keeps areas: an oracle can count cells.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotlink.functions import geometry as G
from plotlink.operators import edits, fit, gridjoin, match, raster
from plotlink.params import DEFAULTS
from plotlink.plans import layers

_CELLS = "SELECT p_partkey AS id, (p_partkey % 48) * 40e0 AS x0, floor(p_partkey / 48e0) * 40e0 AS y0, p_size % 5 AS s, p_size % 7 AS d, p_size % 2 AS odd, p_size % 4 AS q FROM {part}"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.layer(spark, sf_dir, _CELLS, "part")


def _sheared(*places: tuple) -> Column:
    """A closed ring of places (dx, dy) from x0, y0, sheared."""
    points = [*places, places[0]]
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.array(*[c for dx, dy in points for c in (F.col("x0") + as_column(dx) + (F.col("y0") + as_column(dy)) / 2, F.col("y0") + as_column(dy))])


def _box(dx, dy, w, h) -> Column:
    add = lambda a, b: a + b if isinstance(a, Column) or isinstance(b, Column) else float(a + b)
    return _sheared((dx, dy), (add(dx, w), dy), (add(dx, w), add(dy, h)), (dx, add(dy, h)))


def _polygons(*parts: tuple[Column, list[Column]]) -> Column:
    none = F.array().cast("array<array<double>>")
    return F.array(*[F.struct(outer.alias("outer"), (F.array(*holes) if holes else none).alias("holes")) for outer, holes in parts])


def _boxed(df: DataFrame) -> DataFrame:
    return df.drop("x0", "y0").withColumn("b", G.polygons_envelope(F.col("polygons"))).select("*", "b.*").drop("b")


def _two_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of 12 by 10 with a hole of 3 by 3, and a second part of 1 to 5 by 4."""
    d = F.col("s") + 1.0
    return _boxed(_cells(spark, sf_dir).withColumn("polygons", _polygons((_box(0, 0, 12, 10), [_box(3, 3, 3, 3)]), (_box(15, 0, d, 4), []))))


def _other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of 10 by 8 at (d, 2) with a hole of 2 by 2."""
    d = F.col("d").cast("double")
    shape = _polygons((_box(d, 2, 10, 8), [_box(d + 2, 4, 2, 2)]))
    return _boxed(_cells(spark, sf_dir).withColumn("polygons", shape)).select((F.col("id") * 10).alias("osm_id"), F.lit(True).alias("is_way"), "polygons", "x0", "y0", "x1", "y1")


def overlay_multipolygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared area, overlap of the smaller and IoU of slanted footprints with holes and two parts."""
    p = match.with_shared_area(gridjoin.envelope_join(_two_parts(spark, sf_dir), _other(spark, sf_dir)), ["id", "o_osm_id"])
    a, b = (G.shape_area(F.col(c), p.schema[c].dataType.simpleString()) for c in ("polygons", "o_polygons"))
    return p.select("id", F.col("o_osm_id").alias("osm_id"), F.round("shared", 6).alias("shared"), F.round(F.col("shared") / F.least(a, b), 6).alias("overlap"), F.round(F.col("shared") / (a + b - F.col("shared")), 6).alias("iou"))


def match_multipolygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes by the same two layers."""
    c = match.classify(_two_parts(spark, sf_dir), _other(spark, sf_dir))
    return c.select("id", "match_class", "n_partners", F.round("iou", 6).alias("iou"))


def footprint_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _two_parts(spark, sf_dir)
    collapsed = _polygons((F.array(*[F.lit(1.0)] * 8), []))
    p = p.withColumn("polygons", F.when(F.col("id") % 10 == 0, collapsed).otherwise(F.col("polygons")))
    area = G.shape_area(F.col("polygons"), p.schema["polygons"].dataType.simpleString())
    return match.sound(p).select("id", F.round(area, 6).alias("area"), F.round(F.col("x1") - F.col("x0"), 6).alias("width"), F.round(F.col("y1") - F.col("y0"), 6).alias("height"), G.is_simple(F.col("polygons")).alias("simple"))


def difference_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slanted box less two neighbours, which share 20 and (where odd is 0) 10 of its 120 square metres. Ids are strings."""
    c = _cells(spark, sf_dir).withColumn("id", F.concat(F.lit("b"), F.col("id")))
    two = F.when(F.col("odd") == 0, _box(-3, -2, 4, 20)).otherwise(_box(-3, -2, 3, 20))
    candidates = c.select("id", _box(0, 0, 12, 10).alias("ring"))
    near = c.select("id", F.col("s"), F.explode(F.array(F.struct(F.lit(1).cast("long").alias("way_id"), _box(10, -2, 5, 20).alias("way_ring")), F.struct(F.lit(2).cast("long").alias("way_id"), two.alias("way_ring")))).alias("w"))
    near = near.select("id", "w.way_id", F.array().cast("array<long>").alias("nodes"), "w.way_ring").join(candidates, "id")
    out = fit.clip(candidates, near)
    return out.select("id", F.round("clipped", 6).alias("clipped"), F.round(G.area(F.col("fitted")), 6).alias("left_over"), F.size("touched").cast("long").alias("n_touched"), "clip_failed")


def _candidate_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cells(spark, sf_dir)
    return layers.with_ring(c.withColumn("x1", F.col("x0") + 10).withColumn("y1", F.col("y0") + 8))


def _way(c: DataFrame, number: int, nodes: list[tuple], ids: list[int]) -> DataFrame:
    """A neighbour way a candidate: nodes (dx, dy) from its corner, ids unique in the layer."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    ring = F.array(*[x for dx, dy in [*nodes, nodes[0]] for x in (F.col("x0") + as_column(dx), F.col("y0") + as_column(dy))])
    names = F.array(*[(F.col("id") * 100 + k).cast("long") for k in ids])
    w = c.select((F.col("id") * 10 + number).alias("way_id"), names.alias("nodes"), ring.alias("ring"))
    return w.withColumn("b", G.envelope(F.col("ring"))).select("*", "b.*").drop("b")


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cells(spark, sf_dir)
    e = F.col("q") * 0.125
    side = _way(c, 1, [(10 + e, 0.125), (16, 0.125), (16, 8.125), (10 + e, 8.125)], [1, 2, 3, 4])
    below = _way(c, 2, [(2, -6.25), (5, -6.25), (5, -0.25), (2, -0.25)], [5, 6, 7, 8])
    return side.unionByName(below)


def near_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.near_pairs(_candidate_boxes(spark, sf_dir), _neighbours(spark, sf_dir)).select("id", "way_id")


def fit_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two corners snap to a neighbour's, two of its nodes become T-joints."""
    v, summary = fit.fit(_candidate_boxes(spark, sf_dir), _neighbours(spark, sf_dir))
    n = v.groupBy("id").agg(F.count(F.lit(1)).alias("n_vertices"), F.count("node").alias("n_nodes"))
    return summary.join(n, "id").select("id", "n_vertices", "n_nodes", F.round(G.area(F.col("outline")), 6).alias("area"), F.round("clipped", 6).alias("clipped"), F.round("overlap", 6).alias("overlap"), "conflict")


def snapped_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which node each corner takes, and what is glued to a wall: a third way offers a wall but no node."""
    c = _candidate_boxes(spark, sf_dir)
    wall = _way(_cells(spark, sf_dir), 3, [(-5, -9), (-0.25, -9), (-0.25, 19), (-5, 19)], [11, 12, 13, 14])
    near = fit.near_pairs(c, _neighbours(spark, sf_dir).unionByName(wall))
    v = fit.vertices(c.select("id", F.col("ring").alias("fitted")), near)
    return v.where(F.col("place") == F.floor("place")).select("id", F.col("place").cast("long").alias("corner"), "node", "glue_way", F.round("glue_t", 6).alias("glue_t"))


def safe_joints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tips of neighbours become T-joints, the outer one only where no wall is in its way."""
    c = _candidate_boxes(spark, sf_dir)
    cells = _cells(spark, sf_dir)
    tips = _way(cells, 4, [(10.25, 4), (13, 3), (13, 5)], [1, 2, 3]).unionByName(_way(cells, 5, [(9.9375, 6), (13, 5.5), (13, 6.5)], [4, 5, 6]))
    wall = _way(cells.where("odd = 1"), 6, [(10.125, -5), (12, -5), (12, 13), (10.125, 13)], [7, 8, 9, 10])
    v = fit.vertices(c.select("id", F.col("ring").alias("fitted")), fit.near_pairs(c, tips.unionByName(wall)))
    n = v.groupBy("id").agg(F.count(F.lit(1)).alias("n_vertices"), F.count("node").alias("n_joints"))
    return n.join(fit.outline(v), "id").select("id", "n_vertices", "n_joints", F.round(G.area(F.col("outline")), 6).alias("area"))


def _plain_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidate_boxes(spark, sf_dir)
    return fit.vertices(c.select("id", F.col("ring").alias("fitted")), fit.near_pairs(c, _way(_cells(spark, sf_dir), 9, [(0, 500), (1, 500), (1, 501)], [1, 2, 3])))


def _keeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "sliding", -0.5, 4.0, -5.0, 4.0), (2, "on_outline", 5.0, -0.25, None, None), (3, "fixed", 5.0, 8.25, None, None), (4, "fixed", 5.0, 20.0, None, None), (5, "sliding", 5.0, 4.0, 6.0, 4.0), (6, "sliding", -3.0, 2.0, -5.0, 2.0)]
    kinds = spark.createDataFrame(rows, "k int, mode string, dx double, dy double, fx double, fy double")
    c = _cells(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(6))))
    return c.join(F.broadcast(kinds), "k").select("id", (F.col("id") * 100 + F.col("k")).cast("long").alias("node"), "mode", (F.col("x0") + F.col("dx")).alias("x"), (F.col("y0") + F.col("dy")).alias("y"), (F.col("x0") + F.col("fx")).alias("from_x"), (F.col("y0") + F.col("fy")).alias("from_y"))


def kept_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where nodes that must stay connected end up: slid along their line, moved to the wall, held or lost."""
    return fit.keep(_plain_vertices(spark, sf_dir), _keeps(spark, sf_dir)).select("id", F.pmod("node", F.lit(100)).alias("k"), F.round("shift", 6).alias("shift"), "kept")


def kept_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outline after the nodes that hold went into it."""
    v = _plain_vertices(spark, sf_dir)
    out = fit.with_kept(v, fit.keep(v, _keeps(spark, sf_dir)))
    area = fit.outline(out).select("id", F.round(G.area(F.col("outline")), 6).alias("area"))
    return out.groupBy("id").agg(F.count(F.lit(1)).alias("n_vertices"), F.count("node").alias("n_nodes")).join(area, "id")


def shared_edge_densified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A neighbour's node between two snapped corners comes into the outline, if it is near enough (q < 3)."""
    c = _cells(spark, sf_dir)
    bulge = F.when(F.col("q") < 3, 0.25).otherwise(2.0)
    way = _way(c, 1, [(10, 0), (16, 0), (16, 8), (10, 8), (10 + bulge, 4)], [1, 2, 3, 4, 5])
    box = _candidate_boxes(spark, sf_dir)
    near = fit.near_pairs(box, way)
    v = fit.vertices(box.select("id", F.col("ring").alias("fitted")), near, replace(DEFAULTS, snap=0.01))
    v = fit.densified(v, near)
    return v.groupBy("id").agg(F.count(F.lit(1)).alias("n_vertices")).join(fit.outline(v), "id").select("id", "n_vertices", F.round(G.area(F.col("outline")), 6).alias("area"))


def fit_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What outlines share with neighbours: strips of q times 0.0625 by 8 on one side."""
    c = _candidate_boxes(spark, sf_dir)
    way = _way(_cells(spark, sf_dir), 1, [(10 - F.col("q") * 0.0625, 0), (16, 0), (16, 8), (10 - F.col("q") * 0.0625, 8)], [1, 2, 3, 4])
    near = fit.near_pairs(c, way)
    out = fit.conflicts(c.select("id", F.col("ring").alias("outline")), near)
    return out.select("id", F.round("overlap", 6).alias("overlap"), "conflict")


def mitre_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes, sharp triangles (whose mitre is cut back) and distance 0."""
    c = _candidate_boxes(spark, sf_dir)
    d = F.col("q") * 0.25
    grown = c.select("id", G.mitred(F.col("ring"), d).alias("g"), G.mitred(F.array(*[F.lit(float(v)) for v in (0, 0, 30, 0, 0, 3, 0, 0)]), d).alias("t"))
    far = G.polygons_envelope(F.array(F.struct(F.col("t").alias("outer"))))
    return grown.select("id", F.round(G.area(F.col("g")), 6).alias("area"), F.round(far["x1"] - 30, 6).alias("tip"))


def ring_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary distance of a point, and the distance of two boxes that lie apart, touch or overlap."""
    c = _candidate_boxes(spark, sf_dir)
    other = G.rectangle(F.col("x0") + 8 + F.col("s"), F.col("y0") + 6 + F.col("d"), F.col("x0") + 20, F.col("y0") + 20)
    return c.select("id", F.round(G.boundary_distance(F.col("ring"), F.col("x0") + F.col("d"), F.col("y0") + F.col("s")), 6).alias("to_wall"), F.round(G.ring_distance(F.col("ring"), other), 6).alias("apart"))


def nearest_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of five places within 2, the last one of equals."""
    spots = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2), (5, 5))])
    n = G.nearest_point(spots, F.col("d").cast("double"), F.col("s").cast("double"), 2.0)
    return _cells(spark, sf_dir).select("id", n["x"].alias("x"), n["y"].alias("y"))


def great_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("id", F.round(G.great_circle(F.col("s") * 10.0, F.col("d") * 7.0, F.col("s") * 10.0 + 1, F.col("d") * 7.0 + F.col("q")), 3).alias("metres"))


def moved_and_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cells(spark, sf_dir).withColumn("ring", _box(0, 0, 12, 10))
    far = G.scaled(G.moved(F.col("ring"), F.lit(5.0), F.col("q").cast("double")), F.lit(1.5))
    m = G.centroid(far)
    return c.select("id", F.round(G.area(far), 6).alias("area"), F.round(m["x"] - F.col("x0") - F.col("y0") / 2, 6).alias("cx"), F.round(m["y"] - F.col("y0"), 6).alias("cy"))


def clean_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats and closing points taken out; rings of fewer than three places are none."""
    c = _cells(spark, sf_dir)
    ring = F.when(F.col("q") == 0, _sheared((0, 0), (0, 0), (4, 0), (4, 3))).when(F.col("q") == 1, _sheared((0, 0), (1, 1), (0, 0), (1, 1))).when(F.col("q") == 2, F.slice(_sheared((0, 0), (4, 0), (4, 3)), 1, 6)).otherwise(_sheared((0, 0), (4, 0), (4, 3), (4, 3), (0, 3)))
    clean = G.clean_ring(ring)
    return c.select("id", F.coalesce(F.size(clean) / 2, F.lit(0)).cast("long").alias("n_points"), F.when(clean.isNotNull(), F.round(G.area(clean), 6)).alias("area"))


def smallest_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks into stacked boxes: the one with the least envelope is picked."""
    c = _cells(spark, sf_dir)
    big = layers.with_ring(c.select((F.col("id") * 2).alias("id"), "x0", "y0", (F.col("x0") + 12).alias("x1"), (F.col("y0") + 10).alias("y1")))
    small = layers.with_ring(c.select((F.col("id") * 2 + 1).alias("id"), (F.col("x0") + 2).alias("x0"), (F.col("y0") + 2).alias("y0"), (F.col("x0") + 5).alias("x1"), (F.col("y0") + 5).alias("y1")))
    clicks = c.select(F.col("id").alias("point_id"), (F.col("x0") + F.col("d") * 2 + 0.5).alias("x"), (F.col("y0") + F.col("s") + 0.5).alias("y"))
    return match.smallest_hit(big.unionByName(small), clicks)


def at_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways on their official outline: all corners taken, further nodes only on its walls."""
    c = _candidate_boxes(spark, sf_dir)
    at = lambda dx, dy: F.struct((F.col("x0") + dx).alias("x"), (F.col("y0") + dy).alias("y"))
    corners = [at(F.lit(0.0), F.lit(0.0)), at(F.when(F.col("q") == 1, 10.2).otherwise(10.004), F.lit(0.0)), at(F.lit(10.0), F.lit(8.0))]
    extra = at(F.lit(5.0), F.when(F.col("q") == 2, 0.5).otherwise(0.0))
    nodes = F.concat(F.array(*corners, extra), F.when(F.col("q") == 3, F.array().cast("array<struct<x:double,y:double>>")).otherwise(F.array(at(F.lit(0.0), F.lit(8.0)))))
    return c.select("id", G.at_outline(F.col("ring"), nodes).alias("on_outline"))


def _scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of 16 by 16 pixels of half a metre: a bright block of 8 by 6 pixels on dark ground, moved by whole pixels."""
    # The table is a few bytes a picture, so it is dealt out before they are drawn: its file alone would be one task.
    c = _cells(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    c = c.withColumn("mx", (F.col("q") % 3 - 1).cast("int")).withColumn("my", (F.col("d") % 3 - 1).cast("int"))
    px, py = lambda i: i % 16, lambda i: F.floor(i / 16).cast("int")
    inside = lambda i: (px(i) >= 4 + F.col("mx")) & (px(i) < 12 + F.col("mx")) & (py(i) >= 5 - F.col("my")) & (py(i) < 11 - F.col("my"))
    gray = F.transform(F.sequence(F.lit(0), F.lit(16 * 16 - 1)), lambda i: F.when(inside(i), 200.0).otherwise(30.0))
    return c.select("id", "mx", "my", gray.alias("gray"), F.lit(16).alias("w"), F.lit(16).alias("h"), F.lit(0.0).alias("min_x"), F.lit(8.0).alias("max_y"), F.lit(0.5).alias("res"), G.rectangle(*[F.lit(v) for v in (2.0, 2.5, 6.0, 5.5)]).alias("ring"))


_SEARCH = replace(DEFAULTS, offset_range=0.5, max_overhang=0.3, sample_step=1.0)


def offset_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search finds a block moved by up to a pixel: full support, within half a pixel of where it was drawn, without overhang."""
    s = _scene(spark, sf_dir)
    b = raster.derived(raster.best_offset(raster.with_edges(s), ["id", "mx", "my"], params=_SEARCH))
    near = (F.abs(F.col("offset_x") - F.col("mx") * 0.5) <= 0.5) & (F.abs(F.col("offset_y") - F.col("my") * 0.5) <= 0.5)
    return b.select("id", F.round("score", 6).alias("score"), near.alias("found"), F.round("overhang", 6).alias("overhang"), "samples", "masked", "valid", F.round("masked_share", 6).alias("masked_share"))


def score_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support at the drawn place, and in a picture without edges."""
    s = raster.with_edges(_scene(spark, sf_dir)).withColumn("overhang", F.lit(0.0)).withColumn("offset_y", F.col("my") * 0.5)
    good = raster.score_at(s.withColumn("offset_x", F.col("mx") * 0.5), ["id"], params=_SEARCH)
    bare = raster.score_at(s.withColumn("mag", F.transform("mag", lambda m: F.lit(0.0))).withColumn("offset_x", F.lit(0.0)), ["id"], params=_SEARCH)
    return good.select("id", F.round("score", 6).alias("score"), "samples").join(bare.select("id", F.round("score", 6).alias("bare")), "id")


def image_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole check: classes that need none are left out, a missing picture and a failed one leave their error."""
    s = _scene(spark, sf_dir)
    kind = F.when(F.col("id") % 4 == 3, "IDENTISCH").when(F.col("id") % 4 == 2, "ABWEICHEND").otherwise("NEU")
    c = s.select("id", kind.alias("match_class"), "ring", F.when(F.col("id") % 4 == 2, F.col("ring")).alias("partner_ring"), F.array().cast("array<array<double>>").alias("mask"))
    failed = F.col("id") % 8 == 1
    images = s.where("id % 8 <> 0").select("id", *[F.when(~failed, F.col(x)).alias(x) for x in ("w", "h", "min_x", "max_y", "res", "gray")], F.when(failed, "no picture").alias("error"))
    out = raster.checked(c, images, _SEARCH)
    return out.select("id", F.round("score", 6).alias("score"), F.round("map_score", 6).alias("map_score"), "error", "hint")


def luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("id", F.round(raster.luma(F.col("s") * 50, F.col("d") * 36, F.col("q") * 63), 6).alias("gray"))


def preview_arrows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From official corners to fitted vertices: only those that moved by 2 cm to a metre."""
    c = _candidate_boxes(spark, sf_dir)
    corners = c.select("id", F.posexplode(F.slice(G.points(F.col("ring")), 1, 4)).alias("corner", "p")).select("id", "corner", "p.x", "p.y")
    v, _ = fit.fit(c, _neighbours(spark, sf_dir))
    return edits.preview_arrows(corners, v).select("id", F.col("corner").cast("long").alias("corner"), F.round(F.col("to_x") - F.col("x"), 6).alias("dx"), F.round(F.col("to_y") - F.col("y"), 6).alias("dy"))


QUERIES = {
    f.__name__: f
    for f in (overlay_multipolygon, match_multipolygon, footprint_measures, difference_clip, near_neighbours, fit_outlines, snapped_corners, safe_joints, kept_nodes, kept_inserted, shared_edge_densified, fit_conflicts, mitre_buffer, ring_distances, nearest_corners, great_circles, moved_and_scaled, clean_rings, smallest_hits, at_outlines, offset_best, score_fixed, image_check, luma, preview_arrows)
}

_C = f"c AS ({_CELLS.format(part='part')})"
#: Unit cells of both footprints, counted from the corner of each id.
_COUNTED = f"""{_C}, g AS (SELECT c.id, i, j, (i < 12 AND j < 10 AND NOT (i BETWEEN 3 AND 5 AND j BETWEEN 3 AND 5)) OR (i >= 15 AND i < 16 + s AND j < 4) AS a,
  i >= d AND i < d + 10 AND j >= 2 AND j < 10 AND NOT (i >= d + 2 AND i < d + 4 AND j >= 4 AND j < 6) AS b FROM c, range(24) u(i), range(12) w(j)),
t AS (SELECT id, count(*) FILTER (a AND b) AS n, count(*) FILTER (a) AS na, count(*) FILTER (b) AS nb FROM g GROUP BY id)"""

ORACLES = {
    "overlay_multipolygon": f"WITH {_COUNTED} SELECT id, id * 10 AS osm_id, n::DOUBLE AS shared, round(n / least(na, nb), 6) AS overlap, round(n / (na + nb - n), 6) AS iou FROM t",
    "match_multipolygon": f"WITH {_COUNTED} SELECT id, CASE WHEN n / least(na, nb) < 0.3 THEN 'NEU' WHEN n / (na + nb - n) >= 0.3 THEN 'ABWEICHEND' ELSE 'KOMPLEX' END AS match_class, (CASE WHEN n / least(na, nb) < 0.3 THEN 0 ELSE 1 END)::BIGINT AS n_partners, CASE WHEN n / least(na, nb) >= 0.3 THEN round(n / (na + nb - n), 6) END AS iou FROM t",
    "footprint_measures": f"WITH {_C} SELECT id, (111 + 4 * (s + 1))::DOUBLE AS area, greatest(17, 18 + s, 16 + s)::DOUBLE AS width, 10::DOUBLE AS height, false AS simple FROM c WHERE id % 10 <> 0",
    "difference_clip": f"WITH {_C} SELECT 'b' || id AS id, (20 + CASE WHEN odd = 0 THEN 10 ELSE 0 END)::DOUBLE AS clipped, (100 - CASE WHEN odd = 0 THEN 10 ELSE 0 END)::DOUBLE AS left_over, (1 + CASE WHEN odd = 0 THEN 1 ELSE 0 END)::BIGINT AS n_touched, false AS clip_failed FROM c",
    "near_neighbours": f"WITH {_C} SELECT id, id * 10 + k AS way_id FROM c, (SELECT unnest([1, 2]) AS k)",
    "fit_outlines": f"""WITH {_C}, p AS (SELECT id, [0, 2, 5, 10 + q * 0.125e0, 10 + q * 0.125e0, 0] AS x, [0, -0.25e0, -0.25e0, 0.125e0, 8.125e0, 8] AS y FROM c)
        SELECT id, 6::BIGINT AS n_vertices, 4::BIGINT AS n_nodes, round(list_sum(list_transform(range(1, 7), lambda i: x[i] * y[i % 6 + 1] - x[i % 6 + 1] * y[i])) / 2, 6) AS area, 0::DOUBLE AS clipped, 0::DOUBLE AS overlap, false AS conflict FROM p""",
    "snapped_corners": f"""WITH {_C} SELECT id, k::BIGINT AS corner, CASE k WHEN 1 THEN id * 100 + 1 WHEN 2 THEN id * 100 + 4 END AS node, CASE WHEN k IN (0, 3) THEN id * 10 + 3 END AS glue_way, CASE k WHEN 0 THEN round(9 / 28e0, 6) WHEN 3 THEN round(17 / 28e0, 6) END AS glue_t FROM c, (SELECT unnest([0, 1, 2, 3]) AS k)""",
    "safe_joints": f"WITH {_C} SELECT id, (6 - odd)::BIGINT AS n_vertices, (2 - odd)::BIGINT AS n_joints, CASE WHEN odd = 1 THEN 80.25e0 ELSE 80.625e0 END AS area FROM c",
    "kept_nodes": f"WITH {_C} SELECT id, k::BIGINT AS k, shift, kept FROM c, (SELECT * FROM (VALUES (1, 0.5e0, true), (2, 0.25e0, true), (3, 0e0, true), (4, 0e0, false), (5, 0e0, false), (6, 0e0, false)) v(k, shift, kept))",
    "kept_inserted": f"WITH {_C} SELECT id, 7::BIGINT AS n_vertices, 3::BIGINT AS n_nodes, 81.25e0 AS area FROM c",
    "shared_edge_densified": f"WITH {_C} SELECT id, (CASE WHEN q < 3 THEN 5 ELSE 4 END)::BIGINT AS n_vertices, CASE WHEN q < 3 THEN 81e0 ELSE 80e0 END AS area FROM c",
    "fit_conflicts": f"WITH {_C} SELECT id, round(q * 0.5e0, 6) AS overlap, q > 0 AS conflict FROM c",
    "mitre_buffer": f"""WITH {_C}, m AS (SELECT id, q * 0.25e0 AS r FROM c), t AS (SELECT id, r, 3 * sqrt(0.01e0 / 1.01e0) AS ny, sqrt(1 / 1.01e0) AS nz FROM m)
        SELECT m.id, round(80 + 36 * r + 4 * r * r, 6) AS area,
               round(CASE WHEN r = 0 THEN 0 ELSE least(1 / (1 - 1 / sqrt(1.01e0)) , 3 / sqrt(2 * (1 - 1 / sqrt(1.01e0)))) * r * (1 / sqrt(101e0)) END, 6) AS tip FROM m""",
    "ring_distances": f"""WITH {_C} SELECT id, round(CASE WHEN s <= 8 AND d <= 10 THEN least(d, 10 - d, s, 8 - s) END, 6)::DOUBLE AS to_wall, round(sqrt(greatest(0, s - 2) ** 2 + greatest(0, d - 2) ** 2), 6) AS apart FROM c""",
    "nearest_corners": f"""WITH {_C}, p AS (SELECT * FROM (VALUES (0, 0e0, 0e0), (1, 2e0, 0e0), (2, 2e0, 2e0), (3, 0e0, 2e0), (4, 5e0, 5e0)) v(k, px, py)),
        n AS (SELECT id, arg_min(px, ((px - d) ** 2 + (py - s) ** 2, -k)) AS x, arg_min(py, ((px - d) ** 2 + (py - s) ** 2, -k)) AS y FROM c, p WHERE (px - d) ** 2 + (py - s) ** 2 <= 4 GROUP BY id) SELECT c.id, n.x, n.y FROM c LEFT JOIN n USING (id)""",
    "great_circles": f"WITH {_C}, r AS (SELECT id, radians(s * 10) AS a, radians(s * 10 + 1) AS b, radians(q) AS l FROM c) SELECT id, round(2 * 6378137e0 * asin(sqrt(pow(sin((b - a) / 2), 2) + cos(a) * cos(b) * pow(sin(l / 2), 2))), 3) AS metres FROM r",
    "moved_and_scaled": f"WITH {_C} SELECT id, 270e0 AS area, 13.5e0 AS cx, (5 + q)::DOUBLE AS cy FROM c",
    "clean_rings": f"WITH {_C} SELECT id, (CASE q WHEN 0 THEN 4 WHEN 1 THEN 0 WHEN 2 THEN 4 ELSE 5 END)::BIGINT AS n_points, CASE q WHEN 0 THEN 6e0 WHEN 2 THEN 6e0 WHEN 3 THEN 12e0 END AS area FROM c",
    "smallest_hits": f"WITH {_C}, k AS (SELECT id, d * 2 + 0.5e0 AS x, s + 0.5e0 AS y FROM c) SELECT id AS point_id, CASE WHEN x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 THEN id * 2 + 1 ELSE id * 2 END AS id FROM k WHERE x < 12",
    "at_outlines": f"WITH {_C} SELECT id, q = 0 AS on_outline FROM c",
    "offset_best": f"WITH {_C} SELECT id, 1e0 AS score, true AS found, 0e0 AS overhang, 14::BIGINT AS samples, 0::BIGINT AS masked, true AS valid, 0e0 AS masked_share FROM c",
    "score_fixed": f"WITH {_C} SELECT id, 1e0 AS score, 14::BIGINT AS samples, 0e0 AS bare FROM c",
    "image_check": f"WITH {_C} SELECT id, CASE WHEN id % 8 NOT IN (0, 1) THEN 1e0 END AS score, CASE WHEN id % 4 = 2 THEN 1e0 END AS map_score, CASE id % 8 WHEN 0 THEN 'no image' WHEN 1 THEN 'no picture' END AS error, NULL::VARCHAR AS hint FROM c WHERE id % 4 <> 3",
    "luma": f"WITH {_C} SELECT id, round(0.299e0 * s * 50 + 0.587e0 * d * 36 + 0.114e0 * q * 63, 6) AS gray FROM c",
    "preview_arrows": f"WITH {_C} SELECT id, k::BIGINT AS corner, round(q * 0.125e0, 6) AS dx, 0.125e0 AS dy FROM c, (SELECT unnest([1, 2]) AS k)",
}
