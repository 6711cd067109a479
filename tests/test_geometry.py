"""Geometry, overlay and fitting on figures worked out by hand, and overlay against random star polygons."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plotlink.functions import crs
from plotlink.functions import geometry as G
from plotlink.operators import edits, fit, graph, match, overlay


def box(x, y, w, h):
    return [x, y, x + w, y, x + w, y + h, x, y + h, x, y]


def rings(spark, rows, key="id"):
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in rows], f"{key} long, ring array<double>")
    return d.withColumn("b", G.envelope(F.col("ring"))).select("*", "b.*").drop("b")


def first(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("v")).first().v


def lit_ring(r):
    return F.array(*[F.lit(float(v)) for v in r])


def test_scalars(spark):
    square = lit_ring(box(0, 0, 10, 10))
    assert first(spark, G.area(square)) == 100 and first(spark, G.perimeter(square)) == 40
    assert tuple(first(spark, G.centroid(square))) == (5, 5)
    assert first(spark, G.clean_ring(lit_ring([0, 0, 0, 0, 4, 0, 4, 3]))) == [0, 0, 4, 0, 4, 3, 0, 0]
    assert first(spark, G.clean_ring(lit_ring([0, 0, 1, 1, 0, 0]))) is None
    assert first(spark, G.envelope(G.mitred(square, F.lit(0.5)))) == (-0.5, -0.5, 10.5, 10.5)
    assert first(spark, G.mitred(square, F.lit(0.0))) == box(0, 0, 10, 10)
    assert first(spark, G.area(G.scaled(square, F.lit(1.4)))) == pytest.approx(196)
    assert first(spark, G.segment_foot(*[F.lit(v) for v in (5.0, 3.0, 0.0, 0.0, 10.0, 0.0)])) == (5, 0, 3, 0.5)
    assert first(spark, G.segment_foot(*[F.lit(v) for v in (-1.0, 3.0, 0.0, 0.0, 10.0, 0.0)])) is None
    assert first(spark, G.ray_hit(*[F.lit(v) for v in (0.0, 0.0, 1.0, 0.0, 4.0, -1.0, 4.0, 1.0)])) == (4, 0, 4, 0.5)
    assert first(spark, G.ray_hit(*[F.lit(v) for v in (0.0, 0.0, 1.0, 0.0, -4.0, -1.0, -4.0, 1.0)])) is None
    assert first(spark, G.great_circle(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])) == pytest.approx(111319.49, abs=0.1)


def test_two_overlapping_squares(spark):
    p = spark.createDataFrame([(1, box(0.0, 0.0, 10.0, 10.0), box(5.0, 0.0, 10.0, 10.0))], "id long, a array<double>, b array<double>")
    assert overlay.shared_area(p.select("id", F.array("a").alias("a"), F.array("b").alias("b")), ["id"], "a", "b").first().shared == pytest.approx(50)
    assert overlay.discrete_hausdorff(p, ["id"], "a", "b").first().hausdorff == pytest.approx(5)


def star(rng, cx, cy):
    n = rng.randint(5, 11)
    p = [(cx + r * math.cos(a), cy + r * math.sin(a)) for k in range(n) for a, r in [(2 * math.pi * k / n, rng.uniform(1, 5))]]
    return [float(v) for q in [*p, p[0]] for v in q]


def test_overlay_of_non_convex_polygons_against_the_jts_that_spark_ships(spark):
    jvm = spark.sparkContext._jvm
    try:
        reader = jvm.org.locationtech.jts.io.WKTReader()
    except TypeError:
        pytest.skip("no JTS on this class path")
    rng = random.Random(8)
    rows = [(k, star(rng, 0, 0), star(rng, rng.uniform(-4, 4), rng.uniform(-4, 4))) for k in range(60)]
    hole = [2.0, 2.0, 2.0, 4.0, 4.0, 4.0, 4.0, 2.0, 2.0, 2.0]
    d = spark.createDataFrame([(k, [a], [b]) for k, a, b in rows] + [(99, [box(0.0, 0.0, 6.0, 6.0), hole], [box(3.0, 0.0, 6.0, 6.0)])], "id long, a array<array<double>>, b array<array<double>>")
    got = {r.id: r.shared for r in overlay.shared_area(d, ["id"], "a", "b").collect()}
    wkt = lambda r: "POLYGON((" + ", ".join(f"{x!r} {y!r}" for x, y in zip(r[::2], r[1::2], strict=True)) + "))"
    for k, a, b in rows:
        assert got[k] == pytest.approx(reader.read(wkt(a)).intersection(reader.read(wkt(b))).getArea(), abs=1e-6)
    assert got[99] == pytest.approx(18 - 2)


def test_classification_rules(spark):
    official = rings(spark, [(1, box(0, 0, 10, 10)), (2, box(100, 0, 10, 10)), (3, box(200, 0, 10, 10)), (4, box(300, 0, 10, 10)), (5, box(310, 0, 10, 10)), (6, box(400, 0, 10, 10)), (7, box(500, 0, 10, 10)), (8, box(600, 0, 10, 10))])
    mapped = rings(spark, [(20, box(100.1, 0, 10, 10)), (30, box(202, 0, 10, 10)), (40, box(300, 0, 20, 10)), (60, box(400, 0, 5, 10)), (61, box(405, 0, 5, 10)), (70, box(500, 0, 10, 10)), (80, box(609.5, 0, 10, 10))], "osm_id").withColumn("is_way", F.col("osm_id") != 70)
    got = {r.id: (r.match_class, r.n_partners) for r in match.classify(official, mapped).collect()}
    assert got == {1: ("NEU", 0), 2: ("IDENTISCH", 1), 3: ("ABWEICHEND", 1), 4: ("KOMPLEX", 1), 5: ("KOMPLEX", 1), 6: ("KOMPLEX", 2), 7: ("IDENTISCH", 1), 8: ("NEU", 0)}
    assert {r.osm_id for r in match.map_only(official, mapped.unionByName(rings(spark, [(90, box(900, 0, 5, 5))], "osm_id").withColumn("is_way", F.lit(True)))).collect()} == {80, 90}


def test_utm_round_trip(spark):
    p = spark.createDataFrame([(51.0, 7.0), (48.137, 11.575), (54.9, 8.3), (47.3, 6.1)], "lat double, lon double").withColumn("p", crs.project(F.col("lat"), F.col("lon"), 32)).withColumn("q", crs.unproject(F.col("p.x"), F.col("p.y"), 32))
    for r in p.collect():
        assert abs(r.q.lat - r.lat) < 1e-9 and abs(r.q.lon - r.lon) < 1e-9
    munich = next(r for r in p.collect() if r.lon == 11.575)
    assert (munich.p.x, munich.p.y) == (pytest.approx(691604, abs=60), pytest.approx(5334765, abs=60))
    assert crs.zone_of("EPSG:25833") == 33
    with pytest.raises(ValueError):
        crs.zone_of("EPSG:4326")


def test_fit(spark):
    c = rings(spark, [(1, box(0, 0, 10, 10)), (2, box(100, 0, 10, 10)), (3, box(200, 0, 10, 10)), (4, box(300, 0, 10, 10))])
    n = rings(spark, [(11, box(9, -5, 10, 20)), (12, box(110.2, 0.1, 10, 10)), (13, box(210.2, 3, 8, 4)), (14, box(302, 2, 7, 7))], "way_id")
    n = n.withColumn("nodes", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: (F.col("way_id") * 10 + k).cast("long")))
    v, summary = fit.fit(c, n)
    s = {r.id: r for r in summary.collect()}
    assert s[1].clipped == pytest.approx(10) and s[1].touched == [11] and not s[1].conflict and s[1].overlap == 0
    assert s[4].clip_failed and s[4].conflict and s[4].overlap == pytest.approx(49)
    placed = {(r.id, round(r.place, 2)): (r.node, r.glue_way) for r in v.collect()}
    assert placed[(1, 1.0)] == (None, 11)  # glued into the neighbour's wall
    assert placed[(2, 1.0)] == (121, None) and placed[(2, 2.0)] == (124, None)  # its corners
    assert placed[(3, 1.3)] == (131, None) and placed[(3, 1.7)] == (134, None)  # T-joints
    keeps = spark.createDataFrame([(2, 1, 99.0, 5.0, "sliding", 90.0, 5.0), (2, 2, 105.0, -0.2, "on_outline", None, None), (2, 3, 105.0, 20.0, "fixed", None, None), (2, 4, 105.0, 5.0, "sliding", 106.0, 5.0)], "id long, node long, x double, y double, mode string, from_x double, from_y double")
    k = {r.node: r for r in fit.keep(v, keeps).collect()}
    assert k[1].kept and k[1].to_x == pytest.approx(100) and k[2].kept and k[2].to_y == pytest.approx(0.0490, abs=0.01)
    assert not k[3].kept and not k[4].kept


def test_joints_that_lead_into_a_neighbour_are_left_out(spark):
    c = rings(spark, [(k, box(100 * k, 0, 10, 10)) for k in (1, 2, 3, 4, 5)] + [(6, [600, 0, 600, 10, 610, 10, 610, 0, 600, 0])])
    spike = lambda x, y, tip: [x + tip, y, x + 13, y - 1, x + 13, y + 1, x + tip, y]
    wall = lambda x: box(x + 10.1, -5, 2, 20)  # noqa: E731  reaches past the edge, so it has no node along it
    step = lambda x: box(x + 10.1, 1, 2, 2)  # noqa: E731  in the way of the spike alone, not of a path over its own nodes
    n = [(11, spike(100, 5, 10.3)), (21, spike(200, 5, 10.3)), (22, wall(200)), (31, spike(300, 5, 10.3)), (32, spike(300, 8, 9.95)), (33, wall(300)), (41, spike(400, 5, 10.3)), (42, step(400)), (51, spike(500, 5, 10.05)), (52, spike(500, 7, 10.3)), (53, box(510.15, 6, 3, 9)), (61, spike(600, 5, 10.3)), (62, wall(600))]
    near = rings(spark, n, "way_id").withColumn("nodes", F.transform(F.sequence(F.lit(1), (F.size("ring") / 2).cast("int") - 1), lambda k: (F.col("way_id") * 10 + k).cast("long")))
    pairs = fit.near_pairs(c, near)
    got = fit.vertices(c.select("id", F.col("ring").alias("fitted")), pairs).where("place <> floor(place)").collect()
    assert {(r.id, r.node) for r in got} == {(1, 111), (3, 321), (4, 411), (4, 421), (4, 424), (5, 511), (5, 531)}


def test_node_assignment_and_edits(spark):
    free = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0), (1, 2, 20.0, 0.0)], "way_id long, corner int, x double, y double")
    pool = spark.createDataFrame([(1, 7, 9.0, 0.0), (1, 8, 11.0, 0.0)], "way_id long, node_id long, nx double, ny double")
    a = edits.assigned_nodes(free, pool)
    assert {(r.corner, r.node_id) for r in a.collect()} == {(1, 7), (2, 8)} or {(r.corner, r.node_id) for r in a.collect()} == {(1, 7), (0, 8)} or {r.node_id for r in a.collect()} == {7, 8}
    crossing = spark.createDataFrame([(1, 0, 0.0, 0.0, 7, 10.0, 1.0, math.hypot(10, 1)), (1, 1, 10.0, 0.0, 8, 0.0, 1.0, math.hypot(10, 1))], "way_id long, corner int, x double, y double, node_id long, nx double, ny double, d double")
    assert {(r.corner, r.node_id, r.d) for r in edits.uncrossed(crossing).collect()} == {(0, 8, 1.0), (1, 7, 1.0)}
    ways = spark.createDataFrame([(5, 0, 50), (5, 1, 51), (5, 2, 52), (5, 3, 50)], "way_id long, pos int, node_id long")
    glued = spark.createDataFrame([(5, 1, 0.7, 91), (5, 1, 0.2, 90), (None, None, None, 1)], "glue_way long, glue_segment int, glue_t double, node_id long")
    assert [r.node_id for r in edits.glue_inserts(ways, glued).orderBy("pos").collect()] == [50, 51, 90, 91, 52, 50]
    assert {r.node_id for r in edits.reusable_nodes(ways.unionByName(spark.createDataFrame([(6, 0, 51)], ways.schema)), spark.createDataFrame([(52,)], "node_id long"), spark.createDataFrame([(5,)], "way_id long")).collect()} == {50}
    log = spark.createDataFrame([(1, "applied", None), (2, "rejected", None), (3, "undo", 1), (4, "undo", 2), (5, "redo", 2)], "seq long, decision string, undone long")
    assert [r.seq for r in edits.effective_log(log).collect()] == [2]


def test_reachability_is_directed_and_stops_on_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "src long, dst long")
    got = graph.reachable(e, spark.createDataFrame([(1,), (4,)], "start long")).collect()
    assert {(r.start, r.node) for r in got} == {(1, 1), (1, 2), (1, 3), (4, 4), (4, 1), (4, 2), (4, 3)}
