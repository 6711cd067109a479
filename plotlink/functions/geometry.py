"""Planar geometry as Column expressions. A ring is a flat, closed array x0, y0, x1, y1, ... of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = "array<struct<ax:double,ay:double,bx:double,by:double>>"


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once: Column functions repeat their arguments' whole trees otherwise."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Counter-clockwise closed ring."""
    return F.array(x0, y0, x1, y0, x1, y1, x0, y1, x0, y0)


def points(ring: Column) -> Column:
    """array<struct<x, y>>, the closing point included."""
    at = lambda r: F.transform(F.sequence(F.lit(1), F.size(r) - 1, F.lit(2)), lambda i: F.struct(F.element_at(r, i).alias("x"), F.element_at(r, i + 1).alias("y")))
    return let(ring, at)


def edges(ring: Column) -> Column:
    """array<struct<ax, ay, bx, by>> of a closed ring."""
    edge = lambda r, k: F.struct(F.element_at(r, k).alias("ax"), F.element_at(r, k + 1).alias("ay"), F.element_at(r, k + 2).alias("bx"), F.element_at(r, k + 3).alias("by"))
    of = lambda r: F.when(F.size(r) >= 4, F.transform(F.sequence(F.lit(1), F.size(r) - 3, F.lit(2)), lambda k: edge(r, k))).otherwise(F.array().cast(EDGE))
    return let(ring, of)


def signed_area(ring: Column) -> Column:
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + (e["ax"] * e["by"] - e["bx"] * e["ay"]) / 2)


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"]))


def envelope(ring: Column) -> Column:
    xs, ys = F.transform(points(ring), lambda p: p["x"]), F.transform(points(ring), lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def oriented(ring: Column) -> Column:
    """The ring counter-clockwise."""
    back = lambda r: F.flatten(F.transform(F.reverse(points(r)), lambda p: F.array(p["x"], p["y"])))
    return let(ring, lambda r: F.when(signed_area(r) < 0, back(r)).otherwise(r))


def clockwise(ring: Column) -> Column:
    """The ring clockwise."""
    return let(oriented(ring), turned)


def turned(ring: Column) -> Column:
    """The ring run the other way."""
    return F.flatten(F.transform(F.reverse(points(ring)), lambda p: F.array(p["x"], p["y"])))


def shape_edges(shape: Column, kind: str) -> Column:
    """All edges of a footprint, outer rings counter-clockwise and holes clockwise. kind, its type: `array<double>` is one
    ring, `array<array<double>>` rings of which those whose centroid lies in an odd number of larger ones are holes,
    anything else polygons (array<struct<outer, holes>>)."""
    if kind == "array<double>":
        return edges(oriented(shape))
    if kind == "array<array<double>>":

        def of(rings: Column) -> Column:
            def one(r: Column) -> Column:
                around = let(centroid(r), lambda c: F.size(F.filter(rings, lambda o: (area(o) > area(r)) & contains_point(o, c["x"], c["y"]))))
                return edges(F.when(around % 2 == 1, clockwise(r)).otherwise(oriented(r)))

            return F.flatten(F.transform(rings, one))

        return let(shape, of)
    return F.flatten(F.transform(shape, lambda p: F.concat(edges(oriented(p["outer"])), F.flatten(F.transform(p["holes"], lambda h: edges(clockwise(h)))))))


def shape_corners(shape: Column, kind: str) -> Column:
    """How many corners a footprint has, closing ones included; kind as in shape_edges."""
    flat = shape if kind == "array<double>" else F.flatten(shape) if kind == "array<array<double>>" else F.flatten(F.transform(shape, lambda p: F.concat(p["outer"], F.flatten(p["holes"]))))
    return F.floor(F.size(flat) / 2).cast("int")


def edges_area(items: Column) -> Column:
    """Area inside directed edges such as shape_edges gives."""
    return F.aggregate(items, F.lit(0.0), lambda s, e: s + (e["ax"] * e["by"] - e["bx"] * e["ay"]) / 2)


def shape_area(shape: Column, kind: str) -> Column:
    return area(shape) if kind == "array<double>" else edges_area(shape_edges(shape, kind))


def polygons_envelope(polygons: Column) -> Column:
    """struct<x0, y0, x1, y1> over the outer rings."""
    return envelope(F.flatten(F.transform(polygons, lambda p: p["outer"])))


def is_simple(polygons: Column) -> Column:
    """One polygon without holes."""
    return (F.size(polygons) == 1) & F.forall(polygons, lambda p: F.size(p["holes"]) == 0)


def inside_edges(items: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over all rings of a footprint."""
    crosses = lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"])
    return F.size(F.filter(items, crosses)) % 2 == 1


def boundary_distance(ring: Column, x: Column, y: Column) -> Column:
    """Distance of a point from a ring."""
    return F.array_min(F.transform(edges(ring), lambda e: segment_distance(x, y, e["ax"], e["ay"], e["bx"], e["by"])))


def ring_distance(a: Column, b: Column) -> Column:
    """Distance of two rings' areas: 0 where they meet, else the least distance of a corner of one from an edge of the other."""

    def of(p: Column, q: Column) -> Column:
        cross = lambda ox, oy, e: (e["bx"] - e["ax"]) * (oy - e["ay"]) - (e["by"] - e["ay"]) * (ox - e["ax"])
        meet = lambda s, t: (cross(s["ax"], s["ay"], t) * cross(s["bx"], s["by"], t) < 0) & (cross(t["ax"], t["ay"], s) * cross(t["bx"], t["by"], s) < 0)
        cut = F.exists(edges(p), lambda s: F.exists(edges(q), lambda t: meet(s, t)))
        within = contains_point(p, F.get(q, 0), F.get(q, 1)) | contains_point(q, F.get(p, 0), F.get(p, 1))
        from_corners = lambda r, o: F.array_min(F.transform(points(r), lambda c: boundary_distance(o, c["x"], c["y"])))
        apart = F.least(from_corners(p, q), from_corners(q, p))
        return F.when(cut | within, 0.0).otherwise(apart)

    return let(a, lambda p: let(b, lambda q: of(p, q)))


def nearest_point(corners: Column, x: Column, y: Column, most: float) -> Column:
    """The point of array<struct<x, y>> nearest to (x, y) within `most`, the last one of equally near ones; else null."""
    ranked = F.transform(corners, lambda p, i: F.struct(F.hypot(p["x"] - x, p["y"] - y).alias("d"), (-i).alias("k"), p["x"].alias("x"), p["y"].alias("y")))
    return let(F.array_min(F.filter(ranked, lambda r: r["d"] <= most)), lambda m: F.when(m.isNotNull(), F.struct(m["x"].alias("x"), m["y"].alias("y"), m["d"].alias("d"))))


def at_outline(ring: Column, nodes: Column, eps: float = 0.01) -> Column:
    """Whether a map way lies on an official outline: every node within eps of it, and a node within eps of every corner.
    nodes: array<struct<x, y>>; an unknown place says no."""
    known = F.forall(nodes, lambda n: n["x"].isNotNull() & n["y"].isNotNull())
    on = F.forall(nodes, lambda n: boundary_distance(ring, n["x"], n["y"]) <= eps)
    return F.coalesce(known & on & F.forall(points(ring), lambda c: F.exists(nodes, lambda n: F.hypot(n["x"] - c["x"], n["y"] - c["y"]) <= eps)), F.lit(False))


def area_guard(box: Column, most_km2: float = 1.0) -> Column:
    """Whether a box in metres is small enough to be fetched."""
    return (box["x1"] - box["x0"]) * (box["y1"] - box["y0"]) <= most_km2 * 1e6


def centroid(ring: Column) -> Column:
    """Area centroid; the middle of the envelope where the area is 0."""
    cross = lambda s: s["ax"] * s["by"] - s["bx"] * s["ay"]

    def of(r: Column) -> Column:
        sums = F.aggregate(edges(r), F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), lambda s, k: F.struct((s["a"] + cross(k)).alias("a"), (s["x"] + (k["ax"] + k["bx"]) * cross(k)).alias("x"), (s["y"] + (k["ay"] + k["by"]) * cross(k)).alias("y")))
        middle = lambda b: F.struct(((b["x0"] + b["x1"]) / 2).alias("x"), ((b["y0"] + b["y1"]) / 2).alias("y"))
        return let(sums, lambda s: F.when(s["a"] != 0, F.struct((s["x"] / (3 * s["a"])).alias("x"), (s["y"] / (3 * s["a"])).alias("y"))).otherwise(let(envelope(r), middle)))

    return let(ring, of)


def contains_point(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule; a crossing is counted for edges that pass from at or below y to above it or back."""
    crosses = lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"])
    return F.size(F.filter(edges(ring), crosses)) % 2 == 1


def segment_foot(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column, margin: float = 1e-6) -> Column:
    """struct<x, y, dist, t> of the perpendicular foot; null if it falls on or beyond the ends."""
    dx, dy = bx - ax, by - ay
    t = ((px - ax) * dx + (py - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    fx, fy = ax + t * dx, ay + t * dy
    return F.when((t > margin) & (t < 1 - margin), F.struct(fx.alias("x"), fy.alias("y"), F.hypot(px - fx, py - fy).alias("dist"), t.alias("t")))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment, ends included."""
    dx, dy = bx - ax, by - ay
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((px - ax) * dx + (py - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def ray_hit(ox: Column, oy: Column, dx: Column, dy: Column, ax: Column, ay: Column, bx: Column, by: Column, eps: float = 1e-9) -> Column:
    """struct<x, y, s, u>: where the ray o + s d, s > 0, meets the segment at u in [0, 1]; null if parallel or missed."""
    ex, ey = bx - ax, by - ay
    det = dx * ey - dy * ex
    s = ((ax - ox) * ey - (ay - oy) * ex) / F.nullif(det, F.lit(0.0))
    u = ((ax - ox) * dy - (ay - oy) * dx) / F.nullif(det, F.lit(0.0))
    hit = (F.abs(det) > eps) & (s > 0) & (u >= -eps) & (u <= 1 + eps)
    return F.when(hit, F.struct((ox + s * dx).alias("x"), (oy + s * dy).alias("y"), s.alias("s"), u.alias("u")))


def mitred(ring: Column, distance: Column, limit: float = 3.0) -> Column:
    """The ring moved outward with mitred corners; a mitre longer than limit * distance is cut back to it.

    Distance 0 returns the ring. Corners move along the bisector of their edges' outward normals.
    """

    def normal(k: Column) -> Column:
        size = F.hypot(k["bx"] - k["ax"], k["by"] - k["ay"])
        return F.struct(((k["by"] - k["ay"]) / size).alias("x"), ((k["ax"] - k["bx"]) / size).alias("y"), k["ax"].alias("px"), k["ay"].alias("py"))

    def corner(one: Column, two: Column) -> Column:
        half = F.greatest((1 + one["x"] * two["x"] + one["y"] * two["y"]) / 2, F.lit(1e-12))  # cos^2 of half the turn
        factor = F.least(1 / half / 2, limit / (2 * F.sqrt(half)))
        return let(factor, lambda f: F.array(two["px"] + distance * (one["x"] + two["x"]) * f, two["py"] + distance * (one["y"] + two["y"]) * f))

    def around(n: Column) -> Column:
        before = F.concat(F.slice(n, F.size(n), F.lit(1)), F.slice(n, F.lit(1), F.size(n) - 1))
        return F.zip_with(before, n, corner)

    solid = F.filter(edges(oriented(ring)), lambda k: (k["ax"] != k["bx"]) | (k["ay"] != k["by"]))
    grown = let(let(F.transform(solid, normal), around), lambda m: F.flatten(F.concat(m, F.slice(m, 1, 1))))
    return F.when(distance == 0, ring).otherwise(grown)


def moved(ring: Column, dx: Column, dy: Column) -> Column:
    return F.transform(ring, lambda v, i: v + F.when(i % 2 == 0, dx).otherwise(dy))


def scaled(ring: Column, factor: Column) -> Column:
    """Scaled about the centroid."""
    return let(centroid(ring), lambda c: F.transform(ring, lambda v, i: F.when(i % 2 == 0, c["x"] + (v - c["x"]) * factor).otherwise(c["y"] + (v - c["y"]) * factor)))


def clean_ring(ring: Column, eps: float = 1e-6) -> Column:
    """Consecutive repeats and the closing point dropped, then closed again; null under three distinct points."""
    near = lambda a, b: (F.abs(a["x"] - b["x"]) <= eps) & (F.abs(a["y"] - b["y"]) <= eps)
    single = lambda p: F.filter(p, lambda q, i: (i == 0) | ~near(q, F.element_at(p, F.greatest(i, F.lit(1)))))
    opened = lambda k: F.when((F.size(k) > 1) & near(F.element_at(k, 1), F.element_at(k, -1)), F.slice(k, F.lit(1), F.size(k) - 1)).otherwise(k)
    closed = lambda k: F.when(F.size(F.array_distinct(k)) >= 3, F.flatten(F.transform(F.concat(k, F.slice(k, 1, 1)), lambda q: F.array(q["x"], q["y"]))))
    return let(let(let(points(ring), single), opened), closed)


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6378137.0) -> Column:
    """Haversine distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))
