"""Coverage by loaded areas."""

from plotlink.operators import loaded

BOX = "x0 double, y0 double, x1 double, y1 double"


def box(x0, y0, x1, y1):
    return [float(v) for v in (x0, y0, x1, y0, x1, y1, x0, y1, x0, y0)]


def test_cover(spark):
    # A notched area, one that closes half of the notch, a repeated one, and one far away.
    notched = [0.0, 0, 100, 0, 100, 100, 60, 100, 60, 50, 40, 50, 40, 100, 0, 100, 0, 0]
    rings = [[float(v) for v in notched], box(40, 50, 60, 75), box(40, 50, 60, 75), box(500, 500, 600, 600)]
    areas = loaded.boxed(spark.createDataFrame([(r,) for r in rings], "ring array<double>"))
    cases = {
        1: (box(10, 10, 20, 20), True), 2: (box(35, 45, 65, 70), True), 3: (box(35, 45, 65, 80), False), 4: (box(45, 80, 55, 90), False), 5: (box(90, 90, 100, 100), True), 6: (box(95, 10, 105, 20), False),
        7: (box(300, 300, 310, 310), False), 8: (box(-10, -10, 110, 110), False), 9: (None, False), 10: ([], False),
    }
    rows = [(k, ring, *([min(ring[::2]), min(ring[1::2]), max(ring[::2]), max(ring[1::2])] if ring else [50.0, 10.0, 51.0, 11.0])) for k, (ring, _) in cases.items()]
    official = spark.createDataFrame(rows, f"id long, ring array<double>, {BOX}")
    assert {r.id: r.covered for r in loaded.split(official, areas).collect()} == {k: want for k, (_, want) in cases.items()}
    assert not any(r.covered for r in loaded.split(official, areas.limit(0)).collect())


def test_projected_bounds(spark):
    bounds = spark.createDataFrame([(51.0, 8.0, 52.0, 10.0), (51.0, 8.0, 51.0, 10.0), (None, 8.0, 52.0, 10.0)], "min_lat double, min_lon double, max_lat double, max_lon double")
    (r,) = loaded.projected(bounds, 32).collect()
    assert len(r.ring) == 2 * (4 * 16 + 1) and r.ring[:2] == r.ring[-2:]
    # Half way along the southern side the parallel lies on the zone's middle, far below the straight line between the corners.
    middle = r.ring[2 * 8 : 2 * 8 + 2]
    assert abs(middle[0] - 500000) < 1e-3 and r.ring[1] - middle[1] > 400 and r.y0 == middle[1]
