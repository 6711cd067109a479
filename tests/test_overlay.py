"""Shared areas of long outlines."""

import math

from plotlink.operators import overlay

PAIR = "id long, a array<double>, b array<double>"


def wheel(n, cx, cy, radius, wave=0.0):
    """A ring of n corners about a circle, its radius waving."""
    out = []
    for k in range(n + 1):
        t = 2 * math.pi * (k % n) / n
        r = radius + wave * math.sin(40 * t)
        out += [cx + r * math.cos(t), cy + r * math.sin(t)]
    return out


def lens(r, d):
    """Area common to two circles of radius r whose centres are d apart."""
    return 2 * r * r * math.acos(d / (2 * r)) - d / 2 * math.sqrt(4 * r * r - d * d)


def shared(spark, rows):
    rows = [(k, [float(v) for v in a], [float(v) for v in b]) for k, a, b in rows]
    return {r.id: r.shared for r in overlay.shared_area(spark.createDataFrame(rows, PAIR), ["id"], "a", "b").collect()}


def test_slabs_give_what_all_pairs_of_edges_give(spark, monkeypatch):
    base = 500000.0
    comb = [base, base] + [v for k in range(60) for v in (base + 1 + (k % 2) * 300, base + k)] + [base, base + 60, base, base]
    rows = [(1, wheel(100, base, base, 50, 3), wheel(90, base + 20, base + 5, 40, 2)), (2, comb, wheel(120, base + 100, base + 30, 60, 1)), (3, wheel(80, 0, 0, 5), wheel(80, 100, 0, 5)), (4, wheel(100, 0, 0, 50), [-10.0, -10, 10, -10, 10, 10, -10, 10, -10, -10])]
    monkeypatch.setattr(overlay, "LONG", 10**12)
    want = shared(spark, rows)
    monkeypatch.setattr(overlay, "LONG", 0)
    got = shared(spark, rows)
    for k in (1, 2, 3, 4):
        assert abs(got.get(k, 0.0) - want.get(k, 0.0)) < 1e-6
    assert abs(want[4] - 400) < 1e-6


def test_fifty_thousand_corners(spark):
    rows = [(1, wheel(50000, 1000.0, 1000.0, 100.0), wheel(50000, 1060.0, 1000.0, 100.0)), (2, [0.0, 0, 4, 0, 4, 4, 0, 4, 0, 0], [2.0, 2, 6, 2, 6, 6, 2, 6, 2, 2])]
    got = shared(spark, rows)
    assert abs(got[1] - lens(100.0, 60.0)) < 0.01 and got[2] == 4.0
