"""Envelope joins of mixed sizes against a comparison of all rows."""

import random

from pyspark.sql import functions as F

from plotlink.operators import gridjoin

SCHEMA = "id long, x0 double, y0 double, x1 double, y1 double"


def boxes(seed, n):
    """Sizes from a point to twenty kilometres, on half metres so that many touch."""
    rnd, out = random.Random(seed), []
    for k in range(n):
        w, h = (rnd.choice((0, 0.5, 10, 32, 128, 129, 600, 5000, 20000)) for _ in range(2))
        x, y = (rnd.randrange(-20000, 20000) / 2 for _ in range(2))
        out.append((k, x, y, x + w, y + h))
    return out


def met(a, b, grow=0.0):
    return sorted((p[0], q[0]) for p in a for q in b if p[1] - grow <= q[3] and p[3] + grow >= q[1] and p[2] - grow <= q[4] and p[4] + grow >= q[2])


def pairs(spark, a, b, **more):
    joined = gridjoin.envelope_join(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), **more)
    return sorted((r.id, r.o_id) for r in joined.select("id", "o_id").collect())


def test_mixed_sizes(spark):
    a, b = boxes(1, 150), boxes(2, 150)
    assert pairs(spark, a, b) == met(a, b)
    assert pairs(spark, a, b, grow=3.5) == met(a, b, 3.5)
    small = [r for r in a if r[3] - r[1] < 100 and r[4] - r[2] < 100]
    assert pairs(spark, small, b, grow=0.5, size=8.0) == met(small, b, 0.5)


def test_self_join_and_repeated_rows(spark):
    a = boxes(3, 60)
    rows = a + a[:5]
    got = gridjoin.self_envelope_join(spark.createDataFrame(rows, SCHEMA), "id").select("id", "o_id").collect()
    assert sorted(map(tuple, got)) == [p for p in met(rows, rows) if p[0] != p[1]]


def test_large_envelope_takes_few_cells(spark):
    """A state among houses: a bounded number of rows, where cells of one size would take millions."""
    wide = spark.createDataFrame([(1, 0.0, 0.0, 400000.0, 400000.0)], SCHEMA)
    levelled = gridjoin._levelled(wide, 32.0, 0.0)
    cells = gridjoin._with_cells(levelled, F.array(F.lit(0)), 32.0, 0.0, 1, 2)
    assert cells.count() <= (gridjoin.ACROSS + 1) ** 2
    houses = [(k, k * 1000.0, k * 900.0, k * 1000.0 + 10, k * 900.0 + 10) for k in range(500)]
    assert pairs(spark, houses, [(1, 0.0, 0.0, 400000.0, 400000.0)]) == met(houses, [(1, 0.0, 0.0, 400000.0, 400000.0)])


def test_envelopes_that_meet_nothing(spark):
    bad = [(1, None, 0.0, 1.0, 1.0), (2, 5.0, 0.0, 1.0, 1.0), (3, float("nan"), 0.0, float("nan"), 1.0), (4, float("-inf"), 0.0, float("inf"), 1.0)]
    good = [(9, 0.0, 0.0, 1.0, 1.0)]
    assert pairs(spark, bad, good) == pairs(spark, good, bad) == pairs(spark, [], good) == pairs(spark, good, []) == []
