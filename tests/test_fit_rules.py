"""Counterexamples: what is compared with what was kept, and distances of slanted outlines."""

import math

from plotlink.operators import edits, fit, match
from plotlink.functions import geometry as G
from pyspark.sql import functions as F

V = "id long, place double, x double, y double, node long, glue_way long, glue_segment int, glue_t double"


def ring(spark, rows):
    return spark.createDataFrame([(1, float(k), x / 1000, y / 1000, node, None, None, None) for k, (x, y, node) in enumerate(rows)], V)


def test_repeats_are_told_from_what_was_kept(spark):
    far = [(10_000, 0, None), (10_000, 10_000, None)]
    places = lambda rows: [r.place for r in fit.without_repeats(ring(spark, rows)).orderBy("place").collect()]
    assert places([(0, 0, None), (8, 0, None), (16, 0, None), *far]) == [0, 2, 3, 4]
    assert places([(0, 0, None), (8, 0, None), (-8, 0, None), *far]) == [0, 3, 4]
    assert places([*far, (0, 0, None), (9_996, 0, None)]) == [0, 1, 2]  # the end meets the first again
    assert places([(0, 0, 5), (300, 0, 5), *far, (500, 0, 5)]) == [0, 2, 3]
    assert places([(0, 0, None)]) == [0] and places([(0, 0, None), (3, 0, None)]) == [0]


def test_free_positions_are_told_from_what_was_kept(spark):
    rows = [(0, 0, None), (8, 0, None), (16, 0, None), (5000, 0, None), (5000, 0, 7), (5004, 0, None), (9000, 0, 3)]
    got = sorted(round(r.x * 1000) for r in edits.free_positions(ring(spark, rows)).collect())
    assert got == [0, 16, 5000]


def test_masks_need_the_distance_of_outlines(spark):
    def square(cx, cy, half, turn):
        pts = [(cx + half * math.sqrt(2) * math.cos(turn + k * math.pi / 2), cy + half * math.sqrt(2) * math.sin(turn + k * math.pi / 2)) for k in (0, 1, 2, 3, 0)]
        return [v for p in pts for v in p]

    rows = [(1, square(0, 0, 5, 0)), (2, square(11, 11, 5, 0)), (3, square(40, 0, 5, 0.3)), (4, square(50.1, 0, 5, math.pi / 4)), (5, square(100, 0, 5, math.pi / 4)), (6, square(110.2, 0, 5, math.pi / 4)), (7, square(100, 0, 2, 0))]
    df = spark.createDataFrame(rows, "id long, ring array<double>").withColumn("b", G.envelope(F.col("ring"))).select("*", "b.*").drop("b")
    pairs = {(r.id, r.o_id) for r in match.mask_pairs(df).collect()}
    assert (1, 2) not in pairs and {(5, 6), (6, 5)} <= pairs and (5, 7) not in pairs and (7, 6) not in pairs
    masks = {r.id: len(r["mask"]) for r in match.neighbour_mask(df).collect()}
    assert masks[5] == 1 and 1 not in masks
