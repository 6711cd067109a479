"""Queries on tables whose keys go beyond those of the small ones."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plotlink.operators import edits, graph, raster
from plotlink.plans import catalogue


@pytest.fixture
def agrees(spark, tmp_path):
    """Whether a query gives what its SQL gives on the named tables, each the SELECT of its rows."""

    def run(name, **selects):
        con = duckdb.connect()
        for table, sql in selects.items():
            con.sql(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        df = catalogue.QUERIES[name](spark, str(tmp_path))
        want = con.sql(catalogue.ORACLES[name])
        rows = sorted(map(repr, (tuple(r) for r in df.select(*want.columns).collect())))
        return rows == sorted(map(repr, want.fetchall()))

    return run


def parts(low, high, step=1):
    return f"SELECT k::BIGINT AS p_partkey, 'part ' || k AS p_name, 'b' || k % 5 AS p_brand, CASE WHEN k % 4 = 0 THEN 'COPPER' ELSE 'TIN' END AS p_type, (k % 50 + 1)::INT AS p_size, 1e0 AS p_retailprice FROM range({low}, {high}, {step}) t(k)"


def test_session_counts_far_north(agrees):
    assert agrees("session_counts", part=parts(23_900, 24_100))


def most_rows(df):
    """The most rows that an operator of the last step gave out."""
    df.collect()

    def walk(plan):
        for inner in ("executedPlan", "plan"):
            if type(plan).__name__ == "JavaObject" and plan.nodeName() in ("AdaptiveSparkPlan", "ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage") and hasattr(plan.getClass(), "getMethod"):
                try:
                    yield from walk(getattr(plan, inner)())
                    return
                except Exception:  # the other kind of plan
                    continue
        rows = plan.metrics().get("numOutputRows")
        yield rows.get().value() if rows.isDefined() else 0
        children = plan.children()
        for k in range(children.size()):
            yield from walk(children.apply(k))

    return max(walk(df._jdf.queryExecution().executedPlan()))


def test_many_ways_at_a_node(spark):
    """A node that thousands of buildings and lines share has no direction, and its pairs are not made."""
    ways = spark.range(3000).selectExpr("id AS way_id", "explode(array(0L, id + 10)) AS node_id").selectExpr("way_id", "CASE WHEN node_id = 0 THEN 0 ELSE 1 END AS pos", "node_id")
    ways = ways.unionByName(spark.createDataFrame([(9001, 0, 11), (9001, 1, 7)], "way_id long, pos int, node_id long"))
    d = graph.line_directions(ways, ways.where("way_id < 1500").select("way_id"))
    assert [tuple(r) for r in d.collect()] == [(1, 11, 7)]
    assert most_rows(d) < 20_000
    kept = graph.keep_nodes(ways, ways.where("way_id < 1500").select("way_id"), ways.limit(0).select("node_id"), d)
    assert {r["mode"]: r["count"] for r in kept.groupBy("mode").count().collect()} == {"fixed": 1500, "sliding": 1}
    assert most_rows(kept) < 20_000


@pytest.mark.parametrize("name", ["corner_owner", "free_positions", "same_corners", "keep_relaxed", "touching_pairs", "alignment_edges", "alignment_condensed", "alignment_members", "group_corner_moves"])
def test_sides_are_dealt_out(spark, tmp_path, name):
    """No side of a join whose size Spark can't tell from the files is sent whole to every task."""
    duckdb.sql(f"COPY ({parts(0, 60)}) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    plan = catalogue.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_uncrossed_streams(spark):
    """Groups of all sizes, cut by batches, get what swapping one group by itself gives, without a call of Python a group."""
    rng = np.random.default_rng(1)
    rows = [(g, c, *map(float, rng.integers(0, 30, 2)), g * 100 + c, *map(float, rng.integers(0, 30, 2)), 0.0) for g in range(120) for c in range(1 + g % 12)]
    assigned = spark.createDataFrame(rows, "way_id long, corner long, x double, y double, node_id long, nx double, ny double, d double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = edits.uncrossed(assigned)
        got = {(r.way_id, r.corner): (r.node_id, r.nx, r.ny, r.d) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for g in range(120):
        mine = [r for r in rows if r[0] == g]
        n, far = len(mine), lambda a, b: float(np.hypot(a[2] - b[5], a[3] - b[6]))
        order = list(range(n))
        while True:
            best = max(((far(mine[i], mine[order[i]]) + far(mine[j], mine[order[j]]) - far(mine[i], mine[order[j]]) - far(mine[j], mine[order[i]]), -i, -j) for i in range(n) for j in range(i + 1, n)), default=(0.0,))
            if best[0] <= 1e-9:
                break
            i, j = -best[1], -best[2]
            order[i], order[j] = order[j], order[i]
        want |= {(g, mine[i][1]): (*mine[order[i]][4:7], far(mine[i], mine[order[i]])) for i in range(n)}
    assert got == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan


def test_pictures_are_looked_up_together(spark):
    """Pictures of several sizes, some without samples, edges or whole pixels: as support says for one place after another."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(40):
        w, h = int(rng.integers(3, 20)), int(rng.integers(3, 20))
        gray = rng.integers(0, 256, w * h).astype(float).tolist() if k % 9 else [30.0] * (w * h)
        x, y = map(float, rng.integers(0, 4, 2))
        ring = [x, y, x + 4, y, x + 4, y + 3, x, y + 3, x, y] if k % 7 else None
        rows.append((k, gray if k != 11 else None, w, h, 0.0, h * 0.5, 0.5, ring, float(rng.integers(-2, 3)) / 4, 0.25, 0.3 if k % 7 else 0.0))
    images = raster.with_edges(spark.createDataFrame(rows, "id long, gray array<double>, w int, h int, min_x double, max_y double, res double, ring array<double>, offset_x double, offset_y double, overhang double"))
    got = raster.score_at(images, ["id"])
    points = F.filter(raster.outline_samples(raster.G.mitred(F.col("ring"), F.col("overhang"))), lambda p: ~p["masked"])
    want = images.withColumn("points", F.explode(F.array(points))).select("id", raster.support(F.col("points"), F.col("offset_x"), F.col("offset_y"), F.lit(1), raster.DEFAULTS).alias("score"))
    scores = {r.id: r.score for r in got.collect()}
    assert scores == {r.id: r.score for r in want.collect()}
    assert any(v for v in scores.values()) and any(v is None for v in scores.values())
    assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()
