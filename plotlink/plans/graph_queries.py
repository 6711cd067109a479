"""Queries of images, evaluation, topology and dependencies, with DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotlink.functions import geometry as G
from plotlink.operators import evaluate, graph, raster
from plotlink.plans import layers




def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    gray = F.transform("embedding", lambda v: F.floor((v.cast("double") + 0.5) * 255).cast("double"))
    return raster.with_edges(e.select("vec_id", gray.alias("gray"), F.lit(8).alias("w"), F.lit(8).alias("h"), F.lit(0.0).alias("min_x"), F.lit(8.0).alias("max_y"), F.lit(1.0).alias("res")))


def edge_sobel(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _images(spark, sf_dir).select("vec_id", F.posexplode(F.arrays_zip("gx", "gy", "mag")).alias("i", "p"))
    return p.select("vec_id", F.col("i").cast("long").alias("i"), F.col("p.gx").alias("gx"), F.col("p.gy").alias("gy"), F.round("p.mag", 6).alias("mag"))


def edge_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir).select("vec_id", F.round("threshold", 6).alias("threshold"))


_RING = (2.0, 2.0, 6.0, 6.0)


def edge_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support of one box with samples a metre apart, not moved, with a reach of one pixel."""
    from dataclasses import replace

    from plotlink.params import DEFAULTS

    params = replace(DEFAULTS, sample_step=1.0)
    ring = G.rectangle(*[F.lit(v) for v in _RING])
    s = raster.support(raster.outline_samples(ring, params), F.lit(0.0), F.lit(0.0), F.lit(1), params)
    return _images(spark, sf_dir).select("vec_id", F.round(s, 6).alias("support"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = layers.layer(spark, sf_dir, layers.LOG, "events")
    return log.withColumn("recommendation", F.when(F.col("score") >= 0.7, "UEBERNAHME_EMPFOHLEN").otherwise("DISKREPANZ")).withColumn("positive", F.col("variant") == 0).withColumn("accepted", F.col("decision") == "applied")


THRESHOLDS = [k / 100 for k in range(40, 100, 5)]
DECISIONS = ["applied", "rejected", "skipped", "open"]


def tpr_fpr_by_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluate.rates(_log(spark, sf_dir), THRESHOLDS)
    return r.select("threshold", "area", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"), "n")


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_log(spark, sf_dir), DECISIONS)


def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.calibration(_log(spark, sf_dir)).select("bin", "n", F.round("accepted_share", 9).alias("accepted_share"))


def decision_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.decision_times(_log(spark, sf_dir)).select("recommendation", "n", F.round("mean_ms", 6).alias("mean_ms"), "median_ms")


def decision_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.states(_log(spark, sf_dir))


def review_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entries each named filter of the review list shows."""
    s = evaluate.states(_log(spark, sf_dir))
    done = F.col("status").isin("applied", "rejected")
    named = {"all": F.lit(True), "open": ~done, "done": done, "skipped": F.col("status") == "skipped"}
    return s.select(F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in named.items()]), lambda x: x.isNotNull())).alias("filter")).groupBy("filter").agg(F.count(F.lit(1)).alias("n"))


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.layer(spark, sf_dir, layers.WAY_NODES, "lineitem")


#: Ways that mostly have their nodes to themselves, so that lines end at buildings.
_SPARSE = "SELECT l_orderkey AS way_id, l_linenumber AS pos, (l_orderkey * 4 + l_linenumber * 7919) % 30011 AS node_id FROM {lineitem}"


def _sparse_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.layer(spark, sf_dir, _SPARSE, "lineitem")


def shared_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shared_nodes(_ways(spark, sf_dir))


def line_end_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _sparse_ways(spark, sf_dir)
    return graph.line_directions(w, w.where("way_id % 3 = 0").select("way_id"), w.where("node_id % 10 = 0").select("node_id"))


def keep_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _sparse_ways(spark, sf_dir)
    b = w.where("way_id % 3 = 0").select("way_id")
    return graph.keep_nodes(w, b, w.where("node_id % 7 = 0").select("node_id"), graph.line_directions(w, b, w.where("node_id % 10 = 0").select("node_id")))


def way_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways with coordinates joined in order; those with an unknown node fall out."""
    w = _ways(spark, sf_dir).groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("pos", "node_id"))).alias("p")).select("way_id", F.transform("p", lambda p: p["node_id"]).alias("nodes"))
    nodes = layers.layer(spark, sf_dir, "SELECT p_partkey AS node_id, (p_partkey % 48) * 1e0 AS x, p_size * 1e0 AS y FROM {part} WHERE p_partkey % 50 <> 0", "part")
    r = graph.materialised(w, nodes)
    return r.select("way_id", F.size("nodes").cast("long").alias("n_nodes"), F.aggregate("ring", F.lit(0.0), lambda s, v: s + v).alias("total"))


_CANDS = "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'NEU' WHEN 1 THEN 'NEU' WHEN 2 THEN 'ABWEICHEND' ELSE 'IDENTISCH' END AS match_class, CASE WHEN p_partkey % 4 >= 2 THEN p_partkey * 2 END AS partner, (p_size % 11) / 100e0 AS hausdorff FROM {part}"
_TOUCHED = "SELECT l_partkey AS id, l_suppkey * 20 + l_linenumber * 2 AS handle FROM {lineitem}"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.prerequisites(layers.layer(spark, sf_dir, _CANDS, "part"), layers.layer(spark, sf_dir, _TOUCHED, "lineitem"))


def prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


def dependency_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = layers.layer(spark, sf_dir, "SELECT p_partkey AS id, p_partkey * 7919 % 1000003 AS position FROM {part}", "part")
    return graph.dependency_order(positions, _edges(spark, sf_dir).withColumn("n", F.col("prerequisite")))



def alignment_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed reachability from every supplier over all 'must move along' edges."""
    e = layers.layer(spark, sf_dir, "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM {lineitem}", "lineitem")
    return graph.reachable(e, layers.layer(spark, sf_dir, "SELECT s_suppkey AS start FROM {supplier}", "supplier"))


def preview_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = layers.layer(spark, sf_dir, "SELECT p_partkey AS node_id, (p_partkey % 48) * 1e0 AS x, p_size * 1e0 AS y FROM {part} WHERE p_partkey % 7 <> 0", "part")
    after = layers.layer(spark, sf_dir, "SELECT p_partkey AS node_id, (p_partkey % 48) * 1e0 + CASE WHEN p_partkey % 5 = 0 THEN 0.25e0 ELSE 0e0 END AS x, p_size * 1e0 AS y FROM {part} WHERE p_partkey % 11 <> 0", "part")
    return graph.change_preview(before, after)


def corner_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = layers.official(spark, sf_dir).select(F.col("x0").alias("x"), F.col("y0").alias("y"))
    nodes = layers.layer(spark, sf_dir, "SELECT p_partkey AS node_id, (p_partkey % 48) * 20e0 + (p_size % 4) / 8e0 AS x, floor(p_partkey / 48e0) * 20e0 AS y FROM {part}", "part")
    return graph.corner_owners(corners, nodes, 0.25).select("kx", "ky", "node_id", F.round("dist", 6).alias("dist"))


def session_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    running = layers.layer(spark, sf_dir, "SELECT c_custkey AS id, c_nationkey AS v FROM {customer} WHERE c_custkey % 3 = 0", "customer")
    new = layers.layer(spark, sf_dir, "SELECT c_custkey AS id, -1 AS v FROM {customer} WHERE c_custkey % 5 = 0", "customer")
    return graph.merged_session(running, new)


def geometry_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foot on a segment, ray hit and point in ring for points derived from parts."""
    p = layers.layer(spark, sf_dir, "SELECT p_partkey AS id, (p_partkey % 13) * 1e0 AS x, (p_size % 9) * 1e0 AS y FROM {part}", "part")
    ring = F.array(*[F.lit(float(v)) for v in (1, 1, 9, 1, 9, 7, 5, 3, 1, 7, 1, 1)])
    foot = G.segment_foot(F.col("x"), F.col("y"), F.lit(2.0), F.lit(1.0), F.lit(10.0), F.lit(5.0))
    hit = G.ray_hit(F.lit(-1.0), F.lit(-2.0), F.col("x") + 1, F.col("y") + 2, F.lit(0.0), F.lit(6.0), F.lit(12.0), F.lit(6.0))
    return p.select("id", F.round(foot["x"], 6).alias("foot_x"), F.round(foot["dist"], 6).alias("foot_dist"), F.round(foot["t"], 6).alias("foot_t"), F.round(hit["x"], 6).alias("hit_x"), F.round(hit["s"], 6).alias("hit_s"), G.contains_point(ring, F.col("x") + 0.5, F.col("y") + 0.25).alias("inside"))


def neighbour_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways that a new outline may touch: closed, of four nodes or more, a building or part of a building relation. Two of three ways
    are closed, and some are both. Where nodes share a way's first or last place, the one that the table has first is its end."""
    w = layers.placed_layer(spark, sf_dir, layers.WAY_NODES.replace(" FROM", ", at FROM"), "lineitem")
    p = w.groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("pos", "at", "node_id"))).alias("p"))
    known = p.select("way_id", F.transform("p", lambda n: n["node_id"]).alias("nodes"), F.filter("p", lambda n: n["pos"].isNotNull() & n["node_id"].isNotNull()).alias("p"))
    last = known.select("*", F.filter("p", lambda n: n["pos"] == F.try_element_at("p", F.lit(-1))["pos"]).alias("last"))
    meet = F.coalesce(F.try_element_at("p", F.lit(1))["node_id"] == F.try_element_at("last", F.lit(1))["node_id"], F.lit(False))
    made = F.col("way_id") % 3 > 0
    ways = last.select("way_id", F.when(made, F.concat("nodes", F.slice("nodes", 1, 1))).otherwise(F.col("nodes")).alias("nodes"), (made | meet).alias("closed"), (F.col("way_id") % 2 == 0).alias("is_building"))
    members = w.where("way_id % 5 = 0").select("way_id")
    return graph.neighbour_rings(ways, members).select("way_id", F.size("nodes").cast("long").alias("n_nodes"), "is_building", F.coalesce("member", F.lit(False)).alias("member"))


QUERIES = {
    f.__name__: f
    for f in (edge_sobel, edge_threshold, edge_support, tpr_fpr_by_threshold, confusion_matrix, calibration_bins, decision_time, decision_state, review_filters, shared_nodes, neighbour_rings, line_end_direction, keep_nodes, way_rings, prerequisites, dependency_order, alignment_groups, preview_diff, corner_owner, session_merge, geometry_functions)
}

_SOBEL = f"""
p AS (SELECT vec_id, i - 1 AS i, (i - 1) % 8 AS x, (i - 1) // 8 AS y, floor((embedding[i]::DOUBLE + 0.5) * 255) AS g FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
a AS (SELECT *, (coalesce(lag(g) OVER r, g) + 2 * g + coalesce(lead(g) OVER r, g)) / 4 AS t FROM p WINDOW r AS (PARTITION BY vec_id, y ORDER BY x)),
s AS (SELECT *, (coalesce(lag(t) OVER c, t) + 2 * t + coalesce(lead(t) OVER c, t)) / 4 AS s FROM a WINDOW c AS (PARTITION BY vec_id, x ORDER BY y)),
v AS (SELECT *, lag(s) OVER c AS u, lead(s) OVER c AS d FROM s WINDOW c AS (PARTITION BY vec_id, x ORDER BY y)),
k AS (SELECT *, lag(s) OVER r AS sl, lead(s) OVER r AS sr, lag(u) OVER r AS ul, lead(u) OVER r AS ur, lag(d) OVER r AS dl, lead(d) OVER r AS dr FROM v WINDOW r AS (PARTITION BY vec_id, y ORDER BY x)),
e AS (SELECT vec_id, i, x, y, coalesce((ur + 2 * sr + dr) - (ul + 2 * sl + dl), 0) AS gx, coalesce((dl + 2 * d + dr) - (ul + 2 * u + ur), 0) AS gy, x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 AS inner_ FROM k),
m AS (SELECT vec_id, i, x, y, CASE WHEN inner_ THEN gx ELSE 0 END AS gx, CASE WHEN inner_ THEN gy ELSE 0 END AS gy, CASE WHEN inner_ THEN sqrt(gx * gx + gy * gy) ELSE 0 END AS mag FROM e),
th AS (SELECT vec_id, greatest(40, list_sort(list(mag))[52]) AS threshold FROM m GROUP BY vec_id)"""
_LOGGED = f"l AS (SELECT *, CASE WHEN score >= 0.7 THEN 'UEBERNAHME_EMPFOHLEN' ELSE 'DISKREPANZ' END AS recommendation, variant = 0 AS positive, decision = 'applied' AS accepted FROM ({layers.oracle(layers.LOG)}))"
_W = f"w AS ({layers.oracle(layers.WAY_NODES)})"
_DIR = f"""w AS ({_SPARSE.format(lineitem="lineitem")}),
o AS (SELECT *, lag(node_id) OVER q AS pr, lead(node_id) OVER q AS nx, first_value(node_id) OVER a AS hd, last_value(node_id) OVER a AS tl, nth_value(node_id, 2) OVER a AS sec FROM w
      WINDOW q AS (PARTITION BY way_id ORDER BY pos), a AS (PARTITION BY way_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
o2 AS (SELECT *, max(CASE WHEN nx IS NULL THEN pr END) OVER (PARTITION BY way_id) AS lbo FROM o),
o3 AS (SELECT way_id, node_id, coalesce(pr, CASE WHEN hd = tl THEN lbo END) AS pr, coalesce(nx, CASE WHEN hd = tl THEN sec END) AS nx FROM o2),
own AS (SELECT DISTINCT way_id, node_id FROM w WHERE way_id % 3 = 0),
st AS (SELECT own.way_id, own.node_id, r.way_id % 3 = 0 AS rb, unnest([r.pr, r.nx]) AS fn FROM own JOIN o3 r ON r.node_id = own.node_id AND r.way_id <> own.way_id WHERE own.node_id % 10 <> 0),
s2 AS (SELECT st.*, CASE WHEN fn <> node_id AND NOT EXISTS (SELECT 1 FROM own z WHERE z.way_id = st.way_id AND z.node_id = st.fn) THEN fn END AS f2 FROM st),
dirs AS (SELECT way_id, node_id, min(f2) AS from_node FROM s2 GROUP BY 1, 2 HAVING NOT bool_or(rb) AND count(DISTINCT f2) = 1)"""
_PRE = f"""c AS ({_CANDS.format(part="part")}), t AS ({_TOUCHED.format(lineitem="lineitem")}),
pre AS (SELECT DISTINCT t.id AS candidate, p.id AS prerequisite, p.match_class = 'IDENTISCH' AS align FROM t JOIN c ON c.id = t.id AND c.match_class = 'NEU' JOIN c p ON p.partner = t.handle AND p.match_class IN ('ABWEICHEND', 'IDENTISCH') WHERE p.match_class = 'ABWEICHEND' OR p.hausdorff > 0.05e0)"""

ORACLES = {
    "neighbour_rings": f"""WITH n AS ({layers.oracle(layers.WAY_NODES)}), w AS (SELECT way_id, count(*) + (way_id % 3 > 0)::INT AS n_nodes, way_id % 3 > 0 OR arg_min(node_id, pos) = arg_max(node_id, pos) AS closed FROM n GROUP BY way_id)
        SELECT way_id, n_nodes::BIGINT AS n_nodes, way_id % 2 = 0 AS is_building, way_id % 5 = 0 AS member FROM w WHERE closed AND n_nodes >= 4 AND (way_id % 2 = 0 OR way_id % 5 = 0)""",
    "edge_sobel": f"WITH {_SOBEL} SELECT vec_id, i::BIGINT AS i, gx::DOUBLE AS gx, gy::DOUBLE AS gy, round(mag, 6) AS mag FROM m",
    "edge_threshold": f"WITH {_SOBEL} SELECT vec_id, round(threshold, 6) AS threshold FROM th",
    "edge_support": f"""WITH {_SOBEL},
        sm AS (SELECT unnest([2.5, 3.5, 4.5, 5.5]) AS v), pts AS (SELECT v AS px, 6.0 AS py, 0 AS nx, -1 AS ny FROM sm UNION ALL SELECT 6.0, 8 - v, -1, 0 FROM sm UNION ALL SELECT v, 2.0, 0, 1 FROM sm UNION ALL SELECT 2.0, 8 - v, 1, 0 FROM sm),
        hits AS (SELECT vec_id, px, py, bool_or(mag >= threshold AND mag > 0 AND abs(gx * nx + gy * ny) / nullif(mag, 0) >= cos(radians(30))) AS ok FROM pts, (SELECT unnest([-1, 0, 1]) AS kk) JOIN m ON m.x = floor(px + kk * nx) AND m.y = floor(py + kk * ny) JOIN th USING (vec_id) WHERE m.x BETWEEN 1 AND 6 AND m.y BETWEEN 1 AND 6 GROUP BY ALL)
        SELECT vec_id, round(count(*) FILTER (ok) / 16.0::DOUBLE, 6) AS support FROM hits GROUP BY 1""",
    "tpr_fpr_by_threshold": f"""WITH {_LOGGED}, t AS (SELECT unnest(range(40, 100, 5)) / 100.0::DOUBLE AS threshold)
        SELECT threshold, area, round(count(*) FILTER (positive AND score >= threshold) / greatest(1, count(*) FILTER (positive)), 9) AS tpr, round(count(*) FILTER (NOT positive AND score >= threshold) / greatest(1, count(*) FILTER (NOT positive)), 9) AS fpr, count(*) AS n
        FROM l, t GROUP BY GROUPING SETS ((threshold, area), (threshold))""",
    "confusion_matrix": f"WITH {_LOGGED} SELECT recommendation, " + ", ".join(f"count(*) FILTER (decision = '{d}') AS {d}" for d in DECISIONS) + " FROM l GROUP BY 1",
    "calibration_bins": f"WITH {_LOGGED} SELECT floor(score / 0.05 + 1e-9)::INTEGER AS bin, count(*) AS n, round(avg(accepted::INT), 9) AS accepted_share FROM l GROUP BY 1",
    "decision_time": f"WITH {_LOGGED} SELECT recommendation, count(*) AS n, round(avg(duration_ms), 6) AS mean_ms, quantile_cont(duration_ms, 0.5)::DOUBLE AS median_ms FROM l WHERE duration_ms >= 0 GROUP BY 1",
    "decision_state": f"WITH {_LOGGED} SELECT id, arg_max(decision, seq) AS status, count(*) AS events FROM l GROUP BY 1",
    "review_filters": f"WITH {_LOGGED}, s AS (SELECT id, arg_max(decision, seq) AS st FROM l GROUP BY 1) SELECT 'all' AS filter, count(*) AS n FROM s UNION ALL SELECT 'open', count(*) FROM s WHERE st NOT IN ('applied', 'rejected') UNION ALL SELECT 'done', count(*) FROM s WHERE st IN ('applied', 'rejected') UNION ALL SELECT 'skipped', count(*) FROM s WHERE st = 'skipped'",
    "shared_nodes": f"WITH {_W} SELECT node_id, count(DISTINCT way_id) AS n_ways FROM w GROUP BY 1 HAVING count(DISTINCT way_id) > 1",
    "line_end_direction": f"WITH {_DIR} SELECT * FROM dirs",
    "keep_nodes": f"""WITH {_DIR}, nr AS (SELECT node_id, count(DISTINCT way_id) AS n FROM w GROUP BY 1)
        SELECT own.way_id, own.node_id, CASE WHEN dirs.from_node IS NOT NULL THEN 'sliding' WHEN own.node_id % 7 = 0 AND n = 1 THEN 'on_outline' ELSE 'fixed' END AS mode
        FROM own JOIN nr USING (node_id) LEFT JOIN dirs ON dirs.way_id = own.way_id AND dirs.node_id = own.node_id WHERE n > 1 OR own.node_id % 7 = 0""",
    "way_rings": f"WITH {_W} SELECT way_id, count(*) AS n_nodes, sum((node_id % 48) * 1e0 + p_size * 1e0) AS total FROM w LEFT JOIN part ON p_partkey = node_id AND p_partkey % 50 <> 0 GROUP BY 1 HAVING count(*) = count(p_partkey)",
    "prerequisites": f"WITH {_PRE} SELECT * FROM pre",
    "dependency_order": f"""WITH {_PRE}, pos AS (SELECT p_partkey AS id, p_partkey * 7919 % 1000003 AS position FROM part),
        f AS (SELECT prerequisite AS id, min((position, prerequisite)) AS f FROM pre JOIN pos ON pos.id = candidate GROUP BY 1), k AS (SELECT pos.*, coalesce(f.f[1] < position, false) AS early, f.f[1] AS fp FROM pos LEFT JOIN f USING (id))
        SELECT id, row_number() OVER (ORDER BY CASE WHEN early THEN fp ELSE position END, CASE WHEN early THEN 0 ELSE 1 END, id) AS place FROM k""",
    "alignment_groups": """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem),
        r AS (SELECT s_suppkey AS start, s_suppkey AS node FROM supplier UNION SELECT r.start, e.dst FROM r JOIN e ON e.src = r.node) SELECT start, node FROM r""",
    "preview_diff": """WITH a AS (SELECT p_partkey AS node_id, (p_partkey % 48) * 1e0 AS x FROM part WHERE p_partkey % 7 <> 0), b AS (SELECT p_partkey AS node_id, (p_partkey % 48) * 1e0 + CASE WHEN p_partkey % 5 = 0 THEN 0.25e0 ELSE 0e0 END AS x FROM part WHERE p_partkey % 11 <> 0)
        SELECT * FROM (SELECT coalesce(a.node_id, b.node_id) AS node_id, CASE WHEN a.node_id IS NULL THEN 'created' WHEN b.node_id IS NULL THEN 'deleted' WHEN abs(a.x - b.x) > 0.001 THEN 'moved' END AS change, abs(a.x - b.x) AS dist FROM a FULL JOIN b USING (node_id)) WHERE change IS NOT NULL""",
    "corner_owner": f"""WITH o AS ({layers.oracle(layers.OFFICIAL)}), n AS (SELECT p_partkey AS node_id, (p_partkey % 48) * 20e0 + (p_size % 4) / 8e0 AS x, floor(p_partkey / 48e0) * 20e0 AS y FROM part),
        j AS (SELECT round(x0, 2) AS kx, round(y0, 2) AS ky, node_id, sqrt((x0 - x) ** 2 + (y0 - y) ** 2) AS d FROM o JOIN n ON abs(x0 - x) <= 0.25 AND abs(y0 - y) <= 0.25)
        SELECT kx, ky, arg_min(node_id, (d, node_id)) AS node_id, round(min(d), 6) AS dist FROM j WHERE d <= 0.25 GROUP BY 1, 2""",
    "session_merge": "SELECT c_custkey AS id, c_nationkey AS v, false AS fresh FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, -1, true FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 3 <> 0",
    "geometry_functions": """WITH p AS (SELECT p_partkey AS id, (p_partkey % 13) * 1e0 AS x, (p_size % 9) * 1e0 AS y FROM part), f AS (SELECT *, ((x - 2) * 8 + (y - 1) * 4) / 80e0 AS t, x + 1 AS dx, y + 2 AS dy FROM p),
        e AS (SELECT * FROM (VALUES (1e0, 1e0, 9e0, 1e0), (9e0, 1e0, 9e0, 7e0), (9e0, 7e0, 5e0, 3e0), (5e0, 3e0, 1e0, 7e0), (1e0, 7e0, 1e0, 1e0)) v(ax, ay, bx, by_)),
        c AS (SELECT id, count(*) FILTER ((ay > y + 0.25) <> (by_ > y + 0.25) AND x + 0.5 < (bx - ax) * (y + 0.25 - ay) / nullif(by_ - ay, 0) + ax) % 2 = 1 AS inside FROM p, e GROUP BY 1)
        SELECT f.id, CASE WHEN t > 1e-6 AND t < 1 - 1e-6 THEN round(2 + 8 * t, 6) END AS foot_x, CASE WHEN t > 1e-6 AND t < 1 - 1e-6 THEN round(sqrt((x - 2 - 8 * t) ** 2 + (y - 1 - 4 * t) ** 2), 6) END AS foot_dist, CASE WHEN t > 1e-6 AND t < 1 - 1e-6 THEN round(t, 6) END AS foot_t,
               CASE WHEN dy > 0 AND (-1 + 8 / dy * dx) / 12 BETWEEN -1e-9 AND 1 + 1e-9 THEN round(-1 + 8 / dy * dx, 6) END AS hit_x, CASE WHEN dy > 0 AND (-1 + 8 / dy * dx) / 12 BETWEEN -1e-9 AND 1 + 1e-9 THEN round(8 / dy, 6) END AS hit_s, c.inside FROM f JOIN c USING (id)""",
}
