"""Queries of matching, classification, recommendation and order, with DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotlink.functions import geometry as G
from plotlink.operators import loaded, match
from plotlink.plans import layers

_O, _M, _X = layers.oracle(layers.OFFICIAL), layers.oracle(layers.MAPPED), layers.oracle(layers.ORPHANS)
#: Brute-force classification on boxes; the discrete Hausdorff distance of two boxes that differ by a shift along x.
_CLASSIFIED = f"""
o AS ({_O}), m AS ({_M}),
s AS (SELECT id, osm_id, is_way, greatest(0, least(o.x1, m.x1) - greatest(o.x0, m.x0)) * greatest(0, least(o.y1, m.y1) - greatest(o.y0, m.y0)) AS shared,
             (o.x1 - o.x0) * (o.y1 - o.y0) AS a, (m.x1 - m.x0) * (m.y1 - m.y0) AS b, greatest(abs(o.x0 - m.x0), abs(o.x1 - m.x1), abs(o.y1 - m.y1)) AS hd,
             o.x0 AS ox0, o.x1 AS ox1, o.y0 AS oy0, o.y1 AS oy1, m.x0 AS mx0, m.x1 AS mx1, m.y0 AS my0, m.y1 AS my1
      FROM o JOIN m ON o.x0 <= m.x1 AND o.x1 >= m.x0 AND o.y0 <= m.y1 AND o.y1 >= m.y0),
p AS (SELECT *, shared / (a + b - shared) AS iou, count(*) OVER (PARTITION BY osm_id) AS sharers, count(*) OVER (PARTITION BY id) AS n FROM s WHERE shared / least(a, b) >= 0.3),
g AS (SELECT id, max(n) AS n, min(iou) AS iou, min(hd) AS hd, bool_and(is_way) AS is_way, max(sharers) AS sharers, min(osm_id) AS first_partner FROM p GROUP BY id),
c AS (SELECT o.*, coalesce(g.n, 0)::BIGINT AS n_partners, g.iou, g.hd, g.first_partner,
             CASE WHEN g.n IS NULL THEN 'NEU' WHEN g.n > 1 THEN 'KOMPLEX' WHEN NOT g.is_way THEN CASE WHEN g.iou >= 0.95 AND g.hd <= 0.5 THEN 'IDENTISCH' ELSE 'KOMPLEX' END
                  WHEN g.sharers > 1 THEN 'KOMPLEX' WHEN g.iou >= 0.95 AND g.hd <= 0.5 THEN 'IDENTISCH' WHEN g.iou >= 0.3 THEN 'ABWEICHEND' ELSE 'KOMPLEX' END AS match_class
      FROM o LEFT JOIN g USING (id))"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.classify(layers.official(spark, sf_dir), layers.mapped(spark, sf_dir))


def match_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("id", "match_class", "n_partners", F.round("iou", 6).alias("iou"))


def match_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).groupBy("match_class").agg(F.count(F.lit(1)).alias("buildings"))


def partner_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = match.partners(layers.official(spark, sf_dir), layers.mapped(spark, sf_dir))
    return p.select("id", F.col("o_osm_id").alias("osm_id"), F.round("iou", 6).alias("iou"), F.round("overlap", 6).alias("overlap"), F.round("shared", 6).alias("shared"))


def overlay_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs by the general edge overlay, which knows nothing of boxes."""
    from plotlink.operators import gridjoin, overlay
    from plotlink.operators.scratch import cut_lineage

    pairs = gridjoin.envelope_join(layers.official(spark, sf_dir), layers.mapped(spark, sf_dir)).select("id", F.col("o_osm_id").alias("osm_id"), F.array("ring").alias("a"), F.array("o_ring").alias("b"))
    return overlay.shared_area(cut_lineage(pairs), ["id", "osm_id"], "a", "b").select("id", "osm_id", F.round(F.abs("shared"), 6).alias("shared"))


def hausdorff_discrete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every building with a single partner, also where the two do not differ by a shift alone."""
    return _classified(spark, sf_dir).where("hausdorff is not null").select("id", F.round("hausdorff", 6).alias("hausdorff"))


def osm_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.map_only(layers.official(spark, sf_dir), layers.mapped(spark, sf_dir, orphans=True), (-600.0, 0.0, 1000.0, 1e6)).select("osm_id", "x0", "y0")


_SCORE, _MAP_SCORE = "(id * 37 % 100) / 100e0", "(id * 53 % 100) / 100e0"


def _recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _classified(spark, sf_dir).withColumn("score", F.when(F.col("match_class").isin("NEU", "ABWEICHEND") & (F.col("id") % 11 != 0), F.expr(_SCORE))).withColumn("map_score", F.when(F.col("match_class") == "ABWEICHEND", F.expr(_MAP_SCORE)))
    return c.withColumn("recommendation", match.recommendation(F.col("match_class"), F.col("score"), F.col("map_score")))


_REC = f"""{_CLASSIFIED},
q AS (SELECT *, CASE WHEN match_class IN ('NEU', 'ABWEICHEND') AND id % 11 <> 0 THEN {_SCORE} END AS score, CASE WHEN match_class = 'ABWEICHEND' THEN {_MAP_SCORE} END AS map_score FROM c),
r AS (SELECT *, CASE match_class WHEN 'IDENTISCH' THEN 'NICHTS_ZU_TUN' WHEN 'KOMPLEX' THEN 'MANUELL' ELSE
      CASE WHEN score IS NULL THEN 'UNGEPRUEFT' WHEN score < 0.7 THEN 'DISKREPANZ' WHEN map_score > score + 0.05e0 THEN 'DISKREPANZ' ELSE 'UEBERNAHME_EMPFOHLEN' END END AS recommendation FROM q)"""


def recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recommended(spark, sf_dir).select("id", "match_class", "score", "recommendation")


def recommend_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _recommended(spark, sf_dir)
    shown = match.effective(F.col("recommendation"), F.col("id") % 5 == 0)
    return r.select("id", shown.alias("effective"), shown.isin(*match.APPLICABLE).alias("applicable"), shown.isin(*match.DEFAULT_ACCEPT).alias("default_accept"))


def recommendation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recommended(spark, sf_dir).groupBy("match_class", "recommendation").agg(F.count(F.lit(1)).alias("n"))


def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _recommended(spark, sf_dir)
    done = F.col("id") % 4 == 0
    return r.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("recommendation").isin(*match.APPLICABLE) & ~done).alias("open_applicable"), F.count_if(done).alias("done"))


def spatial_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = layers.official(spark, sf_dir).select("id", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    return match.spatial_order(o).select("id", "position")


def neighbour_mask_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = layers.with_ring(layers.official(spark, sf_dir).drop("ring").withColumn("x1", F.col("x1") + 8).withColumn("x0", F.col("x0") - F.lit(0.25)))
    return match.mask_pairs(wide)


def loaded_area_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = spark.createDataFrame([(0.0, 0.0, 305.0, 2000.0), (305.0, 0.0, 610.0, 500.0), (300.0, 490.0, 620.0, 700.0)], "x0 double, y0 double, x1 double, y1 double")
    return loaded.split(layers.official(spark, sf_dir), areas).groupBy("covered").agg(F.count(F.lit(1)).alias("n"))


#: Boxes along the southern border of loaded bounds, a parallel that rises away from the zone's middle; some lie across the middle.
_BORDER = """SELECT id, x0, y0, x0 + 10 AS x1, y0 + 8 AS y1 FROM (SELECT id, x0, 5649824e0 + floor((x0 - 500000e0) * (x0 - 500000e0) * 9.67e-8) + id * 7 % 61 - 30 AS y0
  FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 40 = 0 THEN 499995e0 ELSE 435000e0 + p_partkey * 137 % 140000 END AS x0 FROM {part}) p) q"""


def loaded_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings in two loaded areas that meet at nine degrees east: curved sides decide those at the border."""
    bounds = spark.createDataFrame([(51.0, 8.0, 51.5, 9.0), (51.0, 9.0, 51.5, 10.5), (52.0, 8.0, 52.0, 9.0)], "min_lat double, min_lon double, max_lat double, max_lon double")
    near = layers.layer(spark, sf_dir, _BORDER, "part").withColumn("ring", G.rectangle(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))
    return loaded.split(near, loaded.projected(bounds, 32)).select("id", "covered")


def point_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.selected_at(layers.official(spark, sf_dir), 22.5, 21.5).select("id", "function")


QUERIES = {f.__name__: f for f in (match_classify, match_class_counts, partner_pairs, overlay_area, hausdorff_discrete, osm_only, recommend, recommend_effective, recommendation_counts, session_summary, spatial_order, neighbour_mask_pairs, loaded_area_split, loaded_bounds, point_selection)}

ORACLES = {
    "match_classify": f"WITH {_CLASSIFIED} SELECT id, match_class, n_partners, CASE WHEN n_partners = 1 THEN round(iou, 6) END AS iou FROM c",
    "match_class_counts": f"WITH {_CLASSIFIED} SELECT match_class, count(*) AS buildings FROM c GROUP BY 1",
    "partner_pairs": f"WITH {_CLASSIFIED} SELECT id, osm_id, round(iou, 6) AS iou, round(shared / least(a, b), 6) AS overlap, round(shared, 6) AS shared FROM p",
    "overlay_area": f"WITH {_CLASSIFIED} SELECT id, osm_id, round(shared, 6) AS shared FROM s",
    #: Samples (ten pieces an edge, both ways) x segments of the other box.
    "hausdorff_discrete": f"""WITH {_CLASSIFIED}, q AS (SELECT * FROM p WHERE n = 1),
        b AS (SELECT id, 1 AS way, ox0 AS x0, oy0 AS y0, ox1 AS x1, oy1 AS y1, mx0 AS tx0, my0 AS ty0, mx1 AS tx1, my1 AS ty1 FROM q UNION ALL SELECT id, 2, mx0, my0, mx1, my1, ox0, oy0, ox1, oy1 FROM q),
        k AS (SELECT range / 10e0 AS t FROM range(11)), u AS (SELECT t AS u, 0e0 AS v FROM k UNION SELECT t, 1e0 FROM k UNION SELECT 0e0, t FROM k UNION SELECT 1e0, t FROM k),
        sm AS (SELECT b.*, x0 + (x1 - x0) * u AS x, y0 + (y1 - y0) * v AS y FROM b, u), seg AS (SELECT * FROM (VALUES (0e0, 0e0, 1e0, 0e0), (0e0, 1e0, 1e0, 1e0), (0e0, 0e0, 0e0, 1e0), (1e0, 0e0, 1e0, 1e0)) w(ga, gb, gc, gd)),
        dist AS (SELECT id, way, x, y, min(sqrt(greatest(tx0 + (tx1 - tx0) * ga - x, 0e0, x - tx0 - (tx1 - tx0) * gc) ** 2 + greatest(ty0 + (ty1 - ty0) * gb - y, 0e0, y - ty0 - (ty1 - ty0) * gd) ** 2)) AS d FROM sm, seg GROUP BY ALL)
        SELECT id, round(max(d), 6) AS hausdorff FROM dist GROUP BY id""",
    "osm_only": f"""WITH {_CLASSIFIED}, a AS (SELECT * FROM m UNION ALL {_X})
        SELECT osm_id, x0, y0 FROM a WHERE x0 >= -600 AND y0 >= 0 AND x1 <= 1000 AND y1 <= 1000000 AND NOT EXISTS (SELECT 1 FROM o
          WHERE greatest(0, least(o.x1, a.x1) - greatest(o.x0, a.x0)) * greatest(0, least(o.y1, a.y1) - greatest(o.y0, a.y0)) / least((o.x1 - o.x0) * (o.y1 - o.y0), (a.x1 - a.x0) * (a.y1 - a.y0)) >= 0.1)""",
    "recommend": f"WITH {_REC} SELECT id, match_class, score, recommendation FROM r",
    "recommend_effective": f"""WITH {_REC}, e AS (SELECT id, CASE WHEN id % 5 = 0 AND recommendation IN ('UEBERNAHME_EMPFOHLEN', 'DISKREPANZ', 'UNGEPRUEFT') THEN 'DISKREPANZ' ELSE recommendation END AS effective FROM r)
        SELECT id, effective, effective IN ('UEBERNAHME_EMPFOHLEN', 'ANGLEICHEN', 'DISKREPANZ', 'UNGEPRUEFT') AS applicable, effective IN ('UEBERNAHME_EMPFOHLEN', 'ANGLEICHEN') AS default_accept FROM e""",
    "recommendation_counts": f"WITH {_REC} SELECT match_class, recommendation, count(*) AS n FROM r GROUP BY ALL",
    "session_summary": f"WITH {_REC} SELECT count(*) AS total, count(*) FILTER (recommendation IN ('UEBERNAHME_EMPFOHLEN', 'ANGLEICHEN', 'DISKREPANZ', 'UNGEPRUEFT') AND id % 4 <> 0) AS open_applicable, count(*) FILTER (id % 4 = 0) AS done FROM r",
    "spatial_order": f"WITH o AS ({_O}) SELECT id, row_number() OVER (ORDER BY -floor((y0 + y1) / 2 / 50e0), (x0 + x1) / 2, id) AS position FROM o",
    "neighbour_mask_pairs": f"""WITH b AS ({_O}), o AS (SELECT id, x0 - 0.25e0 AS x0, y0, x1 + 8 AS x1, y1 FROM b), s AS (SELECT a.id, c.id AS o_id, greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) AS shared,
          least((a.x1 - a.x0) * (a.y1 - a.y0), (c.x1 - c.x0) * (c.y1 - c.y0)) AS smaller
          FROM o a JOIN o c ON a.id <> c.id AND a.x0 - 0.3e0 <= c.x1 AND a.x1 + 0.3e0 >= c.x0 AND a.y0 - 0.3e0 <= c.y1 AND a.y1 + 0.3e0 >= c.y0)
        SELECT id, o_id FROM s WHERE shared / smaller <= 0.9""",
    "loaded_area_split": f"""WITH o AS ({_O}), a AS (SELECT * FROM (VALUES (0e0, 0e0, 305e0, 2000e0), (305e0, 0e0, 610e0, 500e0), (300e0, 490e0, 620e0, 700e0)) v(ax0, ay0, ax1, ay1)),
        g AS (SELECT id, sum(greatest(0, least(x1, ax1) - greatest(x0, ax0)) * greatest(0, least(y1, ay1) - greatest(y0, ay0))) - max(CASE WHEN true THEN greatest(0, least(x1, 305e0) - greatest(x0, 300e0)) * greatest(0, least(y1, 700e0) - greatest(y0, 490e0)) END)
             - max(greatest(0, least(x1, 610e0) - greatest(x0, 305e0)) * greatest(0, least(y1, 500e0) - greatest(y0, 490e0))) AS inside, max((x1 - x0) * (y1 - y0)) AS area FROM o, a GROUP BY id)
        SELECT abs(inside - area) < 1e-6 AS covered, count(*) AS n FROM g GROUP BY 1""",
    # The border's points by a power series in the distance from the zone's middle; between them it is straight. It bends up, so a box
    # is inside if both ends of its lower side are.
    "loaded_bounds": f"""WITH o AS ({layers.oracle(_BORDER)}), g AS (SELECT 6378137e0 AS a, 1 / 298.257222101e0 * (2 - 1 / 298.257222101e0) AS e2, radians(51e0) AS p),
        c AS (SELECT *, e2 / (1 - e2) AS ep2, a / sqrt(1 - e2 * sin(p) ** 2) AS n, tan(p) ** 2 AS t, e2 / (1 - e2) * cos(p) ** 2 AS c,
          a * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256) * p - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024) * sin(2 * p) + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024) * sin(4 * p) - 35 * e2 ** 3 / 3072 * sin(6 * p)) AS m FROM g),
        k AS (SELECT c.*, radians(CASE WHEN range < 16 THEN range / 16e0 - 1 ELSE (range - 16) * 1.5e0 / 16 END) * cos(p) AS w FROM c, range(33)),
        v AS (SELECT 500000 + 0.9996e0 * n * (w + (1 - t + c) * w ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * w ** 5 / 120) AS x,
          0.9996e0 * (m + n * tan(p) * (w ** 2 / 2 + (5 - t + 9 * c + 4 * c * c) * w ** 4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * w ** 6 / 720)) AS y FROM k),
        s AS (SELECT x AS ax, y AS ay, lead(x) OVER (ORDER BY x) AS bx, lead(y) OVER (ORDER BY x) AS byy FROM v),
        e AS (SELECT id, y0, x0 AS x FROM o UNION ALL SELECT id, y0, x1 FROM o)
        SELECT id, bool_and(y0 >= ay + (x - ax) * (byy - ay) / (bx - ax)) AS covered FROM e JOIN s ON ax <= x AND x < bx GROUP BY id""",
    "point_selection": f"WITH o AS ({_O}) SELECT id, function FROM o WHERE x0 <= 22.5 AND x1 >= 22.5 AND y0 <= 21.5 AND y1 >= 21.5",
}
