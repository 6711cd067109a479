"""Footprint matching, classification and recommendation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotlink.functions import geometry as G
from plotlink.operators import gridjoin, overlay
from plotlink.operators.scratch import cut_lineage
from plotlink.params import DEFAULTS, Params

NEW, SAME, DEVIATING, COMPLEX, MAP_ONLY = "NEU", "IDENTISCH", "ABWEICHEND", "KOMPLEX", "NUR_OSM"
#: Recommendations; the first four can be applied, the first two are accepted by default (fixed values).
RECOMMENDATIONS = ("UEBERNAHME_EMPFOHLEN", "ANGLEICHEN", "DISKREPANZ", "UNGEPRUEFT", "NICHTS_ZU_TUN", "MANUELL", "HINWEIS")
APPLICABLE = ("UEBERNAHME_EMPFOHLEN", "ANGLEICHEN", "DISKREPANZ", "UNGEPRUEFT")
DEFAULT_ACCEPT = ("UEBERNAHME_EMPFOHLEN", "ANGLEICHEN")


def _shape(df: DataFrame, prefix: str = "") -> str:
    """Footprints are polygons (array<struct<outer, holes>>) where a table has that column, else a single ring."""
    return prefix + ("polygons" if prefix + "polygons" in df.columns else "ring")


def _area(df: DataFrame, prefix: str = "") -> Column:
    name = _shape(df, prefix)
    return G.shape_area(F.col(name), df.schema[name].dataType.simpleString())


def with_shared_area(pairs: DataFrame, ids: list[str]) -> DataFrame:
    """Adds shared, 0 for pairs that share nothing. pairs is stored once: the overlay reads it for short and for long outlines, and
    its areas are joined to it again."""
    pairs = cut_lineage(pairs)
    areas = overlay.shared_area(pairs.select(*ids, F.col(_shape(pairs)).alias("shape_a"), F.col(_shape(pairs, "o_")).alias("shape_b")), ids, "shape_a", "shape_b")
    return pairs.join(areas, ids, "left").withColumn("shared", F.coalesce("shared", F.lit(0.0)))


def partners(official: DataFrame, mapped: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Pairs of official and mapped buildings that share at least partner_overlap of the smaller footprint.

    official: id, ring or polygons, x0..y1; mapped: osm_id, is_way, ring or polygons, x0..y1. Adds area, o_area, shared, iou, overlap.
    """
    sized = lambda df: df.withColumn("area", _area(df))  # noqa: E731  once a building, not once a pair
    pairs = with_shared_area(gridjoin.envelope_join(sized(official), sized(mapped), size=params.cell), ["id", "o_osm_id"])
    union, smaller = F.col("area") + F.col("o_area") - F.col("shared"), F.least("area", "o_area")
    pairs = pairs.withColumn("iou", F.when(union > 0, F.col("shared") / union).otherwise(0.0)).withColumn("overlap", F.when(smaller > 0, F.col("shared") / smaller).otherwise(0.0))
    return pairs.where(F.col("overlap") >= params.partner_overlap)


def classify(official: DataFrame, mapped: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """id, match_class, partners (ids in order), n_partners, partner_is_way, iou, hausdorff for every official building.

    iou and hausdorff are null unless there is exactly one partner.
    """
    pairs = partners(official, mapped, params).withColumn("sharers", F.count(F.lit(1)).over(Window.partitionBy("o_osm_id")))
    grouped = pairs.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_partners"), F.sort_array(F.collect_list("o_osm_id")).alias("partners"), F.first("iou").alias("iou"), F.first("o_is_way").alias("partner_is_way"), F.max("sharers").alias("sharers"),
        F.first(_shape(pairs)).alias("shape"), F.first(_shape(pairs, "o_")).alias("o_shape"),
    )
    grouped = cut_lineage(grouped)
    single = grouped.where("n_partners = 1")
    near = overlay.discrete_hausdorff(single, ["id"], "shape", "o_shape")
    out = official.select("id").join(grouped.drop("shape", "o_shape"), "id", "left").join(near, "id", "left")
    n = F.coalesce("n_partners", F.lit(0))
    same = (F.col("iou") >= params.identical_iou) & (F.col("hausdorff") <= params.identical_hausdorff)
    label = (
        F.when(n == 0, NEW).when(n > 1, COMPLEX).when(~F.col("partner_is_way"), F.when(same, SAME).otherwise(COMPLEX)).when(F.col("sharers") > 1, COMPLEX)
        .when(same, SAME).when(F.col("iou") >= params.deviating_iou, DEVIATING).otherwise(COMPLEX)
    )
    one = lambda c: F.when(n == 1, F.col(c))
    return out.select("id", label.alias("match_class"), F.coalesce("partners", F.array().cast("array<long>")).alias("partners"), n.cast("long").alias("n_partners"), one("partner_is_way").alias("partner_is_way"), one("iou").alias("iou"), one("hausdorff").alias("hausdorff"))


def map_only(official: DataFrame, mapped: DataFrame, area: tuple[float, float, float, float] | None = None, params: Params = DEFAULTS) -> DataFrame:
    """Mapped buildings inside the area that no official geometry (excluded ones too) covers by map_only_overlap."""
    inside = mapped if area is None else mapped.where((F.col("x0") >= area[0]) & (F.col("y0") >= area[1]) & (F.col("x1") <= area[2]) & (F.col("y1") <= area[3]))
    pairs = with_shared_area(gridjoin.envelope_join(official, inside, size=params.cell), ["id", "o_osm_id"])
    smaller = F.least(_area(pairs), _area(pairs, "o_"))
    covered = pairs.where((smaller > 0) & (F.col("shared") / smaller >= params.map_only_overlap)).select(F.col("o_osm_id").alias("osm_id"))
    return inside.join(covered, "osm_id", "left_anti")


def recommendation(match_class: Column, score: Column, map_score: Column, params: Params = DEFAULTS) -> Column:
    """Null or NaN scores count as not checked."""
    unchecked = score.isNull() | F.isnan(score)
    behind = F.coalesce(F.nanvl(map_score, F.lit(None)) > score + params.score_lead, F.lit(False))
    return (
        F.when(match_class == SAME, "NICHTS_ZU_TUN").when(match_class == COMPLEX, "MANUELL").when(match_class == MAP_ONLY, "HINWEIS").when(unchecked, "UNGEPRUEFT")
        .when(score < params.min_score, "DISKREPANZ").when(behind, "DISKREPANZ").otherwise("UEBERNAHME_EMPFOHLEN")
    )


def effective(recommended: Column, conflict: Column) -> Column:
    """An applicable recommendation with a fit conflict reads as a discrepancy."""
    return F.when(recommended.isin(*APPLICABLE) & F.coalesce(conflict, F.lit(False)), "DISKREPANZ").otherwise(recommended)


def spatial_order(df: DataFrame, x: str = "cx", y: str = "cy", params: Params = DEFAULTS, *, key: str = "id") -> DataFrame:
    """Adds position: strips from north to south, inside a strip from west to east.

    Strips are numbered first and counted, so rows are only ranked within their strip.
    """
    s = df.withColumn("strip_no", -F.floor(F.col(y) / params.strip).cast("long"))
    counts = s.groupBy("strip_no").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("strip_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("strip_no").orderBy(x, key))
    return s.join(before, "strip_no").withColumn("position", (F.col("before") + rank).cast("long")).drop("before", "strip_no")


def mask_pairs(official: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """id, o_id: other footprints whose outline is within mask_distance and whose area is not (almost) inside this one: edges near
    them may belong to the neighbour and are not counted."""
    near = gridjoin.self_envelope_join(official, "id", grow=params.mask_distance, size=params.cell)
    near = with_shared_area(near, ["id", "o_id"])
    smaller = F.least(_area(near), _area(near, "o_"))
    apart = near.where((smaller > 0) & (F.col("shared") / smaller <= 0.9))
    rings = [F.array(F.col(_shape(near, p))) if _shape(near, p) == p + "ring" else F.transform(p + "polygons", lambda x: x["outer"]) for p in ("", "o_")]
    within = F.exists(rings[0], lambda a: F.exists(rings[1], lambda b: G.ring_distance(a, b) <= params.mask_distance))
    return apart.where((F.col("shared") > 0) | within).select("id", "o_id")


def selected_at(official: DataFrame, x: float, y: float) -> DataFrame:
    """Buildings that contain a clicked point; envelopes first."""
    return official.where((F.col("x0") <= x) & (F.col("x1") >= x) & (F.col("y0") <= y) & (F.col("y1") >= y)).where(G.contains_point(F.col("ring"), F.lit(x), F.lit(y)))


def sound(official: DataFrame) -> DataFrame:
    """Rows whose footprint has an area; null, empty and collapsed ones go."""
    return official.where(F.coalesce(_area(official) > 0, F.lit(False)))


def smallest_hit(buildings: DataFrame, points: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """point_id, id: of the buildings that hold a point the one with the least envelope (then the least id)."""
    p = points.select("point_id", "x", "y", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    near = gridjoin.envelope_join(p, buildings, size=params.cell)
    name = _shape(near, "o_")
    hit = near.where(G.inside_edges(G.shape_edges(F.col(name), near.schema[name].dataType.simpleString()), F.col("x"), F.col("y")))
    size = (F.col("o_x1") - F.col("o_x0")) * (F.col("o_y1") - F.col("o_y0"))
    return hit.groupBy("point_id").agg(F.min(F.struct(size.alias("size"), F.col("o_id").alias("id"))).alias("m")).select("point_id", "m.id")


def neighbour_mask(official: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """id, mask (array of rings): the outlines, grown by mask_distance, of the neighbours of mask_pairs. Their union is
    what lies in any of them, which is how raster.outline_samples reads a mask."""
    grown = official.select(F.col("id").alias("o_id"), G.mitred(F.col("ring"), F.lit(params.mask_distance)).alias("grown"))
    return mask_pairs(official, params).join(grown, "o_id").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_id", "grown"))), lambda g: g["grown"]).alias("mask"))


def replaceable(match_class: Column, polygons: Column, is_way: Column, closed: Column) -> Column:
    """Whether a partner's outline can be replaced by the official one."""
    return F.coalesce(match_class.isin(DEVIATING, SAME) & G.is_simple(polygons) & is_way & closed, F.lit(False))


def is_replacement(match_class: Column, align_required: Column) -> Column:
    return (match_class == DEVIATING) | ((match_class == SAME) & F.coalesce(align_required, F.lit(False)))


def awaits_alignment(status: Column, can_replace: Column, recommended: Column, on_outline: Column) -> Column:
    """Open or skipped entries that can be replaced, are recommended for it and do not lie on their outline yet."""
    return F.coalesce(status.isin("open", "skipped") & can_replace & recommended.isin(*APPLICABLE) & ~on_outline, F.lit(False))


def review_filters(status: Column, match_class: Column, recommended: Column) -> dict[str, Column]:
    """The named filters of the review list."""
    is_open = status == "open"
    return {
        "open": is_open & (recommended != "NICHTS_ZU_TUN"), "recommended": is_open & (recommended == "UEBERNAHME_EMPFOHLEN"), "discrepancy": is_open & recommended.isin("DISKREPANZ", "UNGEPRUEFT"),
        "new": match_class == NEW, "deviating": match_class == DEVIATING, "complex": match_class == COMPLEX, "map_only": match_class == MAP_ONLY, "done": ~is_open, "all": F.lit(True),
    }


def all_candidates(classified: DataFrame, only_mapped: DataFrame) -> DataFrame:
    """Official candidates followed by map-only ones, which have no official columns."""
    extra = only_mapped.select(F.concat(F.lit("map-"), F.col("osm_id").cast("string")).alias("id"), F.lit(MAP_ONLY).alias("match_class"), F.array("osm_id").alias("partners"), F.lit(1).cast("long").alias("n_partners"))
    return classified.withColumn("id", F.col("id").cast("string")).unionByName(extra, allowMissingColumns=True)
