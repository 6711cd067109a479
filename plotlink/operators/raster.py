"""Edge support of outlines in grey images, on array columns: each image is one row, nothing is shuffled.

An image row has w, h, min_x, max_y, res (metres a pixel) and gray, a row-major array<double>.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotlink.functions import geometry as G
from plotlink.operators.scratch import cut_lineage
from plotlink.params import DEFAULTS, Params

#: Pixels whose edges, and samples whose pixels, are worked out at once.
PIXELS, LOOKUPS = 1 << 19, 1 << 18


def luma(red: Column, green: Column, blue: Column) -> Column:
    return F.lit(0.299) * red + F.lit(0.587) * green + F.lit(0.114) * blue


def _at(pixels: Column, i: Column) -> Column:
    return F.get(pixels, i)


def _laid(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once, below whatever uses them: an explode of one element is not merged into later expressions."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_l")).select(*kept, "_l.*")


def _lists(values: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Elements of all rows' lists, and where each row's begin and how many they are (none for null)."""
    sizes = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return values.flatten(), np.cumsum(sizes) - sizes, sizes


def _numbers(values: pa.Array) -> np.ndarray:
    return values.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _edged(gray: np.ndarray, params: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """gx, gy, mag and threshold of pictures of one size (pictures, h, w), see with_edges."""
    beside = lambda g, axis: (np.concatenate([g.take([0], axis), g.take(range(g.shape[axis] - 1), axis)], axis), np.concatenate([g.take(range(1, g.shape[axis]), axis), g.take([-1], axis)], axis))
    s = gray
    for axis in (2, 1):
        before, after = beside(s, axis)
        s = (before + 2 * s + after) / 4
    gx, gy = np.zeros_like(s), np.zeros_like(s)
    gx[:, 1:-1, 1:-1] = (s[:, :-2, 2:] + 2 * s[:, 1:-1, 2:] + s[:, 2:, 2:]) - (s[:, :-2, :-2] + 2 * s[:, 1:-1, :-2] + s[:, 2:, :-2])
    gy[:, 1:-1, 1:-1] = (s[:, 2:, :-2] + 2 * s[:, 2:, 1:-1] + s[:, 2:, 2:]) - (s[:, :-2, :-2] + 2 * s[:, :-2, 1:-1] + s[:, :-2, 2:])
    mag = np.sqrt(gx * gx + gy * gy)
    flat = mag.reshape(len(mag), -1)
    n = flat.shape[1]
    pick = np.nan_to_num(np.sort(flat, axis=1)[:, min(n, int(math.floor(n * params.edge_quantile)) + 1) - 1])
    return gx, gy, mag, np.maximum(params.edge_floor, pick)


def with_edges(images: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Adds gx, gy, mag (Sobel of the image after a separable 1-2-1 filter whose border repeats its own pixels, 0 on the border) and
    threshold: at least edge_floor, else the magnitude at rank floor(n * edge_quantile), border included. Pictures of one size
    in a batch are worked out together. One without pixels, or with fewer than w * h, has no edges."""

    @F.arrow_udf("struct<gx:array<double>,gy:array<double>,mag:array<double>,threshold:double>")
    def edges_of(gray: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
        pixels, starts, sizes = _lists(gray)
        pixels = _numbers(pixels)
        wide, high = (v.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for v in (w, h))
        whole = (wide > 0) & (high > 0) & (sizes >= wide * high)
        n = np.where(whole, wide * high, 0)
        at = np.cumsum(n) - n
        out = [np.zeros(int(n.sum())) for _ in range(3)]
        threshold = np.full(len(n), float(params.edge_floor))
        for size in {(int(a), int(b)) for a, b in zip(wide[whole], high[whole], strict=True)}:
            rows = np.flatnonzero(whole & (wide == size[0]) & (high == size[1]))
            step = max(1, PIXELS // (size[0] * size[1]))
            for k in range(0, len(rows), step):
                some, place = rows[k : k + step], np.arange(size[0] * size[1])
                *made, threshold[some] = _edged(pixels[starts[some, None] + place].reshape(-1, size[1], size[0]), params)
                for o, m in zip(out, made, strict=True):
                    o[at[some, None] + place] = m.reshape(len(some), -1)
        ends = pa.array(np.append(at, n.sum()), pa.int32())
        return pa.StructArray.from_arrays([*[pa.ListArray.from_arrays(ends, pa.array(o)) for o in out], pa.array(threshold)], ["gx", "gy", "mag", "threshold"])

    given = _laid(images, _g=F.col("gray").cast("array<double>"), _w=F.col("w").cast("int"), _h=F.col("h").cast("int"))
    return given.withColumn("_e", edges_of("_g", "_w", "_h")).select(*images.columns, "_e.*")


def outline_samples(ring: Column, params: Params = DEFAULTS, mask: Column | None = None) -> Column:
    """array<struct<x, y, nx, ny, masked>>: midpoints of floor(length / sample_step) >= 1 parts of every edge over 1 mm,
    with the edge's normal in image space. mask: array of rings whose inside is not counted."""

    def of_edge(e: Column) -> Column:
        length = F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"])
        n = F.greatest(F.lit(1), F.floor(length / params.sample_step).cast("int"))

        def one(k: Column) -> Column:
            t = (k + F.lit(0.5)) / n
            x, y = e["ax"] + t * (e["bx"] - e["ax"]), e["ay"] + t * (e["by"] - e["ay"])
            hidden = F.exists(mask, lambda r: G.contains_point(r, x, y)) if mask is not None else F.lit(False)
            return F.struct(x.alias("x"), y.alias("y"), (-(e["by"] - e["ay"]) / length).alias("nx"), (-(e["bx"] - e["ax"]) / length).alias("ny"), hidden.alias("masked"))

        return F.transform(F.sequence(F.lit(0), n - 1), one)

    long_enough = F.filter(G.edges(ring), lambda e: F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"]) >= 1e-3)
    return F.flatten(F.transform(long_enough, of_edge))


def support(samples: Column, dx: Column, dy: Column, reach: Column, params: Params = DEFAULTS) -> Column:
    """Share of the samples, moved by dx, dy metres, that have an aligned edge pixel within reach pixels along the
    normal. Uses the image columns of with_edges; null without samples."""
    w, h = F.col("w"), F.col("h")
    least = math.cos(math.radians(params.edge_angle))

    def supported(s: Column) -> Column:
        px, py = (s["x"] + dx - F.col("min_x")) / F.col("res"), (F.col("max_y") - s["y"] - dy) / F.col("res")

        def aligned(k: Column) -> Column:
            x, y = F.floor(px + k * s["nx"]).cast("int"), F.floor(py + k * s["ny"]).cast("int")
            i = y * w + x
            m = _at(F.col("mag"), i)
            inside = (x >= 1) & (y >= 1) & (x < w - 1) & (y < h - 1)
            return F.coalesce(F.when(inside, (m >= F.col("threshold")) & (F.abs(_at(F.col("gx"), i) * s["nx"] + _at(F.col("gy"), i) * s["ny"]) / m >= least)), F.lit(False))

        return F.exists(F.sequence(-reach, reach), aligned)

    return F.size(F.filter(samples, supported)) / F.nullif(F.size(samples).cast("double"), F.lit(0.0))


def supports(images: DataFrame, offsets: Column, reach: Column, params: Params = DEFAULTS) -> DataFrame:
    """images (with_edges columns and points) with offsets, an array<struct<x, y>>, and supports, the support of the points at each of them:
    all points and offsets of a batch's pictures are looked up together."""
    least = math.cos(math.radians(params.edge_angle))

    @F.arrow_udf("array<double>")
    def looked_up(samples: pa.Array, offsets: pa.Array, reach: pa.Array, gx: pa.Array, gy: pa.Array, mag: pa.Array, threshold: pa.Array, w: pa.Array, h: pa.Array, min_x: pa.Array, max_y: pa.Array, res: pa.Array) -> pa.Array:
        points, first_point, n_points = _lists(samples)
        moves, first_move, n_moves = _lists(offsets)
        sx, sy, nx, ny = (_numbers(points.field(c)) for c in ("x", "y", "nx", "ny"))
        dx, dy = (_numbers(moves.field(c)) for c in ("x", "y"))
        image, first_pixel, n_pixels = _lists(mag)
        m_all, gx_all, gy_all = (np.append(_numbers(v), 0.0) for v in (image, _lists(gx)[0], _lists(gy)[0]))
        wide, high, far = (v.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for v in (w, h, reach))
        limit, left, top, size = (_numbers(v) for v in (threshold, min_x, max_y, res))
        scores = np.full(int(n_moves.sum()), np.nan)
        n = n_points * n_moves
        turn = np.flatnonzero(n)
        chunks = np.split(turn, np.flatnonzero(np.diff(np.cumsum(n[turn]) // LOOKUPS)) + 1) if len(turn) else []
        for rows in chunks:
            r = np.repeat(rows, n[rows])
            k = np.arange(len(r)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])
            p, o = first_point[r] + k % n_points[r], first_move[r] + k // n_points[r]
            px, py = (sx[p] + dx[o] - left[r]) / size[r], (top[r] - sy[p] - dy[o]) / size[r]
            met = np.zeros(len(r), bool)
            with np.errstate(divide="ignore", invalid="ignore"):
                for step in range(-int(far[rows].max()), int(far[rows].max()) + 1):
                    x, y = np.floor(px + step * nx[p]), np.floor(py + step * ny[p])
                    inside = (x >= 1) & (y >= 1) & (x < wide[r] - 1) & (y < high[r] - 1) & (abs(step) <= far[r])
                    place = np.where(inside, y * wide[r] + x, 0).astype(np.int64)
                    i = np.where(inside & (place < n_pixels[r]), first_pixel[r] + place, -1)
                    m = m_all[i]
                    met |= (i >= 0) & (m >= limit[r]) & (np.abs(gx_all[i] * nx[p] + gy_all[i] * ny[p]) / m >= least)
            begins = np.flatnonzero(k % n_points[r] == 0)
            scores[o[begins]] = np.add.reduceat(met.astype(np.int64), begins) / n_points[r[begins]]
        ends = pa.array(np.append(first_move, n_moves.sum()), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(scores, mask=np.isnan(scores)))

    given = {"gx": "array<double>", "gy": "array<double>", "mag": "array<double>", "threshold": "double", "w": "int", "h": "int", "min_x": "double", "max_y": "double", "res": "double"}
    laid = _laid(images, offsets=offsets, _reach=reach.cast("int"), **{f"_{c}": F.col(c).cast(kind) for c, kind in given.items()})
    # Taken as not deterministic, it is neither repeated nor merged into expressions that only the JVM can work out.
    return laid.withColumn("supports", looked_up.asNondeterministic()("points", "offsets", "_reach", *[f"_{c}" for c in given])).drop("_reach", *[f"_{c}" for c in given])


def _steps(low: float, high: float, step: float) -> list[float]:
    return [low + k * step for k in range(int(math.floor((high - low) / step + 1e-6)) + 1)]


def _pointed(images: DataFrame, mask: Column | None, params: Params) -> DataFrame:
    """images with the samples of their grown outline: points, those that count, and masked, how many don't."""
    laid = _laid(_laid(images, grown=F.col("grown")), points=outline_samples(F.col("grown"), params, mask))
    return _laid(laid, masked=F.size(F.filter("points", lambda p: p["masked"])), points=F.filter("points", lambda p: ~p["masked"]))


def best_offset(images: DataFrame, keys: list[str], reach_m: float = 0.3, params: Params = DEFAULTS) -> DataFrame:
    """keys, score, offset_x, offset_y, overhang, samples, masked: the best support over roof overhangs and offsets.

    images: with_edges columns plus ring (and mask, an array of rings). For each overhang a coarse grid is searched
    and then a fine one (step res) around the best; equal scores go to the smaller offset, equal overhangs' scores
    to the smaller overhang. Pictures are not shuffled, only what was found. score is null where no sample is left.
    """
    coarse_step = 0.3
    hangs = F.array(*[F.lit(v) for v in _steps(0.0, params.max_overhang, params.overhang_step)])
    base = images.withColumn("overhang", F.explode(hangs)).withColumn("grown", G.mitred(F.col("ring"), F.col("overhang")))
    mask = F.col("mask") if "mask" in images.columns else None
    base = _pointed(base, mask, params)
    reach = F.greatest(F.lit(1), F.round(F.lit(reach_m) / F.col("res")).cast("int"))
    grid = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in _steps(-params.offset_range, params.offset_range, coarse_step) for y in _steps(-params.offset_range, params.offset_range, coarse_step)])
    rank = lambda o, s: F.when(s.isNotNull(), F.struct(s.alias("score"), (-F.hypot(o["x"], o["y"])).alias("near"), (-o["x"]).alias("first_x"), (-o["y"]).alias("first_y"), o.alias("o")))
    found = lambda df, offsets, name: _laid(supports(df, offsets, reach, params), **{name: F.array_max(F.zip_with("offsets", "supports", rank))}).drop("offsets", "supports")
    first = found(base, grid, "coarse")
    span = F.sequence(-F.ceil(F.lit(coarse_step) / F.col("res")).cast("int"), F.ceil(F.lit(coarse_step) / F.col("res")).cast("int"))
    fine = F.flatten(F.transform(span, lambda i: F.transform(span, lambda j: F.struct((F.col("coarse.o.x") + i * F.col("res")).alias("x"), (F.col("coarse.o.y") + j * F.col("res")).alias("y")))))
    within = F.filter(fine, lambda o: (F.abs(o["x"]) <= params.offset_range + 1e-9) & (F.abs(o["y"]) <= params.offset_range + 1e-9))
    second = found(first, F.when(F.col("coarse").isNotNull(), within), "best")
    over = second.groupBy(*keys).agg(F.max(F.struct(F.col("best.score").alias("score"), (-F.col("overhang")).alias("hang"), F.col("best"), F.size("points").alias("samples"), F.col("masked"))).alias("b"))
    return over.select(*keys, F.col("b.score").alias("score"), F.col("b.best.o.x").alias("offset_x"), F.col("b.best.o.y").alias("offset_y"), (-F.col("b.hang")).alias("overhang"), F.col("b.samples").cast("long").alias("samples"), F.col("b.masked").cast("long").alias("masked"))


def derived(result: DataFrame) -> DataFrame:
    """Adds offset, masked_share and valid."""
    total = F.col("samples") + F.col("masked")
    return result.withColumn("offset", F.hypot("offset_x", "offset_y")).withColumn("masked_share", F.when(total > 0, F.col("masked") / total).otherwise(0.0)).withColumn("valid", F.col("score").isNotNull() & ~F.isnan("score"))


def score_at(images: DataFrame, keys: list[str], reach_m: float = 0.3, params: Params = DEFAULTS) -> DataFrame:
    """keys, score, samples, masked at a given offset_x, offset_y and overhang: how well another outline (ring) does where the official
    one was found. Columns as in best_offset."""
    mask = F.col("mask") if "mask" in images.columns else None
    base = _pointed(images.withColumn("grown", G.mitred(F.col("ring"), F.col("overhang"))), mask, params)
    reach = F.greatest(F.lit(1), F.round(F.lit(reach_m) / F.col("res")).cast("int"))
    there = F.array(F.struct(F.col("offset_x").alias("x"), F.col("offset_y").alias("y")))
    return supports(base, there, reach, params).select(*keys, F.get("supports", F.lit(0)).alias("score"), F.size("points").cast("long").alias("samples"), F.col("masked").cast("long").alias("masked"))


def image_box(ring: Column, partner_ring: Column, params: Params = DEFAULTS) -> Column:
    """struct<x0..y1>: what an image check needs to see: both outlines, and room for offset, overhang, snapping and edges."""
    room = params.offset_range + params.max_overhang + params.snap + 2
    both = G.envelope(F.concat(ring, F.coalesce(partner_ring, F.slice(ring, 1, 2))))
    return F.struct((both["x0"] - room).alias("x0"), (both["y0"] - room).alias("y0"), (both["x1"] + room).alias("x1"), (both["y1"] + room).alias("y1"))


def checked(candidates: DataFrame, images: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """id, score, map_score, offset_x, offset_y, overhang, samples, masked, error, hint of candidates of the classes that need a check.

    candidates: id, match_class, ring, partner_ring (null without partner), mask; images: id, w..gray, error. The map outline is
    scored where the official one was found. A candidate without a picture has its error, or "no image", and no score.
    """
    c = candidates.where(F.col("match_class").isin("NEU", "ABWEICHEND"))
    j = c.join(images, "id", "left").withColumn("error", F.when(F.col("gray").isNull(), F.coalesce("error", F.lit("no image"))))
    good = with_edges(j.where("error is null").drop("error"), params)
    found = cut_lineage(derived(best_offset(good, ["id"], params=params)))
    other = good.where("partner_ring is not null").drop("ring").withColumnRenamed("partner_ring", "ring").join(found.select("id", "offset_x", "offset_y", "overhang"), "id")
    scored = score_at(other, ["id"], params=params).select("id", F.col("score").alias("map_score"))
    hint = F.when(F.col("masked_share") >= 0.25, F.concat(F.format_string("%.0f", 100 * F.col("masked_share")), F.lit(" % of the outline runs along neighbours")))
    out = j.select("id", "error").join(found, "id", "left").join(scored, "id", "left")
    return out.select("id", "score", "map_score", "offset_x", "offset_y", "overhang", "samples", "masked", F.when(F.col("error").isNull() & F.col("score").isNull(), "no samples").otherwise(F.col("error")).alias("error"), hint.alias("hint"))
