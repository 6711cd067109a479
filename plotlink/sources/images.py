"""Aerial images of a map service: requests as Columns, pictures fetched and decoded in tasks.

PPM (P6), which needs no decoder, is read as it arrives. PNG, JPEG and whatever else Spark's image source can read are put into the
shared folder first and decoded there by that source, inside the JVM; saved pictures are read the same way.
"""

from __future__ import annotations

import urllib.parse
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotlink.operators.scratch import cut_lineage, shared_path
from plotlink.sources import wfs

MOST_PIXELS = 3000
#: Shares of red, green and blue in a pixel's luma (fixed values).
LUMA = (0.299, 0.587, 0.114)
IMAGE = "w int, h int, min_x double, max_y double, res double, gray array<double>, error string"


def request(box: Column, resolution: float, most: int = MOST_PIXELS) -> Column:
    """struct<x0, y0, x1, y1, width, height, res> of a picture that covers a box (x0..y1) from its upper left corner on: whole pixels,
    coarser where a side would have more than `most`."""
    w, h = box["x1"] - box["x0"], box["y1"] - box["y0"]
    side = F.greatest(w, h)
    res = F.when(side / resolution > most, side / most).otherwise(F.lit(resolution))
    n = lambda size: F.greatest(F.lit(1), F.ceil(size / res)).cast("int")
    return F.struct(box["x0"].alias("x0"), (box["y1"] - n(h) * res).alias("y0"), (box["x0"] + n(w) * res).alias("x1"), box["y1"].alias("y1"), n(w).alias("width"), n(h).alias("height"), res.alias("res"))


def url(base: str, r: Column, layers: str, crs: str, version: str = "1.3.0", style: str = "image/x-portable-pixmap") -> Column:
    """GetMap of a request. Projected systems keep the order east, north in every version."""
    number = lambda c: F.format_string("%.3f", r[c])
    fixed = wfs.append_query(base, {"SERVICE": "WMS", "VERSION": version, "REQUEST": "GetMap", "LAYERS": layers, "STYLES": "", "CRS" if version.startswith("1.3") else "SRS": crs, "FORMAT": style})
    return F.concat(F.lit(fixed + "&BBOX="), F.concat_ws(urllib.parse.quote(","), *[number(c) for c in ("x0", "y0", "x1", "y1")]), F.lit("&WIDTH="), r["width"].cast("string"), F.lit("&HEIGHT="), r["height"].cast("string"))


def decode(content: bytes) -> np.ndarray:
    """Luma of a PPM picture, row by row."""
    head, at = [], 0
    while len(head) < 4:
        end = next(k for k in range(at, len(content)) if content[k : k + 1].isspace())
        if content[at:end] and not content[at:end].startswith(b"#"):
            head.append(content[at:end])
        at = end + 1
    if head[0] != b"P6":
        raise ValueError("not a PPM picture")
    w, h = int(head[1]), int(head[2])
    rgb = np.frombuffer(content, np.uint8, w * h * 3, at).reshape(h, w, 3).astype(np.float64)
    return rgb @ np.array(LUMA)


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """file (the last part of its path), w, h, gray, error of saved PNG, JPEG, GIF or BMP pictures; one that cannot be decoded leaves an
    error. Grey pictures are their own luma, and opacity is not looked at."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, w, h, channels, data in zip(*(batch[c] for c in ("file", "width", "height", "nChannels", "data")), strict=True):
                if w <= 0 or h <= 0:
                    rows.append((file, None, None, None, "ValueError: not a picture that can be decoded"))
                    continue
                pixels = np.frombuffer(data, np.uint8).reshape(h * w, channels).astype(np.float64)
                gray = pixels[:, 0] if channels == 1 else pixels[:, :3] @ np.array(LUMA[::-1])  # stored as blue, green, red
                rows.append((file, w, h, gray, None))
            yield pd.DataFrame(rows, columns=["file", "w", "h", "gray", "error"]).astype({"w": "Int32", "h": "Int32"})

    found = spark.read.format("image").option("dropInvalid", False).load(path).select(F.substring_index("image.origin", "/", -1).alias("file"), "image.width", "image.height", "image.nChannels", "image.data")
    return found.mapInPandas(run, "file string, w int, h int, gray array<double>, error string")


def fetched(requests: DataFrame) -> DataFrame:
    """requests (id, url, x0, y1, x1) with w, h, min_x, max_y, res, gray and error: a picture that fails leaves its error and no pixels,
    and never stops the others. Every picture is fetched once and kept in the shared folder."""
    spark = requests.sparkSession
    folder = shared_path(spark, "pictures")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, place = fs.FileSystem.from_uri(folder)
        files.create_dir(place, recursive=True)
        for batch in batches:
            rows = []
            for i, u, x0, y1, x1 in zip(*(batch[c] for c in ("id", "url", "x0", "y1", "x1")), strict=True):
                try:
                    content = wfs.fetch(u)
                    if content.startswith(b"P6"):
                        gray = decode(content)
                        rows.append((i, gray.shape[1], gray.shape[0], x0, y1, (x1 - x0) / gray.shape[1], gray.ravel(), None, None, None))
                        continue
                    name = f"{uuid.uuid4().hex}.img"  # a task that runs again leaves a file that no row names
                    with files.open_output_stream(f"{place}/{name}") as out:
                        out.write(content)
                    rows.append((i, None, None, x0, y1, None, None, None, x1, name))
                except Exception as e:  # noqa: BLE001  any failure belongs to its own row
                    rows.append((i, None, None, x0, y1, None, None, f"{type(e).__name__}: {e}"[:300], None, None))
            yield pd.DataFrame(rows, columns=["id", "w", "h", "min_x", "max_y", "res", "gray", "error", "x1", "file"]).astype({"w": "Int32", "h": "Int32"})

    came = cut_lineage(requests.select("id", "url", "x0", "y1", "x1").mapInPandas(run, f"id {requests.schema['id'].dataType.simpleString()}, {IMAGE}, x1 double, file string"))
    done, coded = came.where("file is null").drop("x1", "file"), came.where("file is not null")
    if coded.isEmpty():
        return done
    decoded = coded.select("id", "min_x", "max_y", "x1", "file").join(read_pictures(spark, folder), "file")
    return done.unionByName(decoded.select("id", "w", "h", "min_x", "max_y", ((F.col("x1") - F.col("min_x")) / F.col("w")).alias("res"), "gray", "error"))
