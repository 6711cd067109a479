"""Address checks against the map layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotlink.params import DEFAULTS, Params


def existing_addresses(candidates: DataFrame, addresses: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """candidates (id, street, housenumber, cx, cy, partner) plus existing: the first map object (least owner) other
    than the own partner that carries the same address, letter case aside, within address_distance; else null.

    An equi-join on street, number and a grid cell as wide as the distance, so that a common street name meets only its
    namesakes near by; each candidate looks into its own cell and those around it.
    """
    cell = lambda v: F.floor(v / params.address_distance).cast("long")
    around = F.sequence(F.lit(-1), F.lit(1))
    a = addresses.select(F.lower("street").alias("k_street"), F.lower("housenumber").alias("k_number"), F.col("owner"), F.col("x"), F.col("y"), cell(F.col("x")).alias("gx"), cell(F.col("y")).alias("gy"))
    c = candidates.select("id", F.lower("street").alias("k_street"), F.lower("housenumber").alias("k_number"), "cx", "cy", "partner").where("k_street is not null and k_number is not null")
    c = c.withColumn("gx", F.explode(F.transform(around, lambda d: cell(F.col("cx")) + d))).withColumn("gy", F.explode(F.transform(around, lambda d: cell(F.col("cy")) + d)))
    near = c.join(a, ["k_street", "k_number", "gx", "gy"]).where((F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) <= params.address_distance) & ~F.col("owner").eqNullSafe(F.col("partner")))
    return candidates.join(near.groupBy("id").agg(F.min("owner").alias("existing")), "id", "left")
