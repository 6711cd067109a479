"""Sharding by proportional stratified interleaving.

Every source is shuffled by a seeded hash, each row gets the fractional rank (rank + 1/2) / rows of its
source, all rows are ordered by that fraction, and the order is cut into equal runs. Each run then holds
every source in the proportion of the whole.

No window ever spans a whole source or the whole corpus. Ranks are taken within (source, slice of the hash
space) and within slices of the fractional rank; small tables of slice counts turn them into global ranks.
Hash slices are even by construction, so a source with a third of all rows is spread like the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotlink.llm import common

SEED = "interleave-1"
N_SHARDS = 16
#: Rows that a slice should hold, and the least and largest number of slices.
SLICE_ROWS, MIN_SLICES, MAX_SLICES = 10_000, 256, 1 << 22


def _slices(n_rows: int) -> int:
    return max(MIN_SLICES, min(MAX_SLICES, -(-n_rows // SLICE_ROWS)))


def _before(counts: DataFrame, by: list[str], order: str, n: str) -> DataFrame:
    """Running count of all earlier slices."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(order)
    return counts.withColumn("before", F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def interleave(rows: DataFrame, n_shards: int = N_SHARDS, *, row_id: str = "doc_id", source: str = "source", ties: list[Column] | None = None, carry: dict[str, Column] | None = None, seed: str = SEED) -> DataFrame:
    """Deal rows into n_shards shards of equal row counts (at most one apart), each with the corpus mixture.

    Returns row_id, source, the carried columns, shard (int) and slot (gapless from 0 within a shard).
    A null source is a stratum of its own and orders last; a null id takes part like any other value.
    Rows that agree in id are ordered by ties. An empty table gives an empty result. Other input columns
    are not looked at, so their names cannot clash.
    """
    carry = carry or {}
    narrow = rows.select(
        F.col(row_id).alias("k_id"), F.col(source).alias("k_source"), common.stratum_key(F.col(source)).alias("k_stratum"), common.seeded_hex(seed, F.col(row_id)).alias("k_hash"),
        *[c.alias(f"k_tie{i}") for i, c in enumerate(ties or [])], *[c.alias(f"c_{name}") for name, c in carry.items()],
    )
    narrow = common.stored(narrow, "shard-rows")
    n_rows = narrow.count()
    slices = _slices(n_rows)
    tie_names = [c for c in narrow.columns if c.startswith("k_tie")]

    hashed = narrow.withColumn("k_slice", F.floor(F.conv(F.substring("k_hash", 1, 8), 16, 10).cast("long") * F.lit(slices) / F.lit(1 << 32)).cast("long"))
    counts = hashed.groupBy("k_stratum", "k_slice").agg(F.count(F.lit(1)).alias("n"))
    offsets = _before(counts, ["k_stratum"], "k_slice", "n").withColumn("n_source", F.sum("n").over(Window.partitionBy("k_stratum"))).drop("n")
    offsets = common.small(common.stored(offsets, "shard-offsets"))
    in_slice = Window.partitionBy("k_stratum", "k_slice").orderBy("k_hash", "k_id", *tie_names)
    ranked = hashed.join(offsets, ["k_stratum", "k_slice"]).withColumn("k_rank", F.col("before") + F.row_number().over(in_slice)).drop("before", "k_slice")
    ranked = ranked.withColumn("k_frac", (F.col("k_rank") - F.lit(0.5)) / F.col("n_source"))
    ranked = common.stored(ranked.withColumn("k_part", F.floor(F.col("k_frac") * slices).cast("long")).drop("k_hash", "n_source", *tie_names), "shard-ranked")

    parts = common.small(common.stored(_before(ranked.groupBy("k_part").agg(F.count(F.lit(1)).alias("n")), [], "k_part", "n").drop("n"), "shard-parts"))
    in_part = Window.partitionBy("k_part").orderBy("k_frac", "k_stratum", "k_rank")
    placed = ranked.join(parts, "k_part").withColumn("k_pos", F.col("before") + F.row_number().over(in_part) - 1)
    shard = F.floor(F.col("k_pos") * n_shards / F.lit(max(n_rows, 1))).cast("int")
    first = F.ceil(F.col("shard") * F.lit(n_rows).cast("long") / F.lit(n_shards)).cast("long")
    return placed.withColumn("shard", shard).select(F.col("k_id").alias(row_id), F.col("k_source").alias(source), *[F.col(f"c_{name}").alias(name) for name in carry], "shard", (F.col("k_pos") - first).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """The contract's columns for a table of documents; null text counts as no bytes.

    Every row has its own place, repeated rows and equal texts too; rows that share an id, or have none, are ordered by their text's
    checksum and size, and wholly equal ones in any way, which does not show. A null source is a source of its own. An empty table
    gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    crc = F.crc32(common.utf8_bytes(text))
    dealt = interleave(docs, n_shards, ties=[crc, size], carry={"size": size, "text_crc32": crc})
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
