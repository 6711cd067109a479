"""Building layers derived from the star-schema tables by integer arithmetic, for queries that an oracle can check.

Each layer is one SELECT in SQL that Spark and DuckDB both understand; the operators that work on the layers are
DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotlink.functions import geometry as G

_BOX = "(p_partkey % 48) * 20e0 AS cx, floor(p_partkey / 48e0) * 20e0 AS cy, (6 + p_size % 7) * 1e0 AS w, (8 + p_size % 5) * 1e0 AS h, p_partkey % 16 AS r, p_partkey, p_type, p_name, p_brand, p_size"

OFFICIAL = f"SELECT p_partkey AS id, cx AS x0, cy AS y0, cx + w AS x1, cy + h AS y1, p_type AS function, p_name, p_brand, p_size FROM (SELECT {_BOX} FROM {{part}}) b"

#: Map layer by remainder of 16: none, same, shifted, shrunk, split, relation, merged with the next cell.
MAPPED = f"""
WITH b AS (SELECT {_BOX} FROM {{part}})
SELECT p_partkey * 2 AS osm_id, r NOT IN (5, 13) AS is_way, cx + d AS x0, cy AS y0, cx + d + w * f AS x1, cy + h * f AS y1 FROM (
  SELECT *, CASE WHEN r IN (2, 10) THEN 0.125e0 WHEN r IN (3, 5) THEN 1.5e0 ELSE 0e0 END AS d, CASE WHEN r = 11 THEN 0.5e0 ELSE 1e0 END AS f
  FROM b WHERE r IN (1, 9, 2, 10, 3, 5, 11, 13)) s
UNION ALL SELECT p_partkey * 2, true, cx, cy, cx + w / 2e0, cy + h FROM b WHERE r IN (4, 12)
UNION ALL SELECT p_partkey * 2 + 1, true, cx + w / 2e0, cy, cx + w, cy + h FROM b WHERE r IN (4, 12)
UNION ALL SELECT p_partkey * 2, true, cx, cy, cx + 32e0, cy + h FROM b WHERE r IN (6, 14)
"""

#: Mapped buildings that no official one covers.
ORPHANS = "SELECT -1 - s_suppkey AS osm_id, true AS is_way, -40e0 - (s_suppkey % 30) * 20e0 AS x0, floor(s_suppkey / 30e0) * 20e0 AS y0, -30e0 - (s_suppkey % 30) * 20e0 AS x1, floor(s_suppkey / 30e0) * 20e0 + 9e0 AS y1 FROM {supplier}"

#: Decision log rows; ts in the log's order, one profile for a user.
LOG = "SELECT event_id AS seq, ts, user_id % 7 AS profile, user_id % 500 AS id, CASE event_type WHEN 'purchase' THEN 'applied' WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'skipped' WHEN 'signup' THEN 'open' ELSE 'applied' END AS decision, (event_id * 37 % 100) / 100e0 AS score, event_id % 3 AS variant, event_id % 2 AS area, event_id * 13 % 9000 AS duration_ms FROM {events}"

#: Ways as ordered node lists, from orders and their lines: the node is the part.
WAY_NODES = "SELECT l_orderkey AS way_id, l_linenumber AS pos, l_partkey AS node_id FROM {lineitem}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def layer(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(sql, **{t: _table(spark, sf_dir, t) for t in tables})


def placed_layer(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    """A layer whose SELECT may use `at`: the row's place in the stored table, which settles ties as the table has them."""
    return spark.sql(sql, **{table: _table(spark, sf_dir, table).withColumn("at", F.struct("_metadata.file_path", "_metadata.row_index"))})


def with_ring(df: DataFrame) -> DataFrame:
    return df.withColumn("ring", G.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))


def official(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ring(layer(spark, sf_dir, OFFICIAL, "part"))


def mapped(spark: SparkSession, sf_dir: str, orphans: bool = False) -> DataFrame:
    out = layer(spark, sf_dir, MAPPED, "part")
    return with_ring(out.unionByName(layer(spark, sf_dir, ORPHANS, "supplier")) if orphans else out)


def oracle(sql: str) -> str:
    """The layer's text for an engine in which the tables are views."""
    return sql.format(part="part", supplier="supplier", events="events", lineitem="lineitem")
