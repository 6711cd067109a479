"""Helpers that several operators share: scratch tables, checked broadcasts and normal forms."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it (fixed value).
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A side is broadcast only when its stored table has at most this many rows (of a few dozen bytes each).
BROADCAST_ROWS = 200_000
#: Bits for each hash in the filter by which rows are parted.
FILTER_SLOTS = 16


#: Tables that this process has written by `stored` and not released.
_written: list[str] = []


@functools.cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="plotlink-")


def scratch_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors. A temporary one where none is configured, but only in local mode: on a
    cluster every executor would write to its own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    return folder or f"file://{_local_scratch()}"


def mark() -> int:
    """A point to which `release` can go back."""
    return len(_written)


def release(spark: SparkSession, since: int = 0) -> None:
    """Remove the intermediate tables written since then. Results that were not written or collected by now need them."""
    for path in _written[since:]:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    del _written[since:]


def stored(df: DataFrame, label: str, partitions_by: str | None = None) -> DataFrame:
    """Cut lineage: write df as Parquet into the shared folder and read it back.

    Survives the loss of executors, and footers give exact row counts afterwards.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/plotlink/{label}-{uuid.uuid4().hex}"
    writer = df.write
    if partitions_by:
        writer = writer.partitionBy(partitions_by)
    _written.append(path)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a stored table, but only after its row count was checked."""
    return F.broadcast(df) if df.count() <= limit else df


def indexed(rows: DataFrame, group: str, order: list[str], ranges: list[Column] | None = None) -> DataFrame:
    """rows with idx, the place in their group from 0, and n, the group's size; no group is null. No group lies in one task: rows
    are sorted in ranges, and a range's count moves the places of those behind it. ranges: what ranges are cut by, if less than
    the whole order (a sample of it goes to the driver)."""
    placed = rows.repartitionByRange(group, *(ranges or order)).sortWithinPartitions(group, *order)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stored(placed.select("*", F.spark_partition_id().alias("_part"), row.alias("_row")), "ordered")
    parts = placed.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_count"))
    of = Window.partitionBy(group)
    before = F.coalesce(F.sum("_count").over(of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = stored(parts.select(group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_count").over(of).alias("n")), "order-parts")
    return placed.join(small(parts), [group, "_part"]).withColumn("idx", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def utf8_bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def n_words(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def stratum_key(source: Column) -> Column:
    """A never-null key in code point order with null last."""
    return F.when(source.isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), source))


def row_hashes(docs: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a row's columns (maps as JSON): the name of a row where its id may repeat."""
    cells = [F.to_json(F.struct(docs[f.name])) if "map<" in f.dataType.simpleString() else docs[f.name] for f in docs.schema.fields]
    # A null is left out of a hash, so each cell also says whether it is there.
    named = [x for c in cells for x in (c.isNull(), c)]
    return [F.xxhash64(*named), F.xxhash64(F.lit("row"), *named)]


def parted(rows: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (h1, ...) that are surely not named by h1, and the others: all named ones and a few more. Nothing is shuffled.

    A named hash sets one bit of a table of 64-bit words that is broadcast. The table has FILTER_SLOTS bits a hash, but at most
    BROADCAST_ROWS words: with more hashes than those have room for, more rows are among the others. named: stored tables.
    """
    words = max(1, min(BROADCAST_ROWS, -(-named.count() * FILTER_SLOTS // 64)))
    word, bit = F.pmod(F.shiftright("h1", 6), F.lit(words)), F.col("h1").bitwiseAND(F.lit(63)).cast("int")
    marks = named.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    marks = F.broadcast(stored(marks, "row-marks"))
    told = rows.withColumn("word", word).join(marks, "word", "left").withColumn("may", F.coalesce(F.bit_get("bits", bit) == 1, F.lit(False)))
    return told.where(~F.col("may")).select(*rows.columns), told.where("may").select(*rows.columns)


def without_rows(docs: DataFrame, dropped: DataFrame, repeated: DataFrame) -> DataFrame:
    """docs less the rows whose hashes (h1, h2) are in dropped; of the equal rows named in repeated one stays.

    Only rows that may be among those named are shuffled with their texts, the others pass where they are. dropped is a stored table.
    """
    h1, h2 = row_hashes(docs)
    repeated = stored(repeated.select("h1", "h2").distinct(), "repeated-rows")
    dropped = dropped.select("h1", "h2")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), h1.alias("h1"), h2.alias("h2"))
    passed, rows = parted(rows, dropped.unionByName(repeated))
    rows = rows.join(dropped, ["h1", "h2"], "left_anti")
    if not repeated.isEmpty():
        single, several = rows.join(repeated, ["h1", "h2"], "left_anti"), rows.join(repeated, ["h1", "h2"], "left_semi")
        rows = single.unionByName(several.dropDuplicates(["h1", "h2"]))
    return passed.unionByName(rows.select(*passed.columns)).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def seeded_hex(seed: str, row_id: Column) -> Column:
    """32 hex digits, uniform and the same in any engine that has MD5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit("null"))))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
