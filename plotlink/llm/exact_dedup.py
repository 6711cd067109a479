"""Exact dedup through an extendible-hash index on shared files.

1. Every row is fingerprinted once (64-bit hash, SHA-256 and length of the normalised text) into a shared table.
2. The directory starts at depth 0 and doubles: a bucket whose keys hold more bytes than fit splits on its next hash bit.
   Loads come from one histogram over 2^MAX_DEPTH slots, so its size is fixed whatever the input's is.
   A bucket that is still overfull at that depth stays whole as an overflow chain.
3. Rows go with their texts to the owner task of their bucket, a range of keys. There rows with the same hash form chains
   of texts, told apart by all their bytes. A key whose rows hold very many bytes, such as a text that a third of
   all rows share, is dealt to several owners, whose chains are merged afterwards: by then one entry an owner.
4. Owners write the index files in order of bucket, key and digest, and rows probe them by key and digest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotlink.llm import common

#: Bytes of text that a bucket holds before it splits, and the depth at which buckets stop splitting.
BUCKET_BYTES, MAX_DEPTH = 8 << 20, 16
#: Bytes of the rows of one key from which on they are dealt to several owners; bytes of an owner task.
HOT_BYTES, TASK_BYTES = 16 << 20, 64 << 20


@dataclass(frozen=True)
class Bucket:
    """prefix: the leading `depth` bits that all keys of the bucket share; keys: what they hold, in the unit of the loads."""

    prefix: int
    depth: int
    keys: int

    def slots(self) -> range:
        width = MAX_DEPTH - self.depth
        return range(self.prefix << width, (self.prefix + 1) << width)


def grow_directory(loads: dict[int, int], capacity: int = BUCKET_BYTES) -> list[Bucket]:
    """Split overfull buckets, doubling the directory as deep as needed. loads: by slot of MAX_DEPTH bits."""
    done, level = [], {0: sum(loads.values())}
    for depth in range(MAX_DEPTH + 1):
        full = {p for p, n in level.items() if n > capacity and depth < MAX_DEPTH}
        done += [Bucket(p, depth, n) for p, n in level.items() if p not in full]
        deeper: dict[int, int] = {}
        for slot, n in loads.items():
            if slot >> (MAX_DEPTH - depth) in full:
                child = slot >> (MAX_DEPTH - depth - 1)
                deeper[child] = deeper.get(child, 0) + n
        level = {child: deeper.get(child, 0) for p in full for child in (2 * p, 2 * p + 1)}
    return sorted(done, key=lambda b: b.prefix << (MAX_DEPTH - b.depth))


def slot_of(key: Column) -> Column:
    """The leading MAX_DEPTH bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - MAX_DEPTH).cast("int")


def normal_form(text: Column) -> Column:
    return common.lower_ascii(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, text: str = "text", row_id: str = "doc_id", key_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    norm = normal_form(F.col(text))
    return docs.select(F.col(row_id).alias("doc_id"), key_of(norm).alias("key"), F.sha2(common.utf8_bytes(norm), 256).alias("text_sha256"), (F.octet_length(norm) + 64).cast("long").alias("bytes"))


def build_index(docs: DataFrame, prints: DataFrame, capacity: int = BUCKET_BYTES, hot_bytes: int = HOT_BYTES, key_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Index files: bucket, key, chain (place among the different texts of the key), text_sha256, keep_id, group_size."""
    spark = docs.sparkSession
    keys = prints.groupBy("key").agg(F.sum("bytes").alias("held"))
    slots = keys.groupBy(slot_of(F.col("key")).alias("slot")).agg(F.sum(F.least("held", F.lit(hot_bytes))).alias("n"))
    loads = {r.slot: r.n for r in slots.collect()}  # 2^MAX_DEPTH rows at most
    buckets = grow_directory(loads, capacity)
    directory = F.broadcast(spark.createDataFrame([(slot, i) for i, b in enumerate(buckets) for slot in b.slots()], "slot int, bucket int"))
    hot = common.stored(keys.where(F.col("held") > hot_bytes).select("key", F.ceil(F.col("held") / hot_bytes).cast("int").alias("owners")), "hot-keys")

    norm = normal_form(F.col("text"))
    rows = docs.select("doc_id", key_of(norm).alias("key"), norm.alias("bytes")).withColumn("slot", slot_of(F.col("key"))).join(directory, "slot")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(loads.values()) // TASK_BYTES))
    chained = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    # An owner task holds whole buckets, so grouping them needs no other shuffle.
    owned = lambda r, *owner: r.repartition(tasks, *owner).groupBy(*owner, "key", "bytes").agg(*chained)
    entry = lambda c: c.select("bucket", "key", F.sha2(common.utf8_bytes(F.col("bytes")), 256).alias("text_sha256"), "keep_id", "group_size")
    if hot.isEmpty():
        entries = entry(owned(rows, "bucket"))
    else:
        cold = rows.join(common.small(hot), "key", "left_anti")
        dealt = rows.join(common.small(hot), "key").withColumn("owner", F.pmod(F.xxhash64("doc_id") + F.spark_partition_id(), F.col("owners")).cast("int"))
        merged = owned(dealt, "bucket", "owner").groupBy("bucket", "key", "bytes").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        entries = entry(owned(cold, "bucket")).unionByName(entry(merged))
    place = Window.partitionBy("bucket", "key").orderBy("text_sha256")
    return common.stored(entries.withColumn("chain", F.row_number().over(place)).select("bucket", "key", "chain", "text_sha256", "keep_id", "group_size"), "extendible-index")


def dedup(docs: DataFrame, capacity: int = BUCKET_BYTES, hot_bytes: int = HOT_BYTES, key_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row for each document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so after lower-casing A-Z; null counts as empty. The row with the largest
    doc_id stays. Rows that repeat a doc_id are counted, and all copies of the keeper's row are marked kept; a
    null doc_id is never the keeper unless its group has no other, and then keep_id is null and the row is kept.
    An empty table gives an empty result.
    """
    prints = common.stored(fingerprints(docs, key_of=key_of), "fingerprints")
    index = build_index(docs, prints, capacity, hot_bytes, key_of)
    repeated = index.where(F.col("group_size") > 1).select("key", "text_sha256", "keep_id", "group_size")
    probed = prints.join(repeated, ["key", "text_sha256"], "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return probed.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: of equal texts the row with the largest doc_id; rows without an id stay.

    Rows are told apart by what they hold: a row that shares its doc_id with a copy, but not its text, stays, and of
    several rows with the keeper's doc_id and text one does.
    """
    index = common.stored(dedup(docs).where("group_size > 1 and doc_id is not null").select(F.col("text_sha256").alias("sha"), "keep_id").distinct(), "repeated-texts")
    h1, h2 = common.row_hashes(docs)
    rows = docs.where("doc_id is not null").select("doc_id", h1.alias("h1"), h2.alias("h2"), F.sha2(common.utf8_bytes(normal_form(F.col("text"))), 256).alias("sha")).join(index, "sha")
    rows = common.stored(rows, "repeated-rows")
    best = rows.where("doc_id = keep_id").groupBy("sha").agg(F.min(F.struct("h1", "h2")).alias("best"))
    judged = rows.join(best, "sha")
    mine = "h1 = best.h1 and h2 = best.h2"
    twice = judged.where(mine).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return common.without_rows(docs, common.stored(judged.where(f"not ({mine})").select("h1", "h2").distinct(), "dropped-rows"), twice)
