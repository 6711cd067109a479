"""WARC fixity audit with Merkle trees over ordered offset ranges.

A leaf is the SHA-256 of a record. Leaves are gathered by ranges of file offsets: a node of level 0 covers SPAN bytes,
one of level k FANOUT^k times as many, and hashes its children in order. The roots of two replicas' archives are
compared first; only under nodes that differ are the next level's nodes compared, down to the records. Ranges are
tied to offsets, so a lost or altered record touches only its own branch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotlink.llm import common

SPAN, FANOUT = 64 << 10, 16
#: Records that an archive file holds on average when records are dealt to archives.
ARCHIVE_RECORDS = 2000


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """The text of a WARC response record; null url and html are empty."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, archive_records: int = ARCHIVE_RECORDS) -> DataFrame:
    """archive, offset, length, page_id, url, html: pages dealt evenly to archive files by a hash of page_id, and
    placed by page_id, url and html inside. An empty table has no archives."""
    length = F.octet_length(record_bytes(F.col("page_id"), F.col("url"), F.col("html"))).cast("long")
    sized = pages.select(_archive(pages, archive_records).alias("archive"), length.alias("length"), "page_id", "url", "html")
    return sized.withColumn("offset", _offset("page_id", "url", "html"))


def _archive(pages: DataFrame, archive_records: int) -> Column:
    archives = max(1, -(-pages.count() // archive_records))
    return F.pmod(F.conv(F.substring(common.seeded_hex("warc", F.col("page_id")), 1, 8), 16, 10).cast("long"), F.lit(archives))


def _offset(*order: str) -> Column:
    before = Window.partitionBy("archive").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("length").over(before), F.lit(0))


def digests(pages: DataFrame, replica_html: Column, archive_records: int = ARCHIVE_RECORDS) -> DataFrame:
    """archive, offset, page_id, digest and replica (the digest of the replica's record) of pages as `records` places them.

    Contents are hashed where they are read: what is sorted by archive is a few dozen bytes a record. Pages that agree in
    page_id and url go by their digest.
    """
    record = lambda html: record_bytes(F.col("page_id"), F.col("url"), html)
    sha = lambda content: F.sha2(common.utf8_bytes(content), 256)
    length = F.octet_length(record(F.col("html"))).cast("long")
    sized = pages.select(_archive(pages, archive_records).alias("archive"), length.alias("length"), "page_id", F.xxhash64("url").alias("place"), sha(record(F.col("html"))).alias("digest"), sha(record(replica_html)).alias("replica"))
    return sized.withColumn("offset", _offset("page_id", "place", "digest")).drop("length", "place")


def leaves(placed: DataFrame, content: Column, record_id: str = "page_id") -> DataFrame:
    """archive, offset, record_id, digest of each record."""
    return placed.select("archive", F.col("offset").cast("long"), F.col(record_id).alias("record_id"), F.sha2(common.utf8_bytes(content), 256).alias("digest"))


def _nodes(below: DataFrame, width: int, at: str) -> DataFrame:
    """Nodes of the next level: children in order, each with its place, hashed together."""
    child = F.struct(F.col(at).alias("at"), F.col("digest").alias("digest"))
    text = F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(child)), lambda c: F.concat_ws(":", c["at"].cast("string"), c["digest"])))
    return below.withColumn("up", F.floor(F.col(at) / F.lit(width)).cast("long")).groupBy("replica", "archive", "up").agg(F.sha2(common.utf8_bytes(text), 256).alias("digest")).withColumnRenamed("up", "range")


def _differing(nodes: DataFrame) -> DataFrame:
    """(archive, range) whose digests are not the same in both replicas."""
    of = lambda name: F.max(F.when(F.col("replica") == name, F.col("digest")))
    both = nodes.groupBy("archive", "range").agg(of("a").alias("a"), of("b").alias("b"))
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("archive", "range")


def audit(primary: DataFrame, replica: DataFrame, span: int = SPAN, fanout: int = FANOUT) -> DataFrame:
    """archive, offset, record_id, state (altered, missing, extra), expected and found digests of damaged records.

    Both sides are leaves. Records are told apart by archive and offset; where several share one, their digests
    are compared in order as one record with the least record_id. Rows with a null archive or offset cannot be
    placed and are left out. Two equal replicas, or two empty ones, give no rows.
    """
    both = primary.select(F.lit("a").alias("replica"), "*").unionByName(replica.select(F.lit("b").alias("replica"), "*")).where("archive is not null and offset is not null")
    placed = both.groupBy("replica", "archive", "offset").agg(F.min("record_id").alias("record_id"), F.concat_ws("+", F.sort_array(F.collect_list(F.coalesce("digest", F.lit("null"))))).alias("digest"))
    placed = common.stored(placed, "leaves")
    end = placed.agg(F.max("offset")).first()[0] or 0
    levels = [common.stored(_nodes(placed, span, "offset"), "ranges")]
    width = span
    while width <= end:
        levels.append(common.stored(_nodes(levels[-1], fanout, "range"), "ranges"))
        width *= fanout
    suspects = _differing(levels[-1])
    for below in reversed(levels[:-1]):
        parent = below.withColumn("up", F.floor(F.col("range") / fanout).cast("long"))
        suspects = _differing(parent.join(suspects.withColumnRenamed("range", "up"), ["archive", "up"], "left_semi"))
    in_doubt = placed.withColumn("range", F.floor(F.col("offset") / span).cast("long")).join(suspects, ["archive", "range"], "left_semi")
    of = lambda name, c: F.max(F.when(F.col("replica") == name, F.col(c)))
    paired = in_doubt.groupBy("archive", "offset").agg(F.coalesce(of("a", "record_id"), of("b", "record_id")).alias("record_id"), of("a", "digest").alias("expected"), of("b", "digest").alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("altered")
    return paired.where(~F.col("expected").eqNullSafe(F.col("found"))).select("archive", "offset", "record_id", state.alias("state"), "expected", "found")


def audit_pages(pages: DataFrame) -> DataFrame:
    """The registered query: archives of all pages against a replica that is damaged by rule.

    Of the pages whose seeded hash mod 50 is 0 the replica's html has its first printable character overwritten;
    where it is 1 the record is lost. The audit must find those records and no others.
    """
    fate = F.pmod(F.conv(F.substring(common.seeded_hex("damage", F.col("page_id")), 1, 8), 16, 10).cast("long"), F.lit(50))
    html = F.when(fate == 0, F.regexp_replace("html", r"^[\x21-\x7E]", "~")).otherwise(F.col("html"))
    placed = common.stored(digests(pages, html), "records")
    leaf = lambda rows, digest: rows.select("archive", F.col("offset").cast("long"), F.col("page_id").alias("record_id"), F.col(digest).alias("digest"))
    return audit(leaf(placed, "digest"), leaf(placed.where(fate != 1), "replica")).withColumnRenamed("record_id", "page_id")
