"""Mixing sources to target weights by hash-threshold histograms.

A document's place in its source's fixed random order is a 60-bit hash. Words are summed by source and leading
hash bits; the bucket in which a source's budget runs out is the only one that is refined by the next bits. After
the last level a row is kept, dropped or (one row a source) cut by comparing its hash with one threshold:
nothing is sorted but the few rows of the last boundary bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotlink.llm import common

SEED = "mix-1"
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
HASH_BITS, LEVEL_BITS = 60, 12


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Water filling: a target is weight times one level, or `most` times its source's size if that is less.

    totals: stratum, source_size; one row a source. Adds target, whole (full passes) and budget (words of the
    last, partial pass).
    """
    by_name, everything = Window.partitionBy().orderBy("stratum"), Window.partitionBy()
    t = totals.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("pool", share * F.sum("source_size").over(everything).cast("double"))
    by_room = Window.partitionBy().orderBy(F.col("cap") / F.col("w"), "stratum")
    t = t.withColumn("rest", F.col("pool") - F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("w_rest", F.sum("w").over(by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    t = t.withColumn("place", F.row_number().over(by_room)).withColumn("fits", F.col("rest") * F.col("w") <= F.col("cap") * F.col("w_rest"))
    first = F.min(F.when(F.col("fits"), F.struct("place", "rest", "w_rest"))).over(everything)
    t = t.withColumn("level", first)
    t = t.withColumn("target", F.when(F.col("level").isNull() | (F.col("place") < F.col("level.place")), F.col("cap")).otherwise(F.col("w") * F.col("level.rest") / F.col("level.w_rest")))
    words = F.floor(F.col("target") + 0.5).cast("long")
    t = t.withColumn("whole", F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.least(F.lit(most), F.floor(words / F.col("source_size")))).cast("long"))
    return t.withColumn("budget", words - F.col("whole") * F.col("source_size")).select("stratum", "source_size", "target", "whole", "budget")


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED, whole_rows: bool = False) -> DataFrame:
    """How many words of each document the mix takes: doc_id, source, size, source_size, target, taken, whole.

    A source's taken words are its target, rounded: `whole` full passes over it and, of one more pass in hash
    order, the words up to its budget, so at most one document a source is cut. Null text has size 0 and takes
    nothing; a null source is a source, last in order; rows that agree in doc_id are separate documents, placed
    by size. An empty table gives an empty result. Columns other than doc_id, text and source are not looked at.
    whole_rows: each row of the plan also has its document as a struct, row.
    """
    at = F.conv(F.substring(common.seeded_hex(seed, F.col("doc_id")), 1, HASH_BITS // 4), 16, 10).cast("long")
    row = [F.struct(*docs.columns).alias("row")] if whole_rows else []
    rows = common.stored(docs.select("doc_id", "source", common.stratum_key(F.col("source")).alias("stratum"), common.n_words(F.col("text")).alias("size"), at.alias("at"), *row), "mix-rows")
    levels = max(2, min(HASH_BITS // LEVEL_BITS, -(-rows.count().bit_length() // LEVEL_BITS) + 1))

    plan = targets(rows.groupBy("stratum").agg(F.sum("size").alias("source_size")), weights, share, most)
    plan = common.stored(plan.withColumn("edge", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long")), "mix-plan")
    shift = HASH_BITS
    for _ in range(levels):
        inside = rows.join(common.small(plan.select("stratum", "edge")), "stratum").where(F.shiftright("at", shift) == F.col("edge"))
        shift -= LEVEL_BITS
        sums = inside.groupBy("stratum", F.shiftright("at", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("stratum").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("words").over(run.rowsBetween(Window.unboundedPreceding, 0))).join(common.small(plan.select("stratum", "budget", F.col("below").alias("base"))), "stratum")
        edge = sums.where(F.col("base") + F.col("upto") > F.col("budget")).groupBy("stratum").agg(F.min(F.struct("bucket", (F.col("base") + F.col("upto") - F.col("words")).alias("below"))).alias("e"))
        past_all = F.lit(1 << (HASH_BITS - shift)).cast("long")
        plan = common.stored(plan.drop("edge").join(edge, "stratum", "left").select(*plan.drop("edge", "below").columns, F.coalesce("e.bucket", past_all).alias("edge"), F.coalesce("e.below", "below").alias("below")), "mix-plan")

    placed = rows.join(common.small(plan), "stratum").withColumn("prefix", F.shiftright("at", shift))
    run = Window.partitionBy("stratum").orderBy("at", "doc_id", "size", *[F.col("row.text") for _ in row]).rowsBetween(Window.unboundedPreceding, -1)
    on_edge = placed.where(F.col("prefix") == F.col("edge")).withColumn("ahead", F.col("below") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    part = on_edge.withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("budget") - F.col("ahead")))).drop("ahead")
    rest = placed.where(F.col("prefix") != F.col("edge")).withColumn("part", F.when(F.col("prefix") < F.col("edge"), F.col("size")).otherwise(F.lit(0)))
    return rest.unionByName(part).select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"), "whole", "part", *[F.col("row") for _ in row])


def mix_documents(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def apply_mix(docs: DataFrame, columns: list[str] | None = None, **options) -> DataFrame:
    """The mixed corpus itself: each document as often as the mix takes it, the cut one shortened.

    Every row has its own part of the plan, whether its doc_id is a key, repeated or null; rows without words are
    kept once, as they are.
    """
    columns = columns or docs.columns
    planned = mix(docs, **options, whole_rows=True)
    text = F.col("row.text")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[{common.SPACE_CLASS}]*{common.WORD_PATTERN}"), F.lit(0)), 1, F.greatest(F.lit(1), F.col("part").cast("int"))), "")
    last = F.when(F.col("part") >= F.col("size"), text).otherwise(cut)
    copies = F.when(F.col("size") == 0, F.array(text)).otherwise(F.concat(F.array_repeat(text, F.col("whole").cast("int")), F.when(F.col("part") > 0, F.array(last)).otherwise(F.array().cast("array<string>"))))
    return planned.withColumn("m_text", F.explode(copies)).select(*[F.col("m_text").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in columns])
