"""Evaluation of scores and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rates(scored: DataFrame, thresholds: list[float], area: str = "area", score: str = "score", positive: str = "positive") -> DataFrame:
    """threshold, area (null: all), tpr, fpr, n: shares of positives and of the others with score >= threshold.

    Each row is first reduced to counts by (area, positive, score), so the thresholds multiply a small table.
    """
    counts = scored.groupBy(area, positive, score).agg(F.count(F.lit(1)).alias("n"))
    t = counts.withColumn("threshold", F.explode(F.array(*[F.lit(v) for v in thresholds])))
    hit = F.when(F.col(score) >= F.col("threshold"), F.col("n")).otherwise(0)
    share = lambda p: F.sum(F.when(F.col(positive) == p, hit).otherwise(0)) / F.greatest(F.lit(1), F.sum(F.when(F.col(positive) == p, F.col("n")).otherwise(0)))
    return t.cube("threshold", area).agg(share(True).alias("tpr"), share(False).alias("fpr"), F.sum("n").alias("n"), F.grouping("threshold").alias("no_threshold")).where("no_threshold = 0").drop("no_threshold")


def confusion(log: DataFrame, decisions: list[str], by: str = "recommendation", decision: str = "decision") -> DataFrame:
    """One row a recommendation, one count column a decision."""
    return log.groupBy(by).pivot(decision, decisions).agg(F.count(F.lit(1))).fillna(0, subset=decisions)


def calibration(log: DataFrame, width: float = 0.05, score: str = "score", accepted: str = "accepted") -> DataFrame:
    """bin (lower end), n, accepted share."""
    return log.withColumn("bin", F.floor(F.col(score) / width + 1e-9).cast("int")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(accepted).cast("double")).alias("accepted_share"))


def decision_times(log: DataFrame, by: str = "recommendation", duration: str = "duration_ms") -> DataFrame:
    """Mean and median over rows that were shown (duration not negative)."""
    return log.where(F.col(duration) >= 0).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(duration).alias("mean_ms"), F.expr(f"percentile({duration}, 0.5)").alias("median_ms"))


def states(log: DataFrame, key: str = "id", seq: str = "seq", decision: str = "decision") -> DataFrame:
    """The log folded to the current status of each candidate: its latest event; `open` resets it."""
    return log.groupBy(key).agg(F.max_by(decision, seq).alias("status"), F.count(F.lit(1)).alias("events"))
