"""The decision log as a stream: an extension of ours, for dashboards on running reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plotlink.operators import evaluate


def decision_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def rates_by_window(log: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, decision, n in event-time windows; rows later than the watermark are dropped by the engine."""
    return log.withWatermark(ts, late).groupBy(F.window(ts, width), "decision").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "decision", "n")


def follow_states(log: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keeps one Parquet table of current states up to date: each batch is folded with what was there."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("id").agg(F.max(F.struct("seq", "decision")).alias("last"))
        if batch_id:
            old = spark.read.parquet(f"{table}/batch={batch_id - 1}")
            new = new.unionByName(old).groupBy("id").agg(F.max("last").alias("last"))
        new.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_states(log: DataFrame) -> DataFrame:
    """The batch counterpart."""
    return evaluate.states(log)
