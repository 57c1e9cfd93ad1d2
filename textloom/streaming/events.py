"""Streams of review events: counts in event-time windows, and the current status of items. These extend the batch
operators; on a finite input they end in the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import decision


def window_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total): events in tumbling windows; a stream drops those later than `late`."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    rows = events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def status(events: DataFrame) -> DataFrame:
    """(user_id, status): the last decision of each item; as a stream in update mode."""
    d = decision(F.col("event_type"))
    last = events.where(d.isNotNull()).groupBy("user_id").agg(F.max(F.struct("event_id", d.alias("d"))).alias("l"))
    return last.select("user_id", F.col("l.d").alias("status"))


def drained(spark: SparkSession, stream: DataFrame, mode: str, path: str, keys: list[str]) -> DataFrame:
    """Run a stream over what its source has, into Parquet under `path`; for update mode the last row of each key counts."""
    out, state = f"{path}/rows", f"{path}/state"

    def add(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("append").parquet(out)

    run = stream.writeStream.outputMode(mode).foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.parquet(out)
    if mode != "update":
        return rows.drop("_batch")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
