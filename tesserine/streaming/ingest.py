"""Structured Streaming: rollups, dedup and idempotent micro-batch ingest with the batch operators' results.

The batch semantics have no watermark; in streaming mode a late point is folded in
as long as it is within ``delay`` of the newest event.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """A file stream; the number of files per trigger bounds each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, ts: str, key: str, value: str, span: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Tumbling windows per key: n, total, low, high."""
    stamped = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    g = stamped.groupBy(F.window("_ts", span).alias("w"), F.col(key).alias("series"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high")).select("series", F.unix_timestamp("w.start").alias("window_start"), "n", "total", "low", "high")


def first_seen(events: DataFrame, ts: str, keys: list[str], delay: str = "1 day") -> DataFrame:
    """The first event per keys within the delay."""
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay).dropDuplicatesWithinWatermark(keys)


def ingest(events: DataFrame, target: str, checkpoint: str, hook: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Append micro-batches, each in a folder named by its batch id, so that a repeated batch replaces itself."""

    def one(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        if hook is not None:
            hook(batch, batch_id)

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finite(events: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose given numbers are finite or NULL, rejected rows); both can be streams."""
    bad = F.lit(False)
    for c in columns:
        x = F.col(c).cast("double")
        bad = bad | F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(False))
    return events.where(~bad), events.where(bad)
