"""Tile-at-a-time processing as a stream: what has been done is in the stream's checkpoint, and a restart goes on from there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def process_new_tiles(spark: SparkSession, tiles: str, schema, compute: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, files_per_batch: int = 4) -> StreamingQuery:
    """Apply ``compute`` to tile files that have not been processed yet, a few a batch, and stop when there are none left.

    Each batch replaces its own folder, so that a batch that is run again leaves its rows once."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(tiles)

    def commit(batch: DataFrame, number: int) -> None:
        compute(batch).write.mode("overwrite").parquet(f"{output}/batch={number:08d}")

    query = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def running_statistics(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Mergeable statistics of each key over all batches so far, for output mode complete or update."""
    x = F.col(value)
    return stream.groupBy(key).agg(F.count(x).alias("count"), F.sum(x).alias("sum"), F.sum(x * x).alias("sum_sq"), F.min(x).alias("min"), F.max(x).alias("max"), F.count_if(F.abs(x) > 1).alias("over_1"))


def monthly_statistics(stream: DataFrame, ts: str, key: str, value: str, late_days: int = 7) -> DataFrame:
    """Sum and count of each calendar month and key: one row each.

    The watermark lies on the month's first day, ``late_days`` and the longest month behind, so a row that is late by at most
    that many days counts, and the state holds three months at most."""
    months = stream.withColumn("month", F.date_trunc("month", F.col(ts).cast("timestamp"))).withWatermark("month", f"{31 + late_days} days")
    return months.groupBy("month", key).agg(F.sum(value).alias("sum"), F.count(value).alias("count"))
