"""Incremental runs: what is done already is skipped, new files are appended once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def still_to_do(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``work`` whose key is not in ``done``; null keys count as equal to nothing and stay."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def append_files(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Append every parquet file of ``source`` that earlier runs have not seen to ``sink``, then stop."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(source)
    rows = change(rows) if change else rows
    query = rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and key; with a stream, windows close ``late`` after their end."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
