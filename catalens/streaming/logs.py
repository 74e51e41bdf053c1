"""Annotations and execution logs as streams.

The batch forms are ``operators.annotations`` and ``sources.system_views.log_rollup``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.annotations import accepted, rejected, validate


def unique_annotations(stream: DataFrame, *, at: str, delay: str) -> DataFrame:
    """Validated annotations with ids repeated within ``delay`` dropped."""
    return accepted(validate(stream)).withWatermark(at, delay).dropDuplicatesWithinWatermark(["id"])


def rejected_annotations(stream: DataFrame) -> DataFrame:
    """Invalid annotations with the reason, for a sink of their own."""
    return rejected(validate(stream))


def daily_executions(stream: DataFrame, *, name: str, at: str, duration: str, delay: str) -> DataFrame:
    """Executions, last run and mean duration per object and day; rows later than ``delay`` are dropped."""
    return (
        stream.withWatermark(at, delay)
        .groupBy(F.window(at, "1 day"), F.col(name).alias("object_name"))
        .agg(
            F.count("*").alias("execution_count"), F.max(at).alias("last_execution_time"),
            F.avg(duration).alias("avg_duration"),
        )
        .select(F.col("window.start").alias("day"), "object_name", "execution_count", "last_execution_time", "avg_duration")
    )


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there now into parquet, then stop."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
