"""Streams of raw comments or submissions into tables of posts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def json_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """JSON lines from files that arrive in a folder. A line that isn't JSON fails the query rather than passing as nulls."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).where("trim(value) <> ''")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_posts(posts: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append posts to a Parquet table. Offsets live in the checkpoint: a run that failed goes on where it was, without loss or repeats."""
    writer = posts.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def write_batches(posts: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A sink of the caller's, once per micro-batch with its number."""
    return posts.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_reasons(judged: DataFrame) -> DataFrame:
    """Rejections by reason so far."""
    return judged.groupBy(F.coalesce("reason", F.lit("processed")).alias("reason")).count()


def windowed_counts(rows: DataFrame, time: str, size: str, late: str, by: list[str]) -> DataFrame:
    """Counts per event-time window; rows that come later than `late` are dropped from state."""
    return rows.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count("*").alias("n"))
