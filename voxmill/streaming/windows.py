"""Structured Streaming over arriving data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def window_lattice(events: DataFrame, axes: dict[str, str], window: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """``window, *axes, n``: events counted per lattice position and tumbling window.

    ``axes`` maps an index name to an SQL expression of it. Works on a table as on
    a stream; on a stream, events later than ``late`` are dropped and state is bounded.
    """
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark(time, late)
    index = [F.expr(e).cast("int").alias(a) for a, e in axes.items()]
    return events.groupBy(F.window(time, window), *index).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *axes, "n")


def arriving_files(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], files_per_batch: int = 64) -> DataStreamWriter:
    """A stream that gives each new text file, whole, to ``handle(files, batch)`` once; a checkpoint location makes that hold over restarts."""
    files = spark.readStream.format("text").schema("value string").option("wholetext", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.select(F.col("_metadata.file_path").alias("path"), "value").writeStream.foreachBatch(handle)
