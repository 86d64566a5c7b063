"""Summaries that keep up with a stream of results. An extension: the reference's work is all batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.metrics import counts


def windowed_accuracy(results: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """results (track, prediction, correct and a time column) counted per track and time window, late rows up to a bound."""
    return results.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), "track").agg(*counts())


def append_to(summary: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write every window once, when no row for it can come any more."""
    return summary.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
