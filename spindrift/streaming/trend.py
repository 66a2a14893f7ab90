"""Sentiment counts of a stream by tumbling window; an extension, as the batch trend has no stream of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.kpi import CLASSES


def windowed_counts(stream: DataFrame, ts: str, sentiment: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """A row for each window once the watermark has passed it.  The time is cast, as watermarks need a zone."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    counted = timed.groupBy(F.window("_ts", window).alias("w")).agg(*[F.count_if(F.col(sentiment) == k).alias(n) for k, n in CLASSES.items()])
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *CLASSES.values())
