"""Sentiment counts by month as a stream with state: days are counted, months are sums of days.

The stream reads what is there and stops; started again on the same checkpoint
it goes on with what has come since.  A day's counts leave the state once the
watermark has passed it.  Each batch writes the days it changed into a folder of
its own, so a batch that is repeated after a failure writes the same again; the
last batch of a day has its counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How late a row may come.
LATENESS = "2 days"
_DAYS = "day timestamp, negative long, neutral long, positive long, batch long"


def advance(spark: SparkSession, source: str, schema: str, checkpoint: str, out: str, timestamp: str = "timestamp", sentiment: str = "sentiment") -> None:
    """Count the rows of ``source``, a folder of Parquet files, that have come since the last call with this checkpoint."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).withColumn("_at", F.col(timestamp).cast("timestamp"))
    s = F.col(sentiment)
    counted = rows.withWatermark("_at", LATENESS).groupBy(F.window("_at", "1 day").alias("w"))
    days = counted.agg(F.count_if(s == -1).alias("negative"), F.count_if(s == 0).alias("neutral"), F.count_if(s == 1).alias("positive"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.col("w.start").alias("day"), "negative", "neutral", "positive").write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = days.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()


def months(spark: SparkSession, out: str) -> DataFrame:
    """(period, negative, neutral, positive) of what has been counted; the period is the month's last day."""
    days = spark.read.schema(_DAYS).option("basePath", out).parquet(out)
    last = days.groupBy("day").agg(F.max_by(F.struct("negative", "neutral", "positive"), "batch").alias("c")).select("day", "c.*")
    return last.groupBy(F.last_day("day").alias("period")).agg(*[F.sum(c).alias(c) for c in ("negative", "neutral", "positive")])
