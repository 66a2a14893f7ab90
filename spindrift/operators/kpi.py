"""Sentiment counts, shares, trends and summary indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text as T

CLASSES = {-1: "negative", 0: "neutral", 1: "positive"}


def sentiment_counts(df: DataFrame, sentiment: str = "sentiment") -> DataFrame:
    return df.agg(*[F.count_if(F.col(sentiment) == k).alias(name) for k, name in CLASSES.items()])


def pie(df: DataFrame, sentiment: str = "sentiment") -> DataFrame:
    """(position, label, n, share) in the order positive, neutral, negative; fails where nothing is counted."""
    counts = sentiment_counts(df, sentiment)
    total = F.col("positive") + F.col("neutral") + F.col("negative")
    checked = counts.withColumn("_total", F.when(total > 0, total).otherwise(F.raise_error(F.lit("Sentiment counts sum to zero")).cast("long")))
    rows = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(n.capitalize()).alias("label"), F.col(n).alias("n")) for k, n in enumerate(["positive", "neutral", "negative"], 1)])
    out = checked.select("_total", F.explode(rows).alias("x")).select("x.*", (F.col("x.n") * 100 / F.col("_total")).alias("share"))
    return out.withColumn("shown", T.percent_label(F.col("share")))


def author(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("Unknown"))


def summary(df: DataFrame, text: str, author_column: str, sentiment: str) -> DataFrame:
    """Total comments, unique commenters, average words, average sentiment and its 0-10 form, from integer sums."""
    sums = df.agg(
        F.count(F.lit(1)).alias("total_comments"), F.countDistinct(author(F.col(author_column).cast("string"))).alias("unique_commenters"),
        F.sum(T.word_count(F.col(text))).alias("_words"), F.sum(sentiment).alias("_sentiment"),
    )
    ratio = lambda c: (F.col(c).cast("decimal(20,0)") / F.col("total_comments").cast("decimal(20,0)"))
    out = sums.select("total_comments", "unique_commenters", T.fixed(ratio("_words")).alias("average_words"), T.fixed(ratio("_sentiment")).alias("average_sentiment"))
    return out.withColumn("normalised_score", T.fixed((F.col("average_sentiment") + 1) * 5))


def trend(df: DataFrame, ts: str, sentiment: str, grain: str = "month") -> DataFrame:
    """Counts and percentages of each sentiment by period; empty periods have no row, absent sentiments are 0.  One exchange."""
    start = F.date_trunc(grain, F.col(ts).cast("timestamp"))
    period = F.last_day(F.col(ts)) if grain == "month" else start.cast("date")
    counted = df.groupBy(period.alias("period")).agg(*[F.count_if(F.col(sentiment) == k).alias(name) for k, name in CLASSES.items()])
    total = F.col("negative") + F.col("neutral") + F.col("positive")
    return counted.withColumn("total", total).where("total > 0").select("*", *[(F.col(n) * 100 / F.col("total")).alias(f"{n}_percent") for n in CLASSES.values()])
