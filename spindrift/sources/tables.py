"""Reading and writing tables, requests and pages, with schemas that are always given."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.operators import cleaning

COMMENTS = "clean_comment string, category int"
TIMED_COMMENTS = "comments array<struct<text string, timestamp string, authorId string>>"
PLAIN_COMMENTS = "comments array<string>"
SENTIMENT_ROWS = "sentiment_data array<struct<timestamp string, sentiment int>>"
SENTIMENT_COUNTS = "sentiment_counts map<string, bigint>"
PAGE = "items array<struct<snippet struct<topLevelComment struct<snippet struct<textOriginal string, publishedAt string, authorChannelId struct<value string>>>>>>, nextPageToken string"
#: What a request without content is told (fixed values).
MISSING = {"comments": "No comments provided", "sentiment_counts": "No sentiment counts provided", "sentiment_data": "No sentiment data provided"}
#: A watch page's address, with the video's id (fixed value).
VIDEO_URL = r"^https://(?:www\.)?youtube\.com/watch\?v=([\w-]{11})"


def read_csv(spark: SparkSession, path: str, schema: str = COMMENTS, na_tokens: list[str] | None = None) -> DataFrame:
    """A CSV with a header; texts that stand for null become null."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.withColumns({c: cleaning.na_to_null(F.col(c), na_tokens) for c in text})


def read_filled(spark: SparkSession, path: str, schema: str = COMMENTS) -> DataFrame:
    """A CSV whose null texts become empty."""
    return read_csv(spark, path, schema).na.fill("")


def read_preprocessed(spark: SparkSession, path: str, subset: list[str] | None = None, schema: str = COMMENTS) -> DataFrame:
    return cleaning.drop_null(read_csv(spark, path, schema), subset)


def write_split(train: DataFrame, test: DataFrame, folder: str) -> None:
    """Train and test as Parquet, which keeps empty and blank texts as they are."""
    train.write.mode("overwrite").parquet(f"{folder}/train")
    test.write.mode("overwrite").parquet(f"{folder}/test")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with headers, one for each partition."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_single_csv(df: DataFrame, path: str) -> None:
    """One CSV file; for small results."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def load_params(path: str) -> dict:
    """Sections of ``key: value`` lines with numbers, lists of numbers or text; comments and blank lines are skipped."""
    out: dict = {}
    section = out
    for line in Path(path).read_text().splitlines():
        bare = line.split("#")[0].rstrip()
        if not bare:
            continue
        key, _, value = bare.strip().partition(":")
        if not value.strip():
            section = out.setdefault(key, {})
            continue
        into = section if line[0] in " \t" else out
        try:
            into[key] = json.loads(value)
        except ValueError:
            into[key] = value.strip()
    return out


def write_pointer(spark: SparkSession, run_id: str, model_path: str, path: str) -> None:
    spark.createDataFrame([(run_id, model_path)], "run_id string, model_path string").coalesce(1).write.mode("overwrite").json(path)


def read_pointer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("run_id string, model_path string").json(path)


def required(body: dict, field: str):
    """A request's ``field``, looked at on the driver before any job runs; a ValueError if it is missing, null or empty."""
    found = body.get(field)
    if not found:
        raise ValueError(MISSING[field])
    return found


def request_comments(bodies: DataFrame, body: str = "body") -> DataFrame:
    """The texts of requests, with their place in the request."""
    held = bodies.select("*", F.from_json(body, PLAIN_COMMENTS).alias("_b"))
    return held.select(*bodies.columns, F.posexplode("_b.comments").alias("position", "comment"))


def request_timed_comments(bodies: DataFrame, body: str = "body") -> DataFrame:
    held = bodies.select("*", F.from_json(body, TIMED_COMMENTS).alias("_b"))
    return held.select(*bodies.columns, F.posexplode("_b.comments").alias("position", "_c")).select(*bodies.columns, "position", "_c.text", "_c.timestamp", "_c.authorId")


def request_sentiments(bodies: DataFrame, body: str = "body") -> DataFrame:
    held = bodies.select("*", F.from_json(body, SENTIMENT_ROWS).alias("_b"))
    return held.select(*bodies.columns, F.explode("_b.sentiment_data").alias("_s")).select(*bodies.columns, F.to_timestamp("_s.timestamp").alias("timestamp"), "_s.sentiment")


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt to all cores: one of fewer files than cores, and of no more splits, would leave most of them idle.

    Tables of more files or splits, as large ones are, stay as they are."""
    context = getattr(df.sparkSession, "sparkContext", None)  # a remote session has none
    if context is None:
        return df
    cores = context.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores and df.rdd.getNumPartitions() <= cores else df


def comment_pages(pages: DataFrame, page: str = "page", at_most: int = 500) -> DataFrame:
    """Comments of result pages in order (number, page): pages are taken while fewer than ``at_most`` comments came before, whole.

    The pages that count are among the first ``at_most`` that hold a comment, so a top list of their numbers is summed up
    and met by the pages; no task gathers payloads."""
    parsed = pages.select("number", F.from_json(page, PAGE).alias("p")).select("number", F.col("p.items").alias("items"), F.size("p.items").alias("n"))
    first = parsed.where("n > 0").select("number", "n").orderBy("number").limit(at_most)
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = first.withColumn("_before", before).where(F.col("_before") < at_most).select("number")
    rows = parsed.join(F.broadcast(taken), "number").select("number", F.posexplode("items").alias("position", "i"))
    rows = rows.select("number", "position", F.col("i.snippet.topLevelComment.snippet").alias("s"))
    return rows.select("number", "position", F.col("s.textOriginal").alias("text"), F.to_timestamp("s.publishedAt").alias("timestamp"), author(F.col("s.authorChannelId.value")).alias("authorId"))


def author(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("Unknown"))


def video_id(url: Column) -> Column:
    """The 11 characters of the id, or an empty text."""
    return F.regexp_extract(url, VIDEO_URL, 1)
