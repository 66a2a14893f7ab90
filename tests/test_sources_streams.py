"""Paged comments, streams that go on from a checkpoint, ranges of uneven numbers, cuts of one term table."""

import json
import os
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from spindrift.operators import features, kpi, models, stats
from spindrift.sources import pages, scratch
from spindrift.streaming import monthly


def item(text, author="a", at="2024-01-02T03:04:05Z"):
    s = {"textOriginal": text, "publishedAt": at}
    return {"snippet": {"topLevelComment": {"snippet": s | ({"authorChannelId": {"value": author}} if author is not None else {})}}}


def test_pages_are_followed_and_taken_whole(spark, tmp_path):
    """Two threads; one ends at the limit between pages, one where no page is named; a page that is missing ends a thread."""
    threads = {
        "long": {"0": ([item(f"a{k}") for k in range(4)], "x/1"), "x/1": ([item("b", None), item("c", "")], "y"), "y": ([item("d")], "z"), "z": ([item("never")], None)},
        "short": {"0": ([item("e", at=None)], None), "other": ([item("never")], None)}, "broken": {"0": ([], "gone")},
    }
    for thread, held in threads.items():
        for token, (items, following) in held.items():
            at = tmp_path / thread / f"token={token.replace('/', '%2F')}"
            at.mkdir(parents=True)
            (at / "part-0.txt").write_text(json.dumps({"items": items} | ({"nextPageToken": following} if following else {})))
            (at / "_SUCCESS").write_text("")
    pages.register(spark)
    read = lambda n: spark.read.format("comment_pages").option("path", f"file://{tmp_path}").option("at_most", n).load()
    got = read(6)
    assert got.schema.simpleString() == spark.createDataFrame([], pages.SCHEMA).schema.simpleString() and got.rdd.getNumPartitions() == 3
    rows = sorted((r.thread, r.token, r.position, r.text, r.authorId) for r in got.collect())
    assert rows == [("long", "0", k, f"a{k}", "a") for k in range(4)] + [("long", "x/1", 0, "b", "Unknown"), ("long", "x/1", 1, "c", "Unknown"), ("short", "0", 0, "e", "a")]
    assert read(7).where("text = 'd'").count() == 1 and read(7).where("text = 'never'").count() == 0 and read(8).where("text = 'never'").count() == 1
    assert got.where("text = 'a0'").select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).first()[0] == "2024-01-02 03:04:05"


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Counts equal the batch's after a restart; rows that come too late are left out; a call without new rows changes nothing."""
    schema = "timestamp timestamp_ntz, sentiment int"
    rows = [(f"2024-0{1 + k // 60}-{1 + k // 3 % 20:02d} 12:00:00", k % 3 - 1) for k in range(180)]
    df = spark.createDataFrame(rows, "timestamp string, sentiment int").select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "sentiment")
    places = [f"file://{tmp_path}/{n}" for n in ("in", "checkpoint", "out")]
    batch = lambda d: sorted(tuple(r) for r in kpi.trend(d, "timestamp", "sentiment").select("period", "negative", "neutral", "positive").collect())
    got = lambda: sorted(tuple(r) for r in monthly.months(spark, places[2]).collect())
    for a, b in pairwise([0, 70, 71, 180]):
        part = spark.createDataFrame(rows[a:b], "timestamp string, sentiment int").select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "sentiment")
        part.coalesce(1).write.mode("append").parquet(places[0])
        monthly.advance(spark, places[0], schema, *places[1:])
    assert got() == batch(df)
    monthly.advance(spark, places[0], schema, *places[1:])
    assert got() == batch(df)
    df.limit(1).coalesce(1).write.mode("append").parquet(places[0])  # months behind the watermark
    monthly.advance(spark, places[0], schema, *places[1:])
    assert got() == batch(df)


def test_uneven_numbers_are_dealt_evenly(spark):
    """Ids of 1 to 1000 and one of 10**15, and null ones: starts are right, and no range holds more than a few rows."""
    rows = [(k, 0, "x" * (k % 5)) for k in range(1, 1001)] + [(10**15, 0, "last"), (None, 3, "first"), (5, 1, None), (7, None, "n"), (7, None, "m")]
    df = spark.createDataFrame(rows, "a long, b long, t string")
    got = stats.concatenated(df, "t", "a", "b", ranges=64).collect()
    least = lambda v: -1 if v is None else v
    at, want = 0, []
    for a, b, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (least(r[0]), least(r[1]), r[2])):
        want.append((a, b, t, at))
        at += len(t) + 1
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    held = df.where("t is not null")
    sizes = held.groupBy(stats._ranges(held, "a", "b", 64)(F.col("a"), F.col("b"))).count().collect()
    assert len(sizes) > 40 and max(r["count"] for r in sizes) < 130


def test_vocabularies_are_cuts_of_one_table(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["aa bb aa cc", "bb cc dd aa", "dd", None, "aa bb"])], "id long, t string")
    ranked = features.ranked_terms(df, "t", 3)
    for hi in (1, 2, 3):
        for n in (2, 5, 100):
            for tfidf in (True, False):
                own, cut = features.Vectorizer(n, (1, hi), tfidf).fit(df, "t"), features.Vectorizer(n, (1, hi), tfidf).of_terms(features.first_terms(ranked, hi, 100), 5)
                assert own.feature_names() == cut.feature_names()
                assert own.transform(df, "t").orderBy("id").collect() == cut.transform(df, "t").orderBy("id").collect()
    with pytest.raises(ValueError, match="single words"):
        models.sweep(df.withColumn("category", F.lit(1)), "id", "t", [{"max_features": 5, "ngram_range": (2, 2)}], models.Params())


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    class Elsewhere:
        conf = type("C", (), {"get": lambda self, *a: None})()
        sparkContext = type("S", (), {"getConf": lambda self: type("C", (), {"get": lambda self, *a: None})(), "master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.root(Elsewhere())
    assert not os.path.exists(scratch.place(spark, "x").removeprefix("file://"))
