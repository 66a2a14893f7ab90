"""Connected components of links that stay distributed: large-star and small-star steps until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import stage


def _least(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour; summed up before the shuffle, so a hub is no hot key."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_least(both), F.col("u") == F.col("_u"))
    return joined.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_least(down), F.col("u") == F.col("_u"))
    return joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges``: u, v.  A row (node, component) for each node of an edge; the component is its smallest node."""
    now = stage(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct(), "links")
    mark = None
    while True:
        now = stage(_small_star(_large_star(now)), "star")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))
