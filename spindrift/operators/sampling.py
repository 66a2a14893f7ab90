"""Splits, weights and resampling that give the same rows on every run and cluster."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.nearest import neighbours
from spindrift.sources import scratch

SEED = 42


def draw(key: str, seed: int = SEED, salt: str = "") -> Column:
    """A hash that orders rows at random, but always alike; a null key has that of an empty text."""
    return F.md5(F.concat(F.lit(f"{seed}|{salt}|"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a hash."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("double") / float(16**13)


#: Slices of the hash in which rows are counted: three hexadecimal digits.
_SLICE = 3


def _parts(by: list[str]):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))


def cut(df: DataFrame, key: str, by: list[str], wanted: Callable[[Column], Column], seed: int = SEED) -> DataFrame:
    """``df`` with ``_chosen``: whether a row is among the first ``wanted`` ones of its class, in the order of its key's hash.

    ``wanted`` makes that number from ``_total``, the rows of the class, and may use windows over the classes, of which there are few.
    Rows are counted in 4096 slices of the hash; only the slice in which a class reaches its number is put in order, to find the
    last chosen hash, which is broadcast, one for each class.  So neither rows nor their keys are shuffled, but for that slice."""
    h = df.withColumns({"_h": draw(key, seed), "_key": F.col(key)})
    sliced = h.select(*by, "_key", "_h", F.substring("_h", 1, _SLICE).alias("_slice"))
    sizes = sliced.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(_parts(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*by, "_slice", "_c", before.alias("_before"), F.sum("_c").over(_parts(by)).alias("_total"))
    aims = sizes.groupBy(*by, "_total").agg(F.lit(1).alias("_one")).withColumn("_want", wanted(F.col("_total")).cast("long")).drop("_one", "_total")
    named = lambda t: t.withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = lambda on: [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by] or [on]
    ends = sizes.join(F.broadcast(named(aims)), same(F.lit(True))).where("_before < _want and _want <= _before + _c")
    ends = ends.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_slice").alias("_s"), F.col("_want") - F.col("_before"))
    ends = ends.toDF(*[f"_by_{c}" for c in by], "_s", "_nth")
    near = sliced.join(F.broadcast(ends), [F.col("_slice") == F.col("_s"), *(F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by)])
    at = F.row_number().over(_parts(by).orderBy("_h", "_key"))
    last = near.withColumn("_at", at).where("_at = _nth").select(*[F.col(f"_by_{c}") for c in by], F.struct("_h", "_key").alias("_last"))
    out = h.join(F.broadcast(last), same(F.lit(True)), "left")
    chosen = F.coalesce(F.struct("_h", "_key") <= F.col("_last"), F.lit(False))
    return out.withColumn("_chosen", chosen).drop("_h", "_key", "_last", *[f"_by_{c}" for c in by])


def split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = SEED, stratify: str | None = None) -> DataFrame:
    """``df`` with a column ``is_test``; with ``stratify``, that share of each class.  Rows with the same key fall on the same side."""
    share = F.lit(test_size).cast("decimal(10,6)")
    return cut(df, key, [stratify] if stratify else [], lambda n: F.ceil(n * share), seed).withColumnRenamed("_chosen", "is_test")


def train_test(df: DataFrame, key: str, **how) -> tuple[DataFrame, DataFrame]:
    out = split(df, key, **how)
    return out.where("not is_test").drop("is_test"), out.where("is_test").drop("is_test")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): all rows over classes times the rows of the class."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    everything = Window.partitionBy(F.lit(1))  # a row for each class
    return n.select(label, (F.sum("_n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("_n"))).alias("weight"))


def with_weights(df: DataFrame, label: str) -> DataFrame:
    return df.join(F.broadcast(class_weights(df, label)), label)


def undersample(df: DataFrame, key: str, label: str, seed: int = SEED) -> DataFrame:
    """As many rows of each class as the smallest has."""
    return cut(df, key, [label], lambda n: F.min(n).over(Window.partitionBy(F.lit(1))), seed).where("_chosen").drop("_chosen")


def _synthetic(points: DataFrame, wanted: DataFrame, near: DataFrame, key: str, features: str, label: str, seed: int) -> DataFrame:
    """``wanted``: (key, times).  Each new row lies between its seed row and one of that row's neighbours."""
    base = wanted.join(points.select(key, features, label), key).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    known = near.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))), lambda x: x["neighbour"]).alias("_near"))
    picked = base.join(known, key).withColumn("_pick", F.get("_near", F.floor(uniform(F.lit(f"{seed}pick"), F.col(key), F.col("_i")) * F.size("_near")).cast("int")))
    other = points.select(F.col(key).alias("_pick"), F.col(features).alias("_other"))
    # A column of its own, as the select below gives the key's name to nulls.
    met = picked.withColumn("_u", uniform(F.lit(f"{seed}u"), F.col(key), F.col("_i"))).join(other, "_pick")
    return met.select(F.lit(None).cast("long").alias(key), F.zip_with(features, "_other", lambda a, b: a + F.col("_u") * (b - a)).alias(features), label)


def smote(df: DataFrame, key: str, features: str, label: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """The rows, and synthetic ones (null keys) until every class has as many as the largest."""
    points = df.select(key, F.col(features).cast("array<double>").alias(features), label)
    counts = points.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).withColumn("_gap", F.max("_n").over(Window.partitionBy(F.lit(1))) - F.col("_n"))
    # Every row of a class gives as many new ones as go evenly; the first rows in hash order give one more.
    gap = F.max(F.col("_total")).over(Window.partitionBy(F.lit(1))) - F.col("_total")
    more = cut(points.select(key, label), key, [label], lambda n: gap % n, seed)
    times = F.floor(F.col("_gap") / F.col("_n")) + F.col("_chosen").cast("long")
    wanted = more.join(F.broadcast(counts), label).select(key, times.alias("times")).where("times > 0")
    # Only rows that give new ones need neighbours.
    asked = points.join(wanted.select(key), key, "left_semi")
    return points.unionByName(_synthetic(points, wanted, neighbours(points, asked, key, features, k, label), key, features, label, seed))


def adasyn(df: DataFrame, key: str, features: str, label: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """As ``smote``, with more synthetic rows where neighbours of other classes prevail."""
    points = df.select(key, F.col(features).cast("array<double>").alias(features), label)
    labels = points.select(F.col(key).alias("neighbour"), F.col(label).alias("_other"))
    hard = neighbours(points, points, key, features, k).join(labels, "neighbour").join(points.select(key, label), key)
    hard = hard.groupBy(key, label).agg(F.count_if(F.col("_other") != F.col(label)).alias("_hard"))  # whole numbers, so that sums don't depend on their order
    counts = points.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    most = counts.agg(F.max("_n").alias("_most"))
    share = Window.partitionBy(label)
    weighed = hard.join(F.broadcast(counts), label).crossJoin(F.broadcast(most))
    whole = F.sum("_hard").over(share)
    times = F.round(F.when(whole > 0, F.col("_hard") / whole).otherwise(1 / F.col("_n")) * (F.col("_most") - F.col("_n")))
    wanted = scratch.table(weighed.select(key, times.alias("times")).where("times > 0"), "wanted")
    # Only rows that give new ones need neighbours of their class.
    asked = points.join(wanted.select(key), key, "left_semi")
    return points.unionByName(_synthetic(points, wanted, neighbours(points, asked, key, features, k, label), key, features, label, seed))


def edited(df: DataFrame, key: str, features: str, label: str, k: int = 3) -> DataFrame:
    """Rows whose k nearest neighbours mostly have their own class."""
    labels = df.select(F.col(key).alias("neighbour"), F.col(label).alias("_other"))
    near = neighbours(df, df, key, features, k).join(labels, "neighbour").join(df.select(key, label), key)
    agree = near.groupBy(key).agg(F.sum((F.col("_other") == F.col(label)).cast("int")).alias("_agree"), F.count(F.lit(1)).alias("_k"))
    return df.join(agree.where("2 * _agree >= _k").select(key), key, "left_semi")


def smote_enn(df: DataFrame, key: str, features: str, label: str, seed: int = SEED) -> DataFrame:
    grown = smote(df, key, features, label, seed=seed)
    named = grown.withColumn(key, F.coalesce(F.col(key), -F.abs(F.xxhash64(features, label)) - 1))
    return edited(named, key, features, label)


#: Ways to even out classes.
METHODS = {
    "class_weights": lambda df, key, features, label: with_weights(df, label), "oversampling": smote, "adasyn": adasyn,
    "undersampling": lambda df, key, features, label: undersample(df, key, label), "smote_enn": smote_enn,
}


def resample(df: DataFrame, method: str, key: str, features: str, label: str) -> DataFrame:
    """By one of METHODS.  For training rows only."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; there are {', '.join(METHODS)}")
    return METHODS[method](df, key, features, label)


def random_rows(df: DataFrame, n: int, key: str, seed: int = SEED) -> DataFrame:
    return df.orderBy(draw(key, seed, "sample"), key).limit(n)
