"""Exact quantiles, box statistics and bootstrap intervals by counted ranges of values.

Equal values are counted first.  A quantile is the value at a known place of a
class's sorted values, or lies between two.  Each place is searched for in
rounds: the range that holds it is cut into slices, which are counted with
their least and greatest values, and the slice with the place is the next
range, until that is one value or holds few different ones, which are fetched.
What the driver holds is bounded, whatever the number of values; no task holds
more than its slice counts.

Classes have to be few, as they are labels.  Null values don't count; NaN is
the largest value, as Spark sorts it.  A class without values has null results.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.sampling import SEED
from spindrift.sources import scratch

#: Slices of all ranges that are counted in a round, and different values of a range that are fetched at once.
SLICES, FETCHED = 100_000, 4096
#: Repetitions of the bootstrap, eight to a hash.
REPEATS = 96
#: Of 16 hexadecimal bits' 65536 values so many mean up to 0, 1, 2, ... draws of a row: the distribution of Poisson with mean 1.
_POISSON = [round(65536 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(8)]
#: Rows whose draws a task adds up before it hands them on.
DRAWN = 50_000


class Counted:
    """The different values of each class with their counts, kept until :meth:`release`."""

    def __init__(self, df: DataFrame, column: str, by: Iterable[str] = (), weight: Column | None = None):
        self.by, self.spark = list(by), df.sparkSession
        keys = [F.col(c).alias(f"k{j}") for j, c in enumerate(self.by)]
        rows = df.select(*keys, F.col(column).cast("double").alias("x"), (F.lit(1) if weight is None else weight).cast("long").alias("w")).where("x is not null and w > 0")
        self.keys = [f"k{j}" for j in range(len(self.by))]
        self.rows = rows.groupBy(*self.keys, "x").agg(F.sum("w").alias("c")).persist()
        self.classes = [tuple(r[k] for k in self.keys) for r in df.select(*keys).distinct().collect()] if self.by else [()]
        ends = self.rows.groupBy(*self.keys).agg(F.sum("c").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("different")).collect()
        self.ends = {tuple(r[k] for k in self.keys): r for r in ends if r["n"]}

    def release(self) -> None:
        self.rows.unpersist()

    def n(self, of: tuple) -> int:
        return self.ends[of]["n"] if of in self.ends else 0

    def values_at(self, places: dict[tuple, set[int]], slices: int = SLICES, fetched: int = FETCHED) -> dict[tuple, dict[int, float]]:
        """The value at each of a class's ``places``, from 0, in ascending order."""
        out: dict[tuple, dict[int, float]] = {of: {} for of in places}
        # A range: class, least and greatest value, how many rows of the class lie below it, how many different values it has, the places in it.
        open_ = [(of, self.ends[of]["lo"], self.ends[of]["hi"], 0, self.ends[of]["different"], sorted(at)) for of, at in places.items() if at]
        while open_:
            found = [r for r in open_ if _same(r[1], r[2])]
            for of, lo, _, _, _, at in found:
                out[of] |= dict.fromkeys(at, lo)
            few = [r for r in open_ if not _same(r[1], r[2]) and r[4] <= fetched]
            large = [r for r in open_ if not _same(r[1], r[2]) and r[4] > fetched]
            for part in _portions(few, fetched * 16):
                held: dict[int, list] = {}
                for r in self._in_ranges(part).select("_r", "x", "c").collect():
                    held.setdefault(r["_r"], []).append((r["x"], r["c"]))
                for k, (of, _, _, before, _, at) in enumerate(part):
                    out[of] |= _pick(sorted(held[k], key=lambda v: (math.isnan(v[0]), v[0])), before, at)
            open_ = self._narrowed(large, max(16, slices // max(1, len(large)))) if large else []
        return out

    def _in_ranges(self, ranges: list[tuple]) -> DataFrame:
        """Rows with the number of their range; there are few ranges, so they are sent to all tasks."""
        kinds = [f"{k}_ {self.rows.schema[k].dataType.simpleString()}" for k in self.keys]
        held = self.spark.createDataFrame([(k, *r[0], float(r[1]), float(r[2])) for k, r in enumerate(ranges)], ", ".join(["_r int", *kinds, "_lo double", "_hi double"]))
        same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in self.keys]
        return self.rows.join(F.broadcast(held), [*same, F.col("x") >= F.col("_lo"), F.col("x") <= F.col("_hi")])

    def _narrowed(self, ranges: list[tuple], slices: int) -> list[tuple]:
        x, lo, hi = F.col("x"), F.col("_lo"), F.col("_hi")
        # Halves first, as the whole width may be too large for a double; infinite ends have slices of their own.
        share = (x / 2 - lo / 2) / (hi / 2 - lo / 2)
        at = F.when(F.isnan(x), slices + 2).when(x == float("inf"), slices + 1).when(x == float("-inf"), -1)
        inner = F.when(F.isnan(share) | (F.abs(share) == float("inf")), F.lit(slices) * (F.atan(x) / math.pi + 0.5)).otherwise(share * (slices - 1))
        counted = self._in_ranges(ranges).withColumn("_s", F.coalesce(at, F.floor(inner).cast("int"))).groupBy("_r", "_s").agg(F.sum("c").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("different")).collect()
        by_range: dict[int, list] = {}
        for r in counted:
            by_range.setdefault(r["_r"], []).append(r)
        out = []
        for k, (of, _, _, before, _, at_) in enumerate(ranges):
            for r in sorted(by_range[k], key=lambda r: r["_s"]):
                inside = [p for p in at_ if before <= p < before + r["n"]]
                if inside:
                    out.append((of, r["lo"], r["hi"], before, r["different"], inside))
                before += r["n"]
        return out

    def quantiles(self, shares: list[float], **how) -> dict[tuple, list[float | None]]:
        """For each class the quantiles, between two values in proportion to the distances."""
        spots = {of: [s * (self.n(of) - 1) for s in shares] for of in self.ends if self.n(of)}
        held = self.values_at({of: {p for s in at for p in (math.floor(s), math.ceil(s))} for of, at in spots.items()}, **how)
        out: dict[tuple, list[float | None]] = {of: [None] * len(shares) for of in self.classes}
        for of, at in spots.items():
            lower, upper = [held[of][math.floor(s)] for s in at], [held[of][math.ceil(s)] for s in at]
            out[of] = [a if a == b else (math.ceil(s) - s) * a + (s - math.floor(s)) * b for s, a, b in zip(at, lower, upper, strict=True)]
        return out


def _same(a: float, b: float) -> bool:
    return a == b or (math.isnan(a) and math.isnan(b))


def _portions(ranges: list[tuple], most: int):
    """Ranges in portions of at most so many different values."""
    held, size = [], 0
    for r in ranges:
        if held and size + r[4] > most:
            yield held
            held, size = [], 0
        held.append(r)
        size += r[4]
    if held:
        yield held


def _pick(values: list[tuple[float, int]], before: int, places: list[int]) -> dict[int, float]:
    out, at = {}, iter(places)
    want = next(at, None)
    for x, c in values:
        while want is not None and want < before + c:
            out[want] = x
            want = next(at, None)
        before += c
    return out


def _kind(df: DataFrame, by: list[str]) -> list[str]:
    return [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by]


def quantiles(df: DataFrame, column: str, shares: list[float], by: list[str] = (), names: list[str] | None = None) -> DataFrame:
    """A row for each class with a column for each quantile."""
    held = Counted(df, column, by)
    rows = [(*of, *q) for of, q in held.quantiles(list(shares)).items()]
    held.release()
    names = names or [f"q{k}" for k in range(len(shares))]
    return df.sparkSession.createDataFrame(rows, ", ".join([*_kind(df, list(by)), *[f"{n} double" for n in names]]))


def describe(df: DataFrame, column: str) -> DataFrame:
    """n, mean, std, min, p25, p50, p75, max; the values are read once, what follows needs the different ones alone."""
    held = Counted(df, column)
    rows, q = held.rows, held.quantiles([0.25, 0.5, 0.75])[()]
    mean = rows.agg((F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("m")).first()["m"]
    off = F.col("x") - F.lit(mean)
    std = rows.agg(F.sqrt(F.sum(F.col("c") * off * off) / F.nullif(F.sum("c") - 1, F.lit(0))).alias("s")).first()["s"]
    end = held.ends.get(())
    held.release()
    kind = df.schema[column].dataType.simpleString()
    row = (held.n(()), mean, std, end and end["lo"], *q, end and end["hi"])
    out = df.sparkSession.createDataFrame([row], "n long, mean double, std double, min double, p25 double, p50 double, p75 double, max double")
    return out.withColumns({c: F.col(c).cast(kind) for c in ("min", "max")})


def box(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Quartiles, whiskers (the extremes within 1.5 interquartile ranges) and the number of outliers."""
    held = Counted(df, column, [by] if by else [])
    found = {of: q for of, q in held.quantiles([0.25, 0.5, 0.75]).items() if q[0] is not None}
    kind = [f"{k} {held.rows.schema[k].dataType.simpleString()}" for k in held.keys]
    bounds = df.sparkSession.createDataFrame([(*of, *q) for of, q in found.items()], ", ".join([*[f"{k.split()[0]}_ {k.split()[1]}" for k in kind], "q1 double", "q2 double", "q3 double"]))
    x, gap = F.col("x"), 1.5 * (F.col("q3") - F.col("q1"))
    inside = (x >= F.col("q1") - gap) & (x <= F.col("q3") + gap)
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in held.keys]
    met = held.rows.join(F.broadcast(bounds), same) if same else held.rows.crossJoin(F.broadcast(bounds))
    out = met.groupBy(*held.keys, "q1", "q2", "q3").agg(F.min(F.when(inside, x)).alias("low"), F.max(F.when(inside, x)).alias("high"), F.coalesce(F.sum(F.when(~inside, F.col("c"))), F.lit(0)).alias("outliers"))
    own = df.schema[column].dataType
    keys = [F.col("k0").alias(by)] if by else []
    rows = out.select(*keys, "q1", "q2", "q3", F.col("low").cast(own).alias("low"), F.col("high").cast(own).alias("high"), "outliers")
    result = df.sparkSession.createDataFrame(rows.collect(), rows.schema)  # a row for each class
    held.release()
    return result


def _digits(key: str, seed: int) -> Column:
    """Four hexadecimal digits for each repetition, by a row's key."""
    return F.concat(*[F.md5(F.concat_ws("|", F.lit(f"{seed}draw{j}"), F.col(key).cast("string"))) for j in range(REPEATS // 8)])


def drawn(df: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """``df`` with ``r`` and ``w``: a row for each of REPEATS repetitions in which a row is drawn, ``w`` times, as hashes of its key say."""
    each = df.withColumn("_digits", _digits(key, seed)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
    h = F.conv(F.substring(F.col("_digits"), F.col("r") * 4 + 1, F.lit(4)), 16, 10).cast("int")
    of = F.transform(F.array(h), lambda x: sum((F.when(x >= bound, 1).otherwise(0) for bound in _POISSON), F.lit(0)))
    return each.withColumn("w", F.get(of, F.lit(0))).drop("_digits").where("w > 0")


def drawn_values(df: DataFrame, key: str, by: str, column: str, seed: int = SEED, most: int = DRAWN) -> DataFrame:
    """(of, x, r, w): how often each value of a class is drawn in each repetition, in parts that have to be added up.

    The draws are those of :func:`drawn`; a task adds those of up to ``most`` rows up before they become rows."""
    times = np.searchsorted(_POISSON, np.arange(1 << 16), "right").astype(np.uint8)

    def added(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        of = pa.concat_arrays(table["of"].chunks).dictionary_encode(null_encoding="encode")
        values, value = np.unique(table["x"].to_numpy(), return_inverse=True)
        groups, group = np.unique(of.indices.to_numpy() * np.int64(len(values)) + value, return_inverse=True)
        w = times[np.frombuffer(b"".join(table["bits"].to_pylist()), ">u2")].reshape(-1, REPEATS)[np.argsort(group, kind="stable")]
        sums = np.add.reduceat(w, np.r_[0, np.cumsum(np.bincount(group))[:-1]], axis=0, dtype=np.int64)
        lists = pa.ListArray.from_arrays(np.arange(len(groups) + 1, dtype=np.int32) * REPEATS, pa.array(sums.ravel()))
        return pa.RecordBatch.from_arrays([of.dictionary.take(pa.array(groups // len(values))), pa.array(values[groups % len(values)]), lists], names=["of", "x", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield added(held)
                held, n = [], 0
        if n:
            yield added(held)

    rows = df.where(F.col(column).isNotNull()).select(F.col(by).alias("of"), F.col(column).cast("double").alias("x"), F.unhex(_digits(key, seed)).alias("bits"))
    made = rows.mapInArrow(run, f"of {df.schema[by].dataType.simpleString()}, x double, w array<bigint>")
    return made.select("of", "x", F.posexplode("w").alias("r", "w"))


def median_interval(df: DataFrame, key: str, by: str, column: str, level: float = 0.95, seed: int = SEED) -> DataFrame:
    """(class, median, low, high): medians with bootstrap intervals, each row drawn as its key's hashes say, all repetitions in one pass."""
    df = scratch.table(df.select(*dict.fromkeys((key, by, column))), "valued")
    one = Counted(df, column, [by])
    medians = {of: q[0] for of, q in one.quantiles([0.5]).items()}
    one.release()
    many = Counted(drawn_values(df, key, by, column, seed), "x", ["of", "r"], F.col("w"))
    by_class: dict[tuple, list[float]] = {}
    for of, q in many.quantiles([0.5]).items():
        by_class.setdefault(of[:1], []).append(q[0])
    many.release()

    def at(values: list[float], share: float) -> float | None:
        if not values:
            return None
        values, s = sorted(values), share * (len(values) - 1)
        a, b = values[math.floor(s)], values[math.ceil(s)]
        return a if a == b else (math.ceil(s) - s) * a + (s - math.floor(s)) * b

    rows = [(*of, m, at(by_class.get(of, []), (1 - level) / 2), at(by_class.get(of, []), (1 + level) / 2)) for of, m in medians.items()]
    return df.sparkSession.createDataFrame(rows, f"`{by}` {df.schema[by].dataType.simpleString()}, median double, low double, high double")


def automatic_bins(df: DataFrame, column: str) -> DataFrame:
    """(bin, low, high, n) of a histogram with bins of automatic width: the smaller of twice the interquartile range over the cube root
    of the count, if there is such a range, and the range over one plus the binary logarithm of the count.

    The last bin holds its upper end; empty bins are there too; one value is one bin."""
    held = Counted(df, column)
    spark, n = df.sparkSession, held.n(())
    schema = "bin int, low double, high double, n long"
    if not n:
        held.release()
        return spark.createDataFrame([], schema)
    q1, q3 = held.quantiles([0.25, 0.75])[()]
    lo, hi = held.ends[()]["lo"], held.ends[()]["hi"]
    by_range, by_count = 2 * (q3 - q1) / n ** (1 / 3), (hi - lo) / (math.log2(n) + 1)
    width = min(by_range, by_count) if by_range > 0 else by_count
    bins = max(1, math.ceil((hi - lo) / width)) if width > 0 else 1
    place = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(hi - lo) * bins).cast("int"), F.lit(bins - 1)) if hi > lo else F.lit(0)
    counted = held.rows.groupBy(place.alias("b")).agg(F.sum("c").alias("c")).collect()  # a row for each bin
    held.release()
    found = {r["b"]: r["c"] for r in counted}
    return spark.createDataFrame([(b, lo + b * (hi - lo) / bins, lo + (b + 1) * (hi - lo) / bins, found.get(b, 0)) for b in range(bins)], schema)
