"""Features of rolling windows: counts, sums, distinct kinds and order statistics, by offline divide and conquer on values.

A row has a group, a time in whole seconds, a value and a kind.  Its window of
``width`` seconds holds the rows of its group with a time from ``width``
seconds before its own up to, but not including, its own.  All rows of one time
have the same windows, so windows are asked once for each (group, time), and
rows that agree in group, time, value and kind are counted before they travel.

Time is cut into spans of the largest width.  A window that ends in a span lies
in it and the one before, so each span gets the rows of both, and spans are
worked on independently, however many rows a group has.  Counts and sums are
differences of running totals, of which a span has one for each second.  For
distinct kinds, a kind's occurrence holds from the second after it until the
next occurrence, but no longer than the width: only the ends of these intervals
travel, summed up for each second.

Order statistics are found for all windows of a span at once.  The range of
values is halved; running counts of the lower half tell how many values of a
window lie there, so each window goes to the half that holds its rank, in the
upper half with what remains of it, and the halves are split again, until a
range is one value.  Spans whose rows are too many for a task are halved in
Spark: what a halving needs are counts for each second, of which a span has a
bounded number, and the halves are then tasks of their own.  What fits is
halved within a task, all ranges of one depth in one array operation.

Defined results: a null group is a group; a null value counts as a row, but has
no place among the values; a null kind is no kind; rows without a time are in
no window, and their own windows hold nothing; windows without values have null
order statistics; rows that repeat count as often as they occur; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import skew_join, stage

#: Different (time, value) pairs that a task takes; spans with more are halved in Spark.
TASK_ROWS = 500_000
_POINT = "node string, grp string, span long, lo long, hi long, time long, value long, times long"
_QUERY = "node string, grp string, span long, lo long, hi long, time long, width int, nth int, rank long"


def select(time: np.ndarray, value: np.ndarray, times: np.ndarray, start: np.ndarray, stop: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The value of each window [start, stop) of times that is number ``rank`` from 1, where ``value`` counts ``times`` times.

    The different values are halved again and again.  Rows of a half stay in order of time, and the lower halves
    of all ranges lie before the upper ones, so that a window stays a stretch of rows."""
    order = np.argsort(time, kind="stable")
    known, code = np.unique(value[order], return_inverse=True)
    weight = times[order].astype(np.int64)
    a, b = np.searchsorted(time[order], start), np.searchsorted(time[order], stop)
    rank, found = rank.astype(np.int64).copy(), np.zeros(len(rank), np.int64)
    for depth in reversed(range(int(len(known) - 1).bit_length())):
        lower = (code >> depth) & 1 == 0
        place, before = np.r_[0, np.cumsum(lower)], np.r_[0, np.cumsum(weight * lower)]
        held = before[b] - before[a]
        down = rank <= held
        rank -= np.where(down, 0, held)
        found |= np.where(down, 0, 1 << depth)
        a, b = (np.where(down, place[x], place[-1] + x - place[x]) for x in (a, b))
        code, weight = (np.r_[x[lower], x[~lower]] for x in (code, weight))
    return known[found]


def _floored(column: str, by: int) -> Column:
    """The whole number of times that ``by`` goes into a column of whole numbers, rounded down."""
    return F.expr(f"{column} div {by}L - if({column} % {by}L < 0, 1L, 0L)")


def _named(group: Column) -> Column:
    """A text for each group, null among them."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def _node() -> Column:
    return F.concat_ws("|", "span", "lo", "hi", "grp")


def _in_spans(df: DataFrame, width: int) -> DataFrame:
    """Each row in the span of its time and in the one after."""
    own = _floored("time", width)
    return df.withColumn("span", F.explode(F.array(own, own + 1)))


def _early(times: np.ndarray, width: int) -> np.ndarray:
    return np.maximum(times, np.iinfo(np.int64).min + width) - width


def _kind_ends(cells: DataFrame, widths: list[int]) -> DataFrame:
    """(grp, span, width, time, change): by how much the number of kinds changes for windows that end after ``time``."""
    seen = _in_spans(cells.where("kind is not null").select("grp", "time", "kind").distinct(), max(widths))
    following = seen.withColumn("_next", F.lead("time").over(Window.partitionBy("grp", "span", "kind").orderBy("time")))
    ends = [F.struct(F.lit(w).alias("width"), F.col("time").alias("time"), F.lit(1).alias("change")) for w in widths]
    ends += [F.struct(F.lit(w).alias("width"), F.least(F.try_add("time", F.lit(w).cast("long")), "_next").alias("time"), F.lit(-1).alias("change")) for w in widths]
    rows = following.select("grp", "span", F.explode(F.array(*ends)).alias("e")).select("grp", "span", "e.*").where("time is not null")
    return rows.groupBy("grp", "span", "width", "time").agg(F.sum("change").alias("change"))


def _windows(cells: DataFrame, widths: list[int]) -> DataFrame:
    """(grp, span, time, width, n_events, total, n_kinds, n_values) for each group and time."""
    some = F.col("value").isNotNull()
    sums = cells.groupBy("grp", "time").agg(F.sum("times").alias("n"), F.coalesce(F.sum(F.when(some, F.col("value") * F.col("times"))), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(some, F.col("times"))), F.lit(0)).alias("m"))
    rows = _in_spans(sums, max(widths)).withColumns({"width": F.lit(0), "change": F.lit(0).cast("long")})
    names = ["grp", "span", "time", "width", "n", "total", "m", "change"]
    ends = _kind_ends(cells, widths).withColumns({c: F.lit(0).cast("long") for c in ("n", "total", "m")})
    largest = max(widths)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held = pdf[pdf.width == 0].sort_values("time")
        time = held.time.to_numpy()
        asked = time[time // largest == pdf.span.iloc[0]]
        add = lambda x: np.r_[0, np.cumsum(x.to_numpy())]
        n, total, m = add(held.n), add(held.total), add(held.m)
        out = []
        for width in widths:
            own = pdf[pdf.width == width].sort_values("time")
            kinds = add(own.change)[np.searchsorted(own.time.to_numpy(), asked)]
            a, b = np.searchsorted(time, _early(asked, width)), np.searchsorted(time, asked)
            out.append(pd.DataFrame({"grp": pdf.grp.iloc[0], "span": pdf.span.iloc[0], "time": asked, "width": width, "n_events": n[b] - n[a], "total": total[b] - total[a], "n_kinds": kinds, "n_values": m[b] - m[a]}))
        return pd.concat(out)

    schema = "grp string, span long, time long, width int, n_events long, total long, n_kinds long, n_values long"
    return rows.select(*names).unionByName(ends.select(*names)).groupBy("grp", "span").applyInPandas(run, schema)


def _halved(points: DataFrame, queries: DataFrame, sizes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Ranges of more than ``most`` points in two halves each, with their windows in the half that holds the rank; the others as they are."""
    big = stage(sizes.where(f"n > {most} and lo < hi").select("node", "n"), "large-ranges")
    middle = F.expr("lo + (hi - lo) div 2L")
    met = stage(skew_join(points, big, "node", F.col("n"), points.count()), "points")
    upper = met.where("n is not null").withColumn("_upper", F.col("value") > middle)
    below = upper.where("not _upper").groupBy("node", "time").agg(F.sum("times").alias("times"))
    names = queries.columns
    asked = queries.join(big.select("node", F.lit(True).alias("_big")), "node", "left")
    moved = asked.where("_big").drop("_big")
    none = {c: F.lit(None).cast(t) for c, t in (f.split() for f in _QUERY.split(", ")) if c not in ("node", "time")}
    both = below.withColumns(none).select("times", *names).unionByName(moved.withColumn("times", F.lit(0).cast("long")).select("times", *names))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        counts, q = pdf[pdf.nth.isna()].sort_values("time"), pdf[pdf.nth.notna()].copy()
        time, before = counts.time.to_numpy(), np.r_[0, np.cumsum(counts.times.to_numpy())]
        stop, rank = q.time.to_numpy(np.int64), q["rank"].to_numpy(np.int64)
        start = np.maximum(stop, np.iinfo(np.int64).min + q.width.to_numpy(np.int64)) - q.width.to_numpy(np.int64)
        held = before[np.searchsorted(time, stop)] - before[np.searchsorted(time, start)]
        q["rank"] = np.where(rank <= held, rank, rank - held)
        q["node"] = np.where(rank <= held, "lower", "upper")
        return q[names]

    routed = both.groupBy("node").applyInPandas(run, _QUERY)
    half = lambda down: {"hi": F.when(down, middle).otherwise(F.col("hi")), "lo": F.when(down, F.col("lo")).otherwise(middle + 1)}
    renamed = lambda df, down: df.withColumns(half(down)).withColumn("node", _node())
    points = renamed(upper, ~F.col("_upper")).select(*points.columns).unionByName(met.where("n is null").select(*points.columns))
    queries = renamed(routed, F.col("node") == "lower").unionByName(asked.where("_big is null").drop("_big").select(*names))
    return stage(points, "points"), stage(queries, "windows")


def _ranked(cells: DataFrame, windows: DataFrame, largest: int, shares: list[tuple[int, int]], most: int) -> DataFrame:
    """(grp, time, width, nth, found): the value of each rank of each window."""
    ends = cells.agg(F.min("value"), F.max("value")).first()
    bounds = {"lo": F.lit(ends[0] or 0).cast("long"), "hi": F.lit(ends[1] or 0).cast("long")}
    points = cells.where("value is not null").groupBy("grp", "time", "value").agg(F.sum("times").alias("times"))
    points = _in_spans(points, largest).withColumns(bounds).withColumn("node", _node()).select(*[f.split()[0] for f in _POINT.split(", ")])
    ranks = F.array(*[F.expr(f"(n_values * {p}L + {q - 1}L) div {q}L") for p, q in shares])
    queries = windows.where("n_values > 0").select("grp", "span", "time", "width", F.posexplode(ranks).alias("nth", "rank")).withColumns(bounds).withColumn("node", _node())
    queries = queries.select(*[f.split()[0] for f in _QUERY.split(", ")])
    points = stage(points, "points")
    while True:
        sizes = points.groupBy("node", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
        if (sizes.where("lo < hi").agg(F.max("n")).first()[0] or 0) <= most:
            break
        points, queries = _halved(points, queries, sizes, most)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, p = pdf[pdf.times == 0], pdf[pdf.times > 0]
        stop, width = q.time.to_numpy(), q.width.to_numpy(np.int64)
        start = np.maximum(stop, np.iinfo(np.int64).min + width) - width
        found = select(p.time.to_numpy(), p.value.to_numpy(), p.times.to_numpy(), start, stop, q["rank"].to_numpy()) if len(q) else np.empty(0, np.int64)
        return pd.DataFrame({"grp": q.grp, "time": stop, "width": q.width, "nth": q.nth, "found": found})

    number = lambda **to: {c: F.lit(0).cast(t) for c, t in to.items()}
    names = ["node", "grp", "time", "value", "times", "width", "nth", "rank"]
    a = points.withColumns(number(width="int", nth="int", rank="long")).select(*names)
    b = queries.withColumns(number(value="long", times="long")).select(*names)
    return a.unionByName(b).groupBy("node").applyInPandas(run, "grp string, time long, width int, nth int, found long")


def rolling(rows: DataFrame, widths: list[int], shares: list[tuple[int, int]], task_rows: int = TASK_ROWS) -> DataFrame:
    """``rows``: id, group, time, value, kind (time and value whole numbers).  For each row and width: id, time, width, n_events, total, n_kinds, found.

    ``found`` has a value for each of ``shares``: for (p, q) that in place ceil(p * m / q) of the window's m values in ascending order."""
    rows = rows.select("id", _named(F.col("group")).alias("grp"), F.col("time").cast("long").alias("time"), F.col("value").cast("long").alias("value"), F.col("kind").cast("string").alias("kind"))
    held = stage(rows, "events")
    cells = stage(held.where("time is not null").groupBy("grp", "time", "value", "kind").agg(F.count(F.lit(1)).alias("times")), "cells")
    windows = stage(_windows(cells, widths), "windows")
    ranked = _ranked(cells, windows, max(widths), shares, task_rows)
    known = windows.select("grp", "time", "width", F.lit(-1).alias("nth"), F.lit(0).cast("long").alias("found"), "n_events", "total", "n_kinds")
    all_ = known.unionByName(ranked.withColumns({c: F.lit(None).cast("long") for c in ("n_events", "total", "n_kinds")}))
    of = lambda w, k: F.max(F.when((F.col("width") == w) & (F.col("nth") == k), F.col("found")))
    one = lambda w, c: F.max(F.when(F.col("width") == w, F.col(c)))
    found = {w: F.struct(F.lit(w).alias("width"), *[one(w, c).alias(c) for c in ("n_events", "total", "n_kinds")], F.array(*[of(w, k) for k in range(len(shares))]).alias("found")) for w in widths}
    by_time = all_.groupBy("grp", "time").agg(F.array(*found.values()).alias("windows"))
    times = cells.groupBy("grp", "time").agg(F.sum("times").alias("_rows")).withColumn("at", _at())
    by_time = by_time.withColumn("at", _at()).select("at", "windows").join(times.select("at", "_rows"), "at")
    joined = skew_join(held.where("time is not null").withColumn("at", _at()).select("id", "time", "at"), by_time, "at", F.col("_rows"), held.count())
    none = F.lit(None).cast("long")
    empty = F.array(*[F.struct(F.lit(w).alias("width"), *[F.lit(0).cast("long").alias(c) for c in ("n_events", "total", "n_kinds")], F.array(*[none for _ in shares]).alias("found")) for w in widths])
    out = joined.select("id", "time", "windows").unionByName(held.where("time is null").select("id", "time", empty.alias("windows")))
    return out.select("id", "time", F.explode("windows").alias("w")).select("id", "time", "w.*")


def _at() -> Column:
    return F.concat_ws("|", "time", "grp")


def document_events(docs: DataFrame) -> DataFrame:
    """Documents as rows of :func:`rolling`: their number with some disorder gives the time, the length of the text is the value.

    A null id, or one too large for a time, gives none."""
    shift = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10_000))
    x = docs.select("doc_id", "source", "lang", F.char_length("text").cast("long").alias("value"), F.try_add(F.col("doc_id").cast("long"), shift).alias("x"))
    time = F.try_multiply(F.lit(60).cast("long"), _floored("x", 6))
    return x.select(F.col("doc_id").alias("id"), F.col("source").alias("group"), time.alias("time"), "value", F.col("lang").alias("kind"))


def windows_of_documents(docs: DataFrame, widths: tuple[int, ...] = (600, 43_200), task_rows: int = TASK_ROWS) -> DataFrame:
    """doc_id, window_s, event_s, n_events, sum_chars, n_langs, median_chars, high_chars: a row for each document and width."""
    out = rolling(document_events(docs), list(widths), [(1, 2), (9, 10)], task_rows)
    picked = {"doc_id": "id", "window_s": "width", "event_s": "time", "n_events": "n_events", "sum_chars": "total", "n_langs": "n_kinds"}
    return out.select(*[F.col(c).cast("long").alias(n) for n, c in picked.items()], F.col("found")[0].alias("median_chars"), F.col("found")[1].alias("high_chars"))
