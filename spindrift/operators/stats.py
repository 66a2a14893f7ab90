"""Corpus statistics: distributions, histograms, top words and n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import features
from spindrift.sources import scratch

CLASSES = [-1, 0, 1]


def class_counts(df: DataFrame, label: str = "category") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_shares(df: DataFrame, label: str = "category") -> DataFrame:
    """Percent of the rows with a label, two digits; counts of the few classes, then a window over these."""
    n = class_counts(df.where(F.col(label).isNotNull()), label)
    return n.select(label, F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy()), 2).alias("share"))


def histogram(df: DataFrame, column: str, width: float, by: str | None = None) -> DataFrame:
    return df.groupBy(*([by] if by else []), F.floor(F.col(column) / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def kde(df: DataFrame, column: str, by: str, lo: float, hi: float, steps: int) -> DataFrame:
    """Gaussian density on a grid for each class, with Scott's bandwidth.

    Equal values are counted first; the grid, of a given number of places, meets values and not rows."""
    spread = df.groupBy(by).agg(F.count(column).alias("n"), F.stddev_samp(column).alias("sd")).select(F.col(by).alias("_by"), "n", (F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"))
    counted = df.groupBy(by, column).agg(F.count(F.lit(1)).alias("_times")).join(F.broadcast(spread), F.col(by) == F.col("_by"))
    grid = F.sequence(F.lit(0), F.lit(steps))
    at = counted.withColumn("_k", F.explode(grid)).withColumn("x", F.lit(lo) + F.col("_k") * ((hi - lo) / steps))
    z = (F.col("x") - F.col(column)) / F.col("h")
    return at.groupBy(by, "x").agg((F.sum(F.col("_times") * F.exp(-z * z / 2) / (F.col("h") * F.sqrt(2 * F.pi()))) / F.first("n")).alias("density"))


def top(df: DataFrame, term: str, n: int, offset: int = 0) -> DataFrame:
    """The n most frequent terms; ties by the term."""
    counted = df.groupBy(term).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(term))
    return counted.offset(offset).limit(n) if offset else counted.limit(n)


def words(df: DataFrame, text: str, cleaned: bool = False) -> DataFrame:
    """A row for each word; ``cleaned``: of texts whose words are parted by single blanks."""
    return df.select("*", F.explode((T.cleaned_words if cleaned else T.tokens)(F.col(text))).alias("word"))


def top_stop_words(df: DataFrame, text: str, n: int = 25) -> DataFrame:
    return top(words(df, text).where(F.col("word").isin(T.STOP_WORDS)), "word", n)


def characters(df: DataFrame, text: str) -> DataFrame:
    """Counts of the characters of all texts joined by single blanks."""
    rows = df.where(F.col(text).isNotNull())
    chars = rows.select(F.explode(F.split(text, "")).alias("character")).where("character <> ''").groupBy("character").agg(F.count(F.lit(1)).alias("n"))
    joins = rows.agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0").select(F.lit(" ").alias("character"), "n")
    return chars.unionByName(joins).groupBy("character").agg(F.sum("n").alias("n"))


def rarest_characters(df: DataFrame, text: str, n: int = 50) -> DataFrame:
    return characters(df, text).orderBy("n", "character").limit(n)


def top_ngrams(df: DataFrame, text: str, size: int, n: int, stop: list[str] | None = None) -> DataFrame:
    """Most frequent n-grams of the words left by a stop list, the vectorizers' own unless another is given."""
    left = T.without(T.analyzed(F.col(text)), T.VECTORIZER_STOP_WORDS if stop is None else stop)
    counted = features.counts(df.select(F.array_join(left, " ").alias("_words")), "_words", (size, size))
    return counted.select(F.col("term").alias("ngram"), F.col("total").alias("n")).orderBy(F.desc("n"), "ngram").limit(n)


def top_words_by_class(df: DataFrame, text: str, n: int = 20, start: int = 0, label: str = "category", cleaned: bool = False) -> DataFrame:
    """Most frequent words with their counts in each class; one exchange, as the classes are known."""
    c = F.col(label)
    counted = words(df, text, cleaned).groupBy("word").agg(F.count_if(c == -1).alias("negative"), F.count_if(c == 0).alias("neutral"), F.count_if(c == 1).alias("positive"), F.count(F.lit(1)).alias("total"))
    return counted.orderBy(F.desc("total"), "word").offset(start).limit(n)


#: The log-likelihood ratio from which a pair of words counts as a term of its own, as word clouds have it (fixed value).
COLLOCATION = 30.0


def _group(by: str | None) -> list[str]:
    return [by] if by else []


def folded(terms: DataFrame, by: str | None = None) -> DataFrame:
    """(class, term, form, n) of a table (class, term, n): terms that differ in upper and lower case alone, or by a plural's s, are one.

    A plural is a word in -s, not in -ss, without which it is a word of the same class too.  ``form`` is the term of the group, its commonest
    spelling, a plural counting without its s; ties go to the first in order.  One row for each term."""
    keys = _group(by)
    lower = terms.withColumn("_low", F.lower("term"))
    known = lower.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_low").alias("_one")).distinct()
    plural = F.endswith("_low", F.lit("s")) & ~F.endswith("_low", F.lit("ss"))
    shorter = lambda c: F.expr(f"substring({c}, 1, char_length({c}) - 1)")
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    met = lower.join(known, [F.when(plural, shorter("_low")) == F.col("_one"), *same], "left")
    some = F.col("_one").isNotNull()
    met = met.withColumns({"_root": F.coalesce("_one", "_low"), "_spelt": F.when(some, shorter("term")).otherwise(F.col("term"))}).select(*keys, "term", "n", "_root", "_spelt")
    spelt = met.groupBy(*keys, "_root", "_spelt").agg(F.sum("n").alias("_m"))
    best = spelt.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_root").alias("_for")).agg(F.min(F.struct((-F.col("_m")).alias("m"), "_spelt")).alias("_b"))
    return met.join(best, [F.col("_root") == F.col("_for"), *same]).select(*keys, "term", F.col("_b._spelt").alias("form"), "n")


def _l(k: Column, n: Column, x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(1e-10))) * k + F.log(F.greatest(1 - x, F.lit(1e-10))) * (n - k)


def likelihood_ratio(both: Column, one: Column, two: Column, total: Column) -> Column:
    """Dunning's: how much likelier the counts are where the second word depends on the first than where it doesn't, times two."""
    p, p1, p2 = two / total, both / one, F.coalesce(F.try_divide(two - both, total - one), F.lit(0.0))
    return -2 * (_l(both, one, p) + _l(two - both, total - one, p) - _l(both, one, p1) - _l(two - both, total - one, p2))


def collocations(counted: DataFrame, pairs: DataFrame, by: str | None = None, threshold: float = COLLOCATION) -> DataFrame:
    """(class, term, n): words and pairs, from (class, term, form, n) of words and (class, first, second, n) of pairs.

    A pair whose likelihood ratio is above the threshold is a term, and its occurrences are taken out of its words' counts; what has none left is dropped."""
    keys = _group(by)
    named = lambda df, p: df.select(*[F.col(k).alias(f"{p}_key_{k}") for k in keys], F.col("term").alias(f"{p}_term"), F.col("form").alias(f"{p}_form"))
    words_ = counted.groupBy(*keys, "form").agg(F.sum("n").alias("n"))
    count = lambda p: words_.select(*[F.col(k).alias(f"{p}_key_{k}") for k in keys], F.col("form").alias(f"{p}_of"), F.col("n").alias(f"{p}_n"))
    same = lambda p: [F.col(k).eqNullSafe(F.col(f"{p}_key_{k}")) for k in keys]
    held = pairs
    for p, c in (("_a", "first"), ("_b", "second")):
        held = held.join(named(counted, p), [F.col(c) == F.col(f"{p}_term"), *same(p)]).drop(*[f"{p}_key_{k}" for k in keys])
    held = held.groupBy(*keys, "_a_form", "_b_form").agg(F.sum("n").alias("n"))
    for p, q in (("_a", "_c"), ("_b", "_d")):
        held = held.join(count(q), [F.col(f"{p}_form") == F.col(f"{q}_of"), *same(q)]).drop(*[f"{q}_key_{k}" for k in keys])
    total = words_.groupBy(*[F.col(k).alias(f"_t_key_{k}") for k in keys]).agg(F.sum("n").alias("_total"))
    held = held.join(F.broadcast(total), same("_t")) if keys else held.crossJoin(F.broadcast(total))
    real = lambda c: F.col(c).cast("double")
    # Written, as it is read twice: else the pairs of all texts would be counted twice.
    strong = scratch.table(held.where(likelihood_ratio(real("n"), real("_c_n"), real("_d_n"), real("_total")) > threshold).select(*keys, "_a_form", "_b_form", "n"), "strong")
    taken = strong.select(*keys, F.explode(F.array("_a_form", "_b_form")).alias("form"), (-F.col("n")).alias("n"))
    left = words_.unionByName(taken).groupBy(*keys, "form").agg(F.sum("n").alias("n")).where("n > 0").withColumnRenamed("form", "term")
    return left.unionByName(strong.select(*keys, F.concat_ws(" ", "_a_form", "_b_form").alias("term"), "n"))


def cloud(df: DataFrame, words_column: Column, n: int = 200, by: str | None = None, pairs: bool = False, fold: bool = False) -> DataFrame:
    """The most frequent words, of all texts or of each class, with their frequency relative to the first.

    ``pairs``: with collocations; ``fold``: upper and lower case, singular and plural together.  Classes have to be few.
    Counts of words, and what they are folded to, are written, as they are read many times: the texts are read once, with ``pairs`` twice."""
    keys = _group(by)
    held = df.select(*keys, words_column.alias("_w"))
    counted = held.select(*keys, F.explode("_w").alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))
    terms_ = scratch.table(folded(scratch.table(counted, "counted"), by), "folded") if fold else counted.withColumn("form", F.col("term"))
    if pairs:
        each = F.transform(F.sequence(F.lit(1), F.size("_w") - 1), lambda i: F.struct(F.get("_w", i - 1).alias("first"), F.get("_w", i).alias("second")))
        two = held.where(F.size("_w") > 1).select(*keys, F.explode(each).alias("p")).groupBy(*keys, "p.first", "p.second").agg(F.count(F.lit(1)).alias("n"))
        found = collocations(terms_, two, by)
    else:
        found = terms_.groupBy(*keys, F.col("form").alias("term")).agg(F.sum("n").alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "term")
    first = found.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= n) if keys else found.orderBy(F.desc("n"), "term").limit(n)
    return first.select(*keys, F.col("term").alias("word"), "n", (F.col("n") / F.max("n").over(Window.partitionBy(*keys))).alias("weight"))


#: Ranges of the order in which lengths are summed up.
RANGES = 4096


def _ranges(rows: DataFrame, order: str, then: str, ranges: int):
    """A function of both columns: the number of the range, by splitters from a sample, so that ranges hold about equally many rows however the numbers lie."""
    drawn = rows.select(order, then).orderBy(F.xxhash64(order, then), order, then).limit(ranges - 1).distinct().collect()  # fewer than `ranges` rows
    held = rows.sparkSession.sparkContext.broadcast(drawn)

    @F.arrow_udf("int")
    def place(a: pa.Array, b: pa.Array) -> pa.Array:
        columns = []
        for k, own in enumerate((a, b)):
            both = pa.concat_arrays([pa.array([r[k] for r in held.value], own.type), own])
            columns += [both.is_valid().to_numpy(zero_copy_only=False), both.fill_null(0).to_numpy(zero_copy_only=False)]
        n = len(held.value)
        at = np.lexsort((np.arange(n + len(a)) >= n, *columns[::-1]))
        out = np.empty(n + len(a), np.int32)
        out[at] = np.cumsum(at < n)
        return pa.array(out[n:])

    return place


def concatenated(df: DataFrame, text: str, order: str, then: str, ranges: int = RANGES) -> DataFrame:
    """The corpus of all texts joined by single blanks, in the order of two numbers, as rows (order, then, text, start).

    ``start`` is where the text begins in the whole: no value holds the corpus, which no machine could.  Lengths are
    summed up in ranges of the order, then over the ranges, of which there are few.  Null texts are left out; null numbers come first."""
    rows = df.where(F.col(text).isNotNull()).select(order, then, text, (F.char_length(text) + 1).cast("long").alias("_n"))
    placed = rows.withColumn("_b", _ranges(rows, order, then, ranges)(F.col(order), F.col(then)))
    sums = placed.groupBy("_b").agg(F.sum("_n").alias("_s"))
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("_b").alias("_of"), earlier("_s", Window.partitionBy(F.lit(1)).orderBy("_b")).alias("_first"))
    own = earlier("_n", Window.partitionBy("_b").orderBy(order, then, text))
    return placed.withColumn("_own", own).join(F.broadcast(starts), F.col("_b") == F.col("_of")).select(order, then, text, (F.col("_first") + F.col("_own")).alias("start"))
