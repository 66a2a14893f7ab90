"""Bags of words and TF-IDF, in long form (key, term, value) and as vectors."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.sources import scratch


#: Terms of a vocabulary that may be broadcast; a larger one is joined by a shuffle.
BROADCAST_TERMS = 200_000


def _grams(df: DataFrame, text: str, ngram_range: tuple[int, int]) -> DataFrame:
    """``df`` with ``_g``, the n-grams of each text."""
    return df.withColumn("_g", T.let(T.analyzed(F.coalesce(F.col(text), F.lit(""))), lambda w: T.ngrams(w, *ngram_range)))


def occurrences(df: DataFrame, key: str, text: str, ngram_range: tuple[int, int] = (1, 1)) -> DataFrame:
    """(key, term), a row for each occurrence; nothing is shuffled."""
    # The outer form, as Spark would copy the whole expression into a filter below the inner one.
    return _grams(df.select(key, text), text, ngram_range).select(key, F.explode_outer("_g").alias("term")).where("term is not null")


def terms(df: DataFrame, key: str, text: str, ngram_range: tuple[int, int] = (1, 1), vocabulary_: DataFrame | None = None, held: list[str] | None = None) -> DataFrame:
    """(key, term, tf) and the columns of ``vocabulary_``, which leaves only its terms; rows that share a key are one document.

    With a vocabulary that is broadcast, other terms go before anything is counted or shuffled; ``held``: its terms, where it is small,
    so that others aren't made into rows."""
    if held is None:
        found = occurrences(df, key, text, ngram_range)
    else:
        found = df.select(key, F.explode(_held(df.sparkSession, held, ngram_range)(_words(text))).alias("term"))
    more = []
    if vocabulary_ is not None:
        found = found.join(vocabulary_, "term")
        more = [c for c in vocabulary_.columns if c != "term"]
    return found.groupBy(key, "term", *more).agg(F.count(F.lit(1)).alias("tf")).select(key, "term", "tf", *more)


def _words(text: str):
    """A text's words, parted by blanks."""
    return F.array_join(T.analyzed(F.coalesce(F.col(text), F.lit(""))), " ")


def _ngrams(words: str, lo: int, hi: int) -> Iterator[str]:
    of = words.split(" ") if words else []
    for n in range(lo, hi + 1):
        yield from of if n == 1 else map(" ".join, zip(*[of[j:] for j in range(n)], strict=False))


def _held(spark, terms_: list[str], ngram_range: tuple[int, int]):
    """A function of joined words: their n-grams that a list holds, in the order of :func:`T.ngrams`."""
    known = spark.sparkContext.broadcast(frozenset(terms_))

    @F.arrow_udf("array<string>")
    def held(texts: pa.Array) -> pa.Array:
        of = known.value
        return pa.array([[g for g in _ngrams(t.as_py(), *ngram_range) if g in of] for t in texts], pa.list_(pa.string()))

    return held


def _runs(words: str, of: frozenset[str]) -> list[str]:
    """The longest runs of words that are in ``of``."""
    return [" ".join(run) for kept, run in groupby(words.split(" "), of.__contains__) if kept]


#: Different terms that a task counts before it hands them on.
COUNTED = 200_000


def counts(df: DataFrame, words: str, ngram_range: tuple[int, int], most: int = COUNTED, only: list[str] | None = None) -> DataFrame:
    """(term, total, df) of all n-grams of a column of joined words; ``only``: of those of such words alone.

    A task counts in batches, and hands on what it has when it holds ``most`` different terms; one shuffle adds that up."""
    lo, hi = ngram_range
    schema = pa.schema([("term", pa.string()), ("total", pa.int64()), ("df", pa.int64())])
    known = None if only is None else df.sparkSession.sparkContext.broadcast(frozenset(only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = Counter(), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64()), pa.array([held[t] for t in total], pa.int64())], schema=schema)

        for batch in batches:
            for t in batch.column(0):
                own = Counter(g for run_ in ([t.as_py()] if known is None else _runs(t.as_py(), known.value)) for g in _ngrams(run_, lo, hi))
                total.update(own)
                held.update(own.keys())
                if len(total) >= most:
                    yield out()
                    total.clear()
                    held.clear()
        yield out()

    made = df.select(F.col(words)).mapInArrow(run, "term string, total long, df long")
    return made.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def _common(words: DataFrame, n: int) -> list[str] | None:
    """The words that occur as often as the ``n``-th does, which terms of the first ``n`` are made of; none if there are fewer words than n, or too many to send.

    A term is no more frequent than its words, and ``n`` terms, the words alone, are at least as frequent as the n-th word."""
    single = scratch.table(counts(words, "_words", (1, 1)), "words")
    edge = single.orderBy(F.desc("total"), "term").limit(n).agg(F.min("total").alias("least"), F.count(F.lit(1)).alias("n")).first()
    if edge["n"] < n:
        return None
    found = [r["term"] for r in single.where(F.col("total") >= edge["least"]).select("term").limit(BROADCAST_TERMS + 1).collect()]
    return found if len(found) <= BROADCAST_TERMS else None


def vocabulary(df: DataFrame, text: str, ngram_range: tuple[int, int] = (1, 1), max_features: int | None = None) -> DataFrame:
    """(term, total, df): the terms with the highest totals, ties by the term."""
    words, (lo, hi) = df.select(_words(text).alias("_words")), ngram_range
    only = _common(words, max_features) if max_features and max_features <= BROADCAST_TERMS and lo == 1 < hi else None
    found = counts(words, "_words", ngram_range, only=only)
    return found.orderBy(F.desc("total"), "term").limit(max_features) if max_features else found


def _chosen(model: DataFrame, max_features: int | None) -> tuple[DataFrame, list[str] | None]:
    """A vocabulary as it is joined, and its terms; those of a large one are not collected."""
    if max_features is None or max_features > BROADCAST_TERMS:
        return model, None
    kept = scratch.table(model, "vocabulary")
    return F.broadcast(kept), [r["term"] for r in kept.select("term").collect()]  # max_features at most


def bag(df: DataFrame, key: str, text: str, ngram_range=(1, 1), max_features: int | None = None) -> DataFrame:
    return terms(df, key, text, ngram_range, *_chosen(vocabulary(df, text, ngram_range, max_features).select("term"), max_features))


def fit_tfidf(df: DataFrame, key: str, text: str, max_features: int = 1000, ngram_range=(1, 3)) -> DataFrame:
    """(term, total, df, idf) with idf = ln((1 + n) / (1 + df)) + 1."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    chosen = vocabulary(df, text, ngram_range, max_features)
    return chosen.crossJoin(F.broadcast(n)).withColumn("idf", F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1).drop("_n")


def transform_tfidf(df: DataFrame, model: DataFrame, key: str, text: str, ngram_range=(1, 3), max_features: int | None = 1000) -> DataFrame:
    """(key, term, weight), rows of length 1; terms outside the vocabulary are dropped, and documents of such terms alone have no rows.

    The vocabulary, of up to ``max_features`` terms, is broadcast, so only terms that it holds are shuffled."""
    weighed = terms(df, key, text, ngram_range, *_chosen(model.select("term", "idf"), max_features)).withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighed.select(key, "term", (F.col("w") / norm).alias("weight"))


def tfidf(df: DataFrame, key: str, text: str, max_features: int = 1000, ngram_range=(1, 3)) -> DataFrame:
    return transform_tfidf(df, fit_tfidf(df, key, text, max_features, ngram_range), key, text, ngram_range, max_features)


def term_totals(df: DataFrame, key: str, text: str, ngram_range=(1, 1)) -> DataFrame:
    return vocabulary(df, text, ngram_range).select("term", "total")


def ranked_terms(df: DataFrame, text: str, longest: int = 3, most: int | None = None) -> DataFrame:
    """(term, total, df, words) of n-grams of up to ``longest`` words, read once and written, so that any vocabulary of up to ``most`` terms is a cut of it."""
    words = df.select(_words(text).alias("_words"))
    found = counts(words, "_words", (1, longest), only=_common(words, most) if most and most <= BROADCAST_TERMS and longest > 1 else None)
    return scratch.table(found.withColumn("words", F.size(F.split("term", " "))), "terms")


def first_terms(ranked: DataFrame, longest: int, n: int) -> list[tuple[str, int]]:
    """The ``n`` terms of up to ``longest`` words with the highest totals, ties by the term, with their document counts."""
    return [(r["term"], r["df"]) for r in ranked.where(F.col("words") <= longest).orderBy(F.desc("total"), "term").limit(n).select("term", "df").collect()]


def _first_counts(df: DataFrame, column: str, n: int) -> DataFrame:
    """Sparse vectors cut to their first ``n`` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            whole, kind = batch.column(at), batch.schema.field(at).type
            indices, values = whole.field("indices"), whole.field("values")
            begin, end = indices.offsets[0].as_py(), indices.offsets[-1].as_py()
            kept = indices.values.to_numpy()[begin:end] < n
            offsets = np.r_[0, np.cumsum(kept)][indices.offsets.to_numpy() - begin].astype(np.int32)
            parts = {"type": whole.field("type"), "size": pa.array(np.full(len(whole), n, np.int32))}
            parts |= {k: pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.values.to_numpy()[begin:end][kept]), type=kind.field(k).type) for k, x in (("indices", indices), ("values", values))}
            cut = pa.StructArray.from_arrays([parts[f.name] for f in kind], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], cut, *batch.columns[at + 1 :]], schema=batch.schema)

    return df.mapInArrow(run, df.schema)


class Vectorizer:
    """TF-IDF vectors for training, equal to the long form: Spark's idf plus one, then unit length."""

    def __init__(self, max_features: int = 1000, ngram_range: tuple[int, int] = (1, 3), tfidf: bool = True):
        self.max_features, self.ngram_range, self.tfidf = max_features, ngram_range, tfidf
        self.model: PipelineModel | None = None

    def _terms(self, df: DataFrame, text: str) -> DataFrame:
        return df.withColumn("terms", _held(df.sparkSession, self.feature_names(), self.ngram_range)(_words(text)))

    def fit(self, df: DataFrame, text: str) -> Vectorizer:
        chosen = vocabulary(df, text, self.ngram_range, self.max_features)
        return self.of_terms([(r["term"], r["df"]) for r in chosen.collect()], df.count() if self.tfidf else 0)  # max_features terms at most

    def of_terms(self, ranked: list[tuple[str, int]], n_docs: int) -> Vectorizer:
        """With a vocabulary that is known: terms with their document counts, of ``n_docs`` documents, by rank; the first ``max_features`` count."""
        held = ranked[: self.max_features] or [("", 0)]
        counter = CountVectorizerModel.from_vocabulary([t for t, _ in held], inputCol="terms", outputCol="counts" if self.tfidf else "features")
        stages = [counter]
        if self.tfidf:
            scale = ElementwiseProduct(scalingVec=DenseVector([math.log((1 + n_docs) / (1 + df)) + 1 for _, df in held]), inputCol="counts", outputCol="weighed")
            stages += [scale, Normalizer(p=2.0, inputCol="weighed", outputCol="features")]
        self.model = PipelineModel(stages)
        return self

    def transform(self, df: DataFrame, text: str) -> DataFrame:
        return self.model.transform(self._terms(df, text)).drop("terms", "counts", "weighed")

    def counted(self, df: DataFrame, text: str) -> DataFrame:
        """``df`` with ``counts`` of all terms, from which the vectors of any vocabulary that begins this one are cut."""
        counter = CountVectorizerModel.from_vocabulary(self.feature_names(), inputCol="terms", outputCol="counts")
        return counter.transform(self._terms(df, text)).drop("terms")

    def of_counts(self, df: DataFrame) -> DataFrame:
        """What :meth:`transform` gives, from counts of a vocabulary that begins with this one's."""
        cut = _first_counts(df, "counts", len(self.feature_names()))
        if not self.tfidf:
            return cut.withColumnRenamed("counts", "features")
        return PipelineModel(self.model.stages[1:]).transform(cut).drop("counts", "weighed")

    def feature_names(self) -> list[str]:
        return list(self.model.stages[0].vocabulary)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> Vectorizer:
        self.model = PipelineModel.load(path)
        return self


def dense(df: DataFrame, features: str = "features") -> DataFrame:
    """Vectors as arrays; on demand only, as they hold every term for every row."""
    return df.withColumn(features, vector_to_array(features))


def dense_sample(vectorizer: Vectorizer, df: DataFrame, text: str, n: int = 5) -> DataFrame:
    """The first rows with a named column for each term."""
    held = dense(vectorizer.transform(df.limit(n), text))
    return held.select(*[F.col("features")[k].alias(f"term_{name}") for k, name in enumerate(vectorizer.feature_names())])


