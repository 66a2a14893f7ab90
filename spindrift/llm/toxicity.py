"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of the lower-cased text, everything but
letters being a separator, hashed to buckets.  On a bounded sample of labelled
documents each bucket of at least three documents gets the log ratio of its
smoothed document counts in the two classes; a logistic regression with ridge
penalty is fitted on features of that size.  Small ratios make small features,
which the penalty keeps small, and no bucket is left out for its ratio or its
weight.  Scoring adds up the weights of a text's distinct buckets, over whole texts.

Defined results: null, empty and letterless texts get the score of a text
without features; without labels of both kinds all scores are the share of
label 1; null ids count as fold 0; rows are independent of each other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import segment
from spindrift.llm.common import bounded_batches, tidy
from spindrift.llm.labelled import fold, least, prior_shift, sample, sigmoid

BITS = 20
ORDERS = (3, 4, 5)
#: The bound of the training sample: so many documents, of up to so many characters each.
SAMPLE_ROWS, SAMPLE_CHARS = 6000, 20_000
HELD_OUT, FOLDS = 0, 5
THRESHOLD = 0.5
#: Documents of the sample that an n-gram must occur in; the penalty of the squared weights against the loss of one document.
LEAST_DOCS, RIDGE = 3, 1.0
#: The deviance at which a feature has half the size of its log ratio.
NOISE = 10.0
#: Code points of the sample whose n-grams are held at a time.
FIT_CHUNK = 1 << 18
_SEPARATOR = 0x20


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def features(texts: list[str], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and buckets, each pair once, in order; only buckets with a weight, if weights are given."""
    lower = [t.lower() for t in texts]
    cp, at = segment.points([f" {t} " for t in lower])
    if not len(cp):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = segment.classes()
    cp = np.where(kind[cp] == segment.LETTER, cp, _SEPARATOR)
    keep = np.r_[True, (cp[1:] != _SEPARATOR) | (cp[:-1] != _SEPARATOR)]
    keep[at[:-1]] = True
    owner = np.repeat(np.arange(len(texts)), np.diff(at))[keep]
    mixed = (segment._mix_table()[cp[keep]] >> np.uint64(32)).astype(np.uint32)
    h, found = mixed.copy(), []
    for n in range(2, max(ORDERS) + 1):
        if len(mixed) < n:
            break
        h = h[: len(mixed) - n + 1] * np.uint32(0x9E3779B1) + mixed[n - 1 :]
        if n in ORDERS:
            bucket = ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)) >> np.uint32(32 - BITS)
            ok = owner[: len(h)] == owner[n - 1 :]
            if weights is not None:
                ok &= weights[bucket] != 0
            ok = np.flatnonzero(ok)
            found.append(owner[ok] << BITS | bucket[ok].astype(np.int64))
    pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def fit(texts: list[str], y: np.ndarray, share: float, rounds: int = 100, ridge: float = RIDGE) -> Model:
    weights = np.zeros(1 << BITS, np.float32)
    if not 0 < y.sum() < len(y):
        p = min(max(share, 1e-4), 1 - 1e-4)
        return Model(weights, float(np.log(p / (1 - p))))
    # Two passes, so that n-grams of one or two documents are never held: first document counts, then places.
    in_docs, in_ones = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS)
    for lo, hi in segment.chunks(texts, FIT_CHUNK):
        doc, bucket = features(texts[lo:hi])
        in_docs += np.bincount(bucket, minlength=1 << BITS)
        in_ones += np.bincount(bucket, y[lo + doc], 1 << BITS)
    often = in_docs >= LEAST_DOCS
    own, number = np.flatnonzero(often), np.cumsum(often) - 1
    ones, zeros = in_ones[own], in_docs[own] - in_ones[own]
    ratio = np.log((1 + ones) / (1 + y.sum()) / ((1 + zeros) / (1 + (1 - y).sum())))
    # The deviance of the counts from equal shares tells how far a ratio stands out from noise; it scales the feature, but leaves none out.
    part = y.mean()
    deviance = 2 * (ones * np.log(np.maximum(ones, 1) / (in_docs[own] * part)) + zeros * np.log(np.maximum(zeros, 1) / (in_docs[own] * (1 - part))))
    ratio *= deviance / (deviance + NOISE)
    parts = []
    for lo, hi in segment.chunks(texts, FIT_CHUNK):
        doc, bucket = features(texts[lo:hi], often)
        parts.append((lo, np.bincount(doc, minlength=hi - lo), number[bucket].astype(np.int32)))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        """Of weights and bias: the logistic loss of all documents with its ridge penalty, and the gradient."""
        scaled, grad, total = x[:-1] * ratio, np.zeros(len(x)), 0.0
        for lo, count, column in parts:
            z = np.bincount(np.repeat(np.arange(len(count)), count), scaled[column], len(count)) + x[-1]
            known = y[lo : lo + len(count)]
            off = sigmoid(z) - known
            total += float(np.sum(np.logaddexp(0, z) - known * z))
            grad[:-1] += np.bincount(column, np.repeat(off, count), len(own))
            grad[-1] += off.sum()
        grad[:-1] = grad[:-1] * ratio + ridge * x[:-1]
        return total + ridge / 2 * float(x[:-1] @ x[:-1]), grad

    x = least(loss, np.zeros(len(own) + 1), rounds)
    weights[own] = x[:-1] * ratio
    return Model(weights, float(x[-1]) + prior_shift(y, share))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, max_chars: int = SAMPLE_CHARS) -> Model:
    usable = fold(F.col("doc_id"), FOLDS) != HELD_OUT
    return fit(*sample(docs, labels, "toxic", usable, rows, max_chars))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""
    spark = docs.sparkSession
    buckets = np.flatnonzero(model.weights)
    held = spark.sparkContext.broadcast((buckets.astype(np.int32), model.weights[buckets], model.bias))

    def run(batches):
        at, values, bias = held.value
        weights = np.zeros(1 << BITS, np.float32)
        weights[at] = values
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            out = np.full(len(texts), bias)
            for a, b in segment.chunks(texts):
                doc, bucket = features(texts[a:b], weights)
                out[a:b] += np.bincount(doc, weights[bucket], b - a)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sigmoid(out))], names=["doc_id", "score"])

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
