"""Bounded training samples of labelled documents, and logistic fits on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.pmod(F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)), F.lit(folds)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, max_chars: int) -> tuple[list[str], np.ndarray, float]:
    """Texts and 0/1 labels of up to ``rows`` labelled documents, half of each label, and the share of 1 among all usable labels.

    The bound: ``rows`` documents of up to ``max_chars`` characters each; which
    ones is decided by a hash of the id.  A longer document is not left out: it
    is cut into pieces of that length, one of which its id's hash picks.  Rows
    without label, id or text and rows whose fold is held out are not used; of rows
    that share an id one counts, and of labels that do the smaller.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    drawn = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id")).limit(rows // 2)
        drawn = part if drawn is None else drawn.unionByName(part)
    drawn = drawn.select(F.col("doc_id").alias("_id"), "y")
    pieces = F.greatest(F.ceil(F.char_length("text") / max_chars), F.lit(1))
    piece = F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id"), pieces) * max_chars + 1).cast("int"), F.lit(max_chars))
    met = docs.where(F.col("text").isNotNull()).select("doc_id", piece.alias("text")).join(F.broadcast(drawn), F.col("doc_id") == F.col("_id"))
    # One row of an id, the least text, so that ids that many rows repeat don't break the bound; summed up before the shuffle.
    got = met.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")).toArrow().sort_by("doc_id")
    return got["text"].to_pylist(), got["y"].to_numpy().astype(np.float64), share


def prior_shift(y: np.ndarray, share: float) -> float:
    """What to add to log-odds fitted on ``y`` where the share of 1 is really ``share``."""
    odds = lambda p: np.log(p / (1 - p))
    clip = lambda p: min(max(p, 1e-4), 1 - 1e-4)
    return float(odds(clip(share)) - odds(clip(y.mean() if len(y) else 0.5)))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Adam:
    """Gradient steps with running moments."""

    def __init__(self, rate: float):
        self.rate, self.state, self.t = rate, {}, 0

    def step(self, **grads: tuple[np.ndarray, np.ndarray]) -> None:
        """Each of ``grads``: the parameters, changed in place, and their gradient."""
        self.t += 1
        for name, (x, g) in grads.items():
            m, v = self.state.setdefault(name, (np.zeros_like(x), np.zeros_like(x)))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def least(loss, x: np.ndarray, rounds: int, memory: int = 6, close: float = 1e-3) -> np.ndarray:
    """Where the convex ``loss`` (giving value and gradient) is least, by L-BFGS, until the gradient's norm has shrunk to ``close`` of the first."""
    value, grad = loss(x)
    steps, end = [], close * float(np.linalg.norm(grad))
    for _ in range(rounds):
        if np.linalg.norm(grad) <= end:
            break
        way, used = -grad, []
        for s, g, r in reversed(steps):
            used.append(r * float(s @ way))
            way = way - used[-1] * g
        if steps:
            s, g, _ = steps[-1]
            way = way * (float(s @ g) / float(g @ g))
        else:
            way = way / np.linalg.norm(grad)
        for (s, g, r), a in zip(steps, reversed(used), strict=True):
            way = way + s * (a - r * float(g @ way))
        slope, size = float(grad @ way), 1.0
        while True:
            next_value, next_grad = loss(x + size * way)
            if next_value <= value + 1e-4 * size * slope or size < 1e-6:
                break
            size /= 2
        if next_value >= value:
            break
        moved, turned = size * way, next_grad - grad
        if (bend := float(moved @ turned)) > 1e-12:
            steps = [*steps, (moved, turned, 1 / bend)][-memory:]
        x, value, grad = x + moved, next_value, next_grad
    return x
