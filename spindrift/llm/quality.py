"""Quality: a linear-chain conditional random field over the lines of a document.

Every line is good or bad.  Its features are shares of kinds of characters and
words, with those of the line before and after it; the chain adds a weight for
each pair of neighbouring labels.  The field is fitted by likelihood on a
bounded sample of labelled documents, all lines of which carry the document's
label.  Forward-backward marginals, weighted by the lines' lengths, give the
share of the document that is good; a logistic curve fitted on the same sample
makes it the probability of label 1.

Defined results: null and empty texts are one empty line; without labels of
both kinds all scores are the share of label 1; null ids count as fold 0; rows
are independent of each other, so equal texts have equal scores; extra columns
are ignored, or kept whatever their names.  In training all lines of a document
have its label, so the chain learns how strongly lines go together, not where a
document turns.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spindrift.llm import segment
from spindrift.llm.common import bounded_batches, column, fresh, numbered_columns, tidy
from spindrift.llm.labelled import Adam, fold, prior_shift, sample, sigmoid

#: The bound of the training sample: so many documents, of up to so many characters each.
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 20_000
#: Code points of the sample whose features are made at a time.
FIT_CHUNK = 1 << 18
HELD_OUT, FOLDS = 2, 4
THRESHOLD = 0.7
#: Kinds of characters: lower-case, capital and other letters, numbers, blanks, sentence ends, commas, quotes, bars, signs, brackets, the rest.
_LOWER, _UPPER, _LETTER, _NUMBER, _BLANK, _END, _COMMA, _QUOTE, _BAR, _SIGN, _BRACKET, _REST, _BANG, _KINDS = range(14)
_SETS = {_BLANK: " \t\r\x0b\x0c", _END: ".?", _BANG: "!", _COMMA: ",;:", _QUOTE: "'\"`’“”«»", _BAR: "|•·>/\\", _SIGN: "#$%&*@^~=+_<-", _BRACKET: "()[]{}"}
_table: list[np.ndarray] = []
N_FEATURES = _KINDS + 9


@dataclass
class Model:
    weights: np.ndarray  # of the features of the line, the one before and the one after; with a bias
    pairs: np.ndarray  # of neighbouring labels, [before, after], 0 bad and 1 good
    mean: np.ndarray
    scale: np.ndarray
    curve: np.ndarray  # slope and bias


def _kinds() -> np.ndarray:
    if not _table:
        kind = {"Lu": _UPPER, "Lt": _UPPER, "Ll": _LOWER}
        out = np.full(0x110000, _REST, np.uint8)
        for c in range(0x3000):
            got = unicodedata.category(chr(c))
            out[c] = kind.get(got, {"L": _LETTER, "N": _NUMBER, "Z": _BLANK}.get(got[0], _REST))
        out[0x3000:][segment.classes()[0x3000:] == segment.LETTER] = _LETTER
        for k, chars in _SETS.items():
            out[[ord(c) for c in chars]] = k
        _table.append(out)
    return _table[0]


def lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of all texts; their lengths; where each text's lines begin, with the end."""
    cp, at = segment.points([t + "\n" for t in texts])
    stop = np.flatnonzero(cp == 0x0A)
    start = np.r_[0, stop[:-1] + 1]
    first = np.searchsorted(start, at)
    length = stop - start
    line = np.repeat(np.arange(len(stop)), length + 1)
    kind = _kinds()[cp]
    counts = np.bincount(line * _KINDS + kind, minlength=len(stop) * _KINDS).reshape(-1, _KINDS).astype(np.float64)
    counts[:, _REST] -= 1  # the line's own end
    inside = (kind != _BLANK) & (cp != 0x0A)
    change = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    begin, end = change[::2], change[1::2]
    of = line[begin]
    n_words = np.bincount(of, minlength=len(stop)).astype(np.float64)
    h = segment.hashes(cp, begin, end) if len(begin) else np.empty(0, np.uint64)
    again = np.zeros(len(begin), bool)
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    size = end - begin
    last, lead = kind[end - 1] if len(end) else kind[:0], kind[begin] if len(begin) else kind[:0]
    share = lambda mask: np.bincount(of[mask], minlength=len(stop)) / np.maximum(n_words, 1)
    odd = (last != _LOWER) & (last != _UPPER) & (last != _LETTER) & (last != _END) & (last != _COMMA) & (last != _NUMBER)
    seen = segment.hashes(cp, start, stop)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    _, back, times = np.unique(np.c_[owner.astype(np.uint64), seen], axis=0, return_inverse=True, return_counts=True) if len(seen) else (None, np.empty(0, int), np.empty(0, int))
    out = np.concatenate([
        counts / np.maximum(length, 1)[:, None],
        np.stack([
            np.log1p(length), share(again), share(odd), share(lead == _UPPER), share(size == 1), share((last == _BANG)),
            np.bincount(of, size, len(stop)) / np.maximum(n_words, 1) / 10, np.minimum(times[back.ravel()] - 1, 3) / 3, n_words == 0,
        ], axis=1),
    ], axis=1)
    return out, length + 1.0, first


def around(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the line before and after it, nothing at a text's ends, and a bias."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1][first[:-1] < len(x)]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], axis=1)


def marginals(good: np.ndarray, pairs: np.ndarray, first: np.ndarray):
    """P(good) of every line, and the expected counts of neighbouring labels, from the lines' log-odds.

    All texts take a step together, longer ones first, so a step is one array operation."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begin, n = first[:-1][order], n[order]
    longest = int(n[0]) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(longest), "left")  # texts with more than t lines
    lift = np.clip(good, -50, 50)
    score = np.exp(np.stack([-lift / 2, lift / 2], axis=1))
    trans = np.exp(pairs)
    ahead, back = np.empty((len(good), 2)), np.empty((len(good), 2))
    for t in range(longest):
        at = begin[: live[t]] + t
        a = score[at] if t == 0 else (ahead[at - 1] @ trans) * score[at]
        ahead[at] = a / a.sum(axis=1, keepdims=True)
    counts = np.zeros((2, 2))
    for t in range(longest - 1, -1, -1):
        k, more = live[t], live[t + 1] if t + 1 < longest else 0
        at = begin[:k] + t
        back[at] = 0.5
        if more:
            nxt = at[:more] + 1
            b = (back[nxt] * score[nxt]) @ trans.T
            back[at[:more]] = b / b.sum(axis=1, keepdims=True)
            both = ahead[at[:more], :, None] * trans * (back[nxt] * score[nxt])[:, None, :]
            counts += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    p = ahead * back
    return p[:, 1] / p.sum(axis=1), counts


def _shares(p: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.r_[0, np.cumsum(p * weight)]
    whole = np.r_[0, np.cumsum(weight)]
    return (sums[first[1:]] - sums[first[:-1]]) / (whole[first[1:]] - whole[first[:-1]])


def fit(texts: list[str], y: np.ndarray, share: float, rounds: int = 150, ridge: float = 1e-3) -> Model:
    width = 3 * N_FEATURES + 1
    if not 0 < y.sum() < len(y):
        p = min(max(share, 1e-4), 1 - 1e-4)
        return Model(np.zeros(width), np.zeros((2, 2)), np.zeros(N_FEATURES), np.ones(N_FEATURES), np.array([0.0, np.log(p / (1 - p))]))
    parts = [lines(texts[a:b]) for a, b in segment.chunks(texts, FIT_CHUNK)]
    x, weight = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    first = np.r_[0, np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    wide = around(np.clip((x - mean) / scale, -5, 5), first)
    label = np.repeat(y, np.diff(first))
    w, pairs, adam = np.zeros(width), np.zeros((2, 2)), Adam(0.05)
    inner = np.ones(len(label), bool)
    inner[first[:-1]] = False
    seen = np.array([[(inner & (label == 0)).sum(), 0], [0, (inner & (label == 1)).sum()]])
    for _ in range(rounds):
        p, counts = marginals(wide @ w, pairs, first)
        adam.step(w=(w, wide.T @ (p - label) / len(label) + ridge * w), pairs=(pairs, (counts - seen) / len(label) + 0.05 * pairs))
    good = _shares(marginals(wide @ w, pairs, first)[0], weight, first)
    curve, adam = np.zeros(2), Adam(0.1)
    for _ in range(600):
        off = (sigmoid(curve[0] * (good - 0.5) + curve[1]) - y) / len(y)
        adam.step(curve=(curve, np.array([off @ (good - 0.5), off.sum()]) + 1e-4 * curve))
    curve[1] += prior_shift(y, share)
    return Model(w, pairs, mean, scale, curve)


def scores(model: Model, texts: list[str]) -> np.ndarray:
    x, weight, first = lines(texts)
    wide = around(np.clip((x - model.mean) / model.scale, -5, 5), first)
    good = _shares(marginals(wide @ model.weights, model.pairs, first)[0], weight, first)
    return sigmoid(model.curve[0] * (good - 0.5) + model.curve[1])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, max_chars: int = SAMPLE_CHARS) -> Model:
    usable = fold(F.col("doc_id"), FOLDS) != HELD_OUT
    return fit(*sample(docs, labels, "quality", usable, rows, max_chars))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns named by ``keep`` (doc_id), and the score by a name that isn't among them."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or ["doc_id"]
    wide = list(dict.fromkeys([*keep, "text"]))
    at, rows = wide.index("text"), numbered_columns(docs.select(*[column(c) for c in wide]))

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            out = np.empty(len(texts))
            for a, b in segment.chunks(texts):
                out[a:b] = scores(held.value, texts[a:b])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out)], names=[*batch.schema.names[: len(keep)], "score"])

    schema = StructType(rows.schema.fields[: len(keep)]).add("score", "double")
    return bounded_batches(rows).mapInArrow(tidy(run), schema).toDF(*keep, name)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    name = fresh("_score", docs)
    return score(docs, train(docs, labels), docs.columns, name).where(F.col(name) >= THRESHOLD).select(*[column(c) for c in docs.columns])
