"""Language identification by multilingual mixtures of n-gram models.

The words of a text, lower-cased runs of letters with a blank on either side,
give its n-grams of ORDER characters, hashed to buckets.  Each language learned
has a probability for every bucket, from a bounded sample of labelled documents,
drawn towards the share that the bucket has over all languages.

A document is taken as a mixture: every n-gram comes from one of its languages.
Expectation-maximisation estimates the languages' proportions.  The set of
languages is selected by penalised likelihood: the languages are ordered by
their proportions among all, the best single one is the first set, and sets
grow by the next language in that order as long as the likelihood gains more
than a language costs, half the logarithm of the number of n-grams for its
proportion.  As each letter is in ORDER n-grams, log-likelihoods are divided by
ORDER first.  The language with the largest proportion in the selected set is
the document's.  A document's own estimates start from its own n-grams alone,
so documents don't depend on each other.

The score is that proportion, times the probability of the language against the
next likely single one where the set is one language.

Defined results: null texts and those without letters are ``und`` with score 0;
so is every document when nothing was learned; rows with null text or null
language teach nothing; null ids count as fold 0 and so teach nothing; equal
proportions go to the language that sorts first; extra columns are ignored;
whole texts are used, a long one in parts that are added up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm import segment
from spindrift.llm.common import bounded_batches, tidy
from spindrift.llm.labelled import fold

ORDER, BITS = 3, 18
#: The bound of the training sample: so many documents in all, as many of each language, of up to so many characters each.
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 5000
HELD_OUT, FOLDS = 0, 5
UNKNOWN = "und"
#: How many n-grams of the overall distribution a language's counts are drawn towards.
PRIOR = 200.0
#: Rounds of expectation-maximisation: with all languages, to order them, and within a set.
FEW_ROUNDS, ROUNDS = 6, 16
#: What another language costs, in units of half the logarithm of the number of n-grams.
COST = 2.0
_BLANK = 0x20
#: Cells of (n-gram, language) that are held at a time.
CELLS = 1 << 22


@dataclass
class Model:
    """Languages in order, and the logarithm of each bucket's probability in each."""

    languages: list[str]
    log_p: np.ndarray


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of each text's different n-grams, in order, and whether each text has a letter."""
    cp, at = segment.points([f" {t.lower()} " for t in texts])
    letters = segment.classes()[cp] == segment.LETTER
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    some = np.bincount(owner[letters], minlength=len(texts)) > 0
    cp = np.where(letters, cp, _BLANK)
    keep = np.r_[True, letters[1:] | letters[:-1]] if len(cp) else np.empty(0, bool)
    keep[at[:-1]] = True
    owner, cp = owner[keep], cp[keep]
    if len(cp) < ORDER:
        return (np.empty(0, np.int64),) * 3 + (some,)
    mixed = (segment._mix_table()[cp] >> np.uint64(32)).astype(np.uint32)
    h = mixed[: len(cp) - ORDER + 1].copy()
    for k in range(1, ORDER):
        h = h * np.uint32(0x9E3779B1) + mixed[k : len(cp) - ORDER + 1 + k]
    bucket = ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
    own = owner[: len(h)] == owner[ORDER - 1 :]
    for k in range(1, ORDER - 1):
        own &= cp[k : len(h) + k] != _BLANK
    pairs, count = np.unique(owner[: len(h)][own] << BITS | bucket[own].astype(np.int64), return_counts=True)
    return pairs >> BITS, pairs & ((1 << BITS) - 1), count, some


def _in_parts(texts: list[str], n_lang: int = 1):
    """(first text, end, n-grams) of texts that fit together; a long text comes alone, its parts added up."""
    most = max(1024, min(segment.CHUNK, CELLS // max(1, n_lang)))
    for a, b in segment.chunks(texts, most):
        if b - a == 1 and len(texts[a]) > most:
            total, some = np.zeros(1 << BITS, np.int64), False
            for part in _parts(texts[a], most):
                _, bucket, count, has = grams([part])
                total[bucket] += count
                some |= bool(has[0])
            bucket = np.flatnonzero(total)
            yield a, b, np.zeros(len(bucket), np.int64), bucket, total[bucket], np.array([some])
        else:
            yield a, b, *grams(texts[a:b])


def _parts(text: str, most: int = segment.CHUNK):
    """Pieces that end where a word does, or after ``most`` characters of a longer word."""
    at = 0
    while at < len(text):
        end = min(len(text), at + most)
        back = end
        while end < len(text) and back > at and text[back - 1].isalpha():
            back -= 1
        end = back if back > at else end
        yield text[at:end]
        at = end


def proportions(sizes: np.ndarray, p: np.ndarray, count: np.ndarray, n: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation for many documents: by language and document the proportions, the log-likelihood, and the most that any proportions of the allowed languages reach.

    ``p``: by language and n-gram the probability, scaled by the n-gram's largest; ``sizes``: how many n-grams in a row are a document's, at least one;
    ``n``: their counts' sums.  The last comes from the slopes: the likelihood is concave in the proportions."""
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    theta, used = allowed / allowed.sum(axis=0), np.flatnonzero(allowed.any(axis=1))
    for k in range(rounds + 1):
        weights = {j: p[j] * np.repeat(theta[j], sizes) for j in used}
        mix = sum(weights.values())
        each = count / mix
        if k < rounds:
            for j in used:
                theta[j] = np.add.reduceat(weights[j] * each, first) / n
    like = np.add.reduceat(count * np.log(mix), first)
    slopes = np.max([np.where(allowed[j], np.add.reduceat(p[j] * each, first), 0) for j in used], axis=0)
    return theta, like, like + slopes - n


def identify(model: Model, doc: np.ndarray, bucket: np.ndarray, count: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document the number of its language, and the score."""
    n_lang = len(model.languages)
    log_p = np.ascontiguousarray(model.log_p[bucket].T)
    log_p -= log_p.max(axis=0)
    count = count.astype(float)
    n, sizes = np.bincount(doc, count, n_docs), np.bincount(doc, minlength=n_docs)
    single = np.stack([np.bincount(doc, count * x, n_docs) for x in log_p])
    chosen = single.argmax(axis=0)
    if n_lang == 1:
        return chosen, np.ones(n_docs)
    like = single[chosen, np.arange(n_docs)]
    gap = (like - np.sort(single, axis=0)[-2]) / ORDER
    score = 1 / (1 + np.exp(-np.minimum(gap, 60)))
    cost = ORDER * COST * np.log(np.maximum(n, 2)) / 2
    p = np.exp(log_p)

    def estimated(active, allowed, rounds):
        own = np.zeros(n_docs, bool)
        own[active] = True
        rows = own[doc]
        return proportions(sizes[active], p[:, rows], count[rows], n[active], allowed, rounds)

    # No mixture is likelier than each n-gram's best language, which scaled probabilities make 0, nor than what all languages together reach:
    # where that can't pay for another language, one stays.
    active = np.flatnonzero(-like > cost)
    if len(active):
        every, _, most = estimated(active, np.ones((n_lang, len(active))), FEW_ROUNDS)
        pays = most - like[active] > cost[active]
        active, order = active[pays], np.argsort(-every[:, pays], axis=0, kind="stable")
    for size in range(2, n_lang + 1):
        if not len(active):
            break
        allowed = np.zeros((n_lang, len(active)))
        np.put_along_axis(allowed, order[:size], 1.0, axis=0)
        theta, got, _ = estimated(active, allowed, ROUNDS)
        more = got - like[active] > cost[active]
        active, order, theta = active[more], order[:, more], theta[:, more]
        like[active], chosen[active], score[active] = got[more], theta.argmax(axis=0), theta.max(axis=0)
    return chosen, np.clip(score, 0, 1)


def fit(texts: list[str], langs: list[str]) -> Model:
    languages = sorted(set(langs))
    counts = np.zeros((1 << BITS, len(languages)))
    place = {x: k for k, x in enumerate(languages)}
    y = np.array([place[x] for x in langs], int)
    for a, _, doc, bucket, count, _ in _in_parts(texts):
        np.add.at(counts, (bucket, y[a + doc]), count)
    total = counts.sum(axis=0)
    shared = (counts / np.maximum(total, 1)).mean(axis=1) if languages else np.zeros(1 << BITS)
    shared = 0.99 * shared + 0.01 / len(shared)
    return Model(languages, np.log((counts + PRIOR * shared[:, None]) / (total + PRIOR)).astype(np.float32))


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, max_chars: int = SAMPLE_CHARS) -> Model:
    """Fitted on up to ``rows`` documents of the folds that aren't held out, equally many of each language, chosen by a hash of the id; of a longer text a piece that the id picks."""
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    known = usable.select("doc_id", F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("hash"))
    # Languages with few rows come first, so that none is left out as long as there are no more than `rows` of them.
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "lang").limit(rows).collect()
    if not sizes:
        return Model([], np.zeros((1 << BITS, 0), np.float32))
    each = max(1, rows // len(sizes))
    # A hash below the bound lets some more than `each` rows of a language pass; the first of these are taken.
    span = float(1 << 64)
    bounds = [(r["lang"], min(1.0, (2 * each + 50) / r["n"])) for r in sizes]
    limits = F.broadcast(docs.sparkSession.createDataFrame(bounds, "_lang string, _share double"))
    drawn = known.join(limits, F.col("lang") == F.col("_lang")).where((F.col("hash").cast("double") / span + 0.5) <= F.col("_share"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id"))
    drawn = drawn.withColumn("_nth", nth).where(F.col("_nth") <= each).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_of")).dropDuplicates(["_id"])
    pieces = F.greatest(F.ceil(F.char_length("text") / max_chars), F.lit(1))
    piece = F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id"), pieces) * max_chars + 1).cast("int"), F.lit(max_chars))
    got = usable.select("doc_id", "lang", piece.alias("piece")).join(F.broadcast(drawn), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_of")))
    table = got.groupBy("doc_id", "lang").agg(F.min("piece").alias("piece")).toArrow().sort_by("doc_id")  # one row of an id
    return fit(table["piece"].to_pylist(), table["lang"].to_pylist())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found, score = np.full(len(texts), len(model.languages)), np.zeros(len(texts))
            for a, b, doc, bucket, count, some in _in_parts(texts, len(model.languages)) if model.languages else ():
                own = identify(model, doc, bucket, count, b - a)
                found[a:b], score[a:b] = np.where(some, own[0], len(model.languages)), np.where(some, own[1], 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[found], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    out = predict(docs, train(docs))
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
