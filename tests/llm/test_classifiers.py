import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import labelled, quality, toxicity


def brute_marginals(good, pairs):
    """By every labelling of the chain."""
    n = len(good)
    p, counts, total = np.zeros(n), np.zeros((2, 2)), 0.0
    for code in range(2**n):
        y = [code >> k & 1 for k in range(n)]
        w = np.exp(sum((good[k] / 2) * (1 if y[k] else -1) for k in range(n)) + sum(pairs[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        p += w * np.array(y)
        for a, b in zip(y, y[1:], strict=False):
            counts[a, b] += w
    return p / total, counts / total


def test_marginals():
    rng = np.random.default_rng(3)
    sizes, pairs = [1, 5, 3, 7, 2], rng.normal(size=(2, 2))
    first = np.r_[0, np.cumsum(sizes)]
    good = rng.normal(size=first[-1]) * 2
    got, counts = quality.marginals(good, pairs, first)
    want = [brute_marginals(good[a:b], pairs) for a, b in zip(first, first[1:], strict=False)]
    assert np.allclose(got, np.concatenate([w[0] for w in want])) and np.allclose(counts, sum(w[1] for w in want))


def test_toxic_features_are_distinct_ngrams():
    texts = ["", "a", "Ab, ab ab!", "ñandú " * 3, "x" * 50]
    doc, bucket = toxicity.features(texts)
    for k, t in enumerate(texts):
        clean = " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split())
        clean = clean + " " if clean.strip() else " "
        grams = {clean[i : i + n] for n in toxicity.ORDERS for i in range(len(clean) - n + 1)}
        assert (doc == k).sum() == len(grams)


def toxic_corpus(rng, toxic, counts):
    """Texts of the same kind; the first ``counts[0]`` hold one of the toxic words each, in turn, the other ``counts[1]`` none."""
    syllables = ["mel", "low", "ri", "ver", "sto", "ne", "un", "der", "clo", "ud", "tre", "wal", "ks", "li", "ght"]
    plain = lambda: " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(rng.integers(10, 60)))
    return [f"{plain()} {toxic[k % len(toxic)] if k < counts[0] else ''} {plain()}" for k in range(sum(counts))]


@pytest.mark.parametrize(("counts", "words"), [((1000, 1000), 100), ((10, 58), 2)])
def test_rare_toxic_words_count(counts, words):
    """Words in one of a hundred toxic documents each, and a table of few labels."""
    rng = np.random.default_rng(1)
    toxic = ["".join(rng.choice(list("bcdfghjkqvwxyz"), 7)) for _ in range(words)]
    model = toxicity.fit(toxic_corpus(rng, toxic, counts), np.arange(sum(counts)) < counts[0], counts[0] / sum(counts))
    asked = toxic_corpus(rng, toxic, (200, 200))
    doc, bucket = toxicity.features(asked)
    got = model.bias + np.bincount(doc, model.weights[bucket], len(asked)) >= 0
    assert got[:200].mean() > 0.9 and got[200:].mean() < 0.1


def plain_toxicity(texts, y, share, asked):
    """The fit and the scores once more: sets of n-grams, dense features, plain gradient steps."""

    def grams(t):
        clean = " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split())
        clean = clean + " " if clean.strip() else " "
        return {clean[i : i + n] for n in toxicity.ORDERS for i in range(len(clean) - n + 1)}

    held = [grams(t) for t in texts]
    often = sorted({g for x in held for g in x})
    often = [g for g in often if sum(g in x for x in held) >= toxicity.LEAST_DOCS]
    x = np.array([[g in h for g in often] for h in held], float)
    one, zero = x[y == 1].sum(axis=0), x[y == 0].sum(axis=0)
    ratio = np.log((1 + one) / (1 + y.sum()) / ((1 + zero) / (1 + (1 - y).sum())))
    part, n = y.mean(), one + zero
    deviance = 2 * (one * np.log(np.maximum(one, 1) / (n * part)) + zero * np.log(np.maximum(zero, 1) / (n * (1 - part))))
    ratio = ratio * deviance / (deviance + toxicity.NOISE)
    scaled, w, b = x * ratio, np.zeros(len(often)), 0.0
    for _ in range(6000):
        off = 1 / (1 + np.exp(-(scaled @ w + b))) - y
        w, b = w - 0.01 * (scaled.T @ off + toxicity.RIDGE * w), b - 0.01 * off.sum()
    b += np.log(share / (1 - share)) - np.log(part / (1 - part))
    return np.array([1 / (1 + np.exp(-(sum(w[k] * ratio[k] for k, g in enumerate(often) if g in grams(t)) + b))) for t in asked])


def test_toxicity_against_a_plain_fit(monkeypatch):
    monkeypatch.setattr(toxicity, "least", lambda loss, x, rounds: labelled.least(loss, x, 400, close=1e-7))
    rng = np.random.default_rng(2)
    texts, y = toxic_corpus(rng, ["grumble"], (15, 25)), (np.arange(40) < 15).astype(float)
    asked = [*toxic_corpus(rng, ["grumble"], (5, 5)), "", "12 !?"]
    model = toxicity.fit(texts, y, 0.2)
    doc, bucket = toxicity.features(asked)
    got = labelled.sigmoid(model.bias + np.bincount(doc, model.weights[bucket], len(asked)))
    assert np.abs(got - plain_toxicity(texts, y, 0.2, asked)).max() < 2e-3


def test_quality_scores_by_every_labelling():
    """A document's score from the chain's marginals by brute force, its lines' lengths and the fitted curve."""
    rng = np.random.default_rng(4)
    line = lambda good: " ".join(rng.choice(["mellow", "river", "stone", "and"], rng.integers(2, 9))) + ("." if good else " !!! ##")
    texts = ["\n".join(line(k % 2) for _ in range(rng.integers(1, 6))) for k in range(60)]
    model = quality.fit(texts, np.arange(60) % 2.0, 0.5, rounds=30)
    asked = [*texts[:6], "", "one line", "a\n\nb"]
    x, weight, first = quality.lines(asked)
    good = quality.around(np.clip((x - model.mean) / model.scale, -5, 5), first) @ model.weights
    want = []
    for a, b in zip(first, first[1:], strict=False):
        p, _ = brute_marginals(good[a:b], model.pairs)
        want.append(1 / (1 + np.exp(-(model.curve[0] * ((p * weight[a:b]).sum() / weight[a:b].sum() - 0.5) + model.curve[1]))))
    assert np.allclose(quality.scores(model, asked), want)
    assert [w - 1 for w in weight[first[0] : first[1]]] == [len(t) for t in asked[0].split("\n")]


def test_long_documents_stay_in_the_sample(spark):
    docs = spark.createDataFrame([(i, "".join(chr(97 + (k + i) % 26) for k in range(95 + i))) for i in range(40)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    texts, y, _ = labelled.sample(docs, known, "toxic", F.lit(True), 1000, 30)
    assert len(texts) == 40 and all(0 < len(t) <= 30 for t in texts) and y.sum() == 20


def test_ties_and_extra_columns(spark):
    """Equal texts have equal scores, whatever stands beside them."""
    docs = spark.createDataFrame([(i, "same text", "x", i % 3) for i in range(30)], "doc_id long, text string, held_out string, predicted int")
    known = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    got = toxicity.classify(docs, known).collect()
    assert len({r.score for r in got}) == 1 and len(got) == 30


@pytest.mark.parametrize(("operator", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_accuracy_and_edges(spark, operator, label):
    rng = np.random.default_rng(5)
    words = ["mellow", "river", "stone", "under", "cloud", "tree", "walks", "light", "and", "the"]
    rows, labels = [], []
    for i in range(600):
        y = int(rng.random() < 0.5)
        lines = [" ".join(rng.choice(words, 8)).capitalize() + "." for _ in range(rng.integers(1, 6))]
        if label == "quality" and not y:
            lines = [x.upper().replace(" ", "!! ") for x in lines]
        if label == "toxic" and y:
            lines[0] += " You awful grumblewort" + str(rng.choice(["s", "ing", ""]))
        rows.append((i, "\n".join(lines), "en"))
        labels.append((i, y if i % 7 else None))
    rows += [(1000, None, "en"), (1001, "", None), (None, "x", "en"), (3, rows[3][1], "en"), (1002, "ab " * 40_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame(labels + [(None, 1), (1, labels[1][1])], f"doc_id long, {label} int")
    got = operator.classify(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= operator.THRESHOLD) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % operator.FOLDS == operator.HELD_OUT) for r in got if r.doc_id is not None)
    truth = dict(labels)
    held = [r for r in got if r.held_out and truth.get(r.doc_id) is not None]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    assert operator.classify(docs, none).count() == len(rows)
    assert operator.classify(docs.limit(0), known).count() == 0


def test_learns_from_its_fold_alone(spark):
    docs = spark.createDataFrame([(i, "t") for i in range(200)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    texts, y, share = labelled.sample(docs, known, "toxic", labelled.fold(F.col("doc_id"), 5) != 0, 1000, 100)
    assert len(texts) == len(y) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(200))


def test_keep_good_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "Plain words here.", "en", "s", 17)], "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.keep_good(docs, known).collect()[0].asDict() == docs.collect()[0].asDict()


def test_sample_is_bounded_where_ids_repeat(spark):
    """Thousands of rows of one id, and of one label, give one text."""
    docs = spark.createDataFrame([(1, f"text {k:05d}") for k in range(3000)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 50 + [(1, 0), (2, 1)], "doc_id long, toxic int")
    texts, y, _ = labelled.sample(docs, labels, "toxic", F.lit(True), 10, 100)
    assert texts == ["text 00000", "other"] and y.tolist() == [0, 1]
