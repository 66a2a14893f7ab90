import math
import zlib

import numpy as np
import pytest
from pyspark.sql import Row

from spindrift.llm import language

SYLLABLES = {"en": "th er on an re he in ed nd ha at en es of or nt ea ti to it st", "fr": "es le de en re nt on er ai ou qu eu la é è ç au oi", "de": "en er ch ei de ie in te ge un nd ü ö ä sch st be", "es": "de en es la os ar ue ra ci ó ñ í á que do as"}
SCHEMA = "doc_id long, text string, lang string, source string"


def prose(rng, lang, words):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s, rng.integers(1, 4))) for _ in range(words))


def corpus(rng, n):
    return [(k, prose(rng, lang, int(rng.integers(3, 60))), lang, "s") for k in range(n) for lang in [list(SYLLABLES)[k % 4]]]


def plain_grams(text):
    held = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    held += " " if held.strip() else ""
    return [g for i in range(len(held) - 2) if (g := held[i : i + 3])[1] != " "]


def plain_identify(p):
    """One document, n-gram by n-gram: ``p`` has the probabilities of each in all languages."""
    n_lang = len(p[0])

    def mixture(allowed, rounds):
        theta = [1 / len(allowed) if k in allowed else 0.0 for k in range(n_lang)]
        for _ in range(rounds):
            sums = [0.0] * n_lang
            for row in p:
                whole = sum(a * b for a, b in zip(theta, row, strict=True))
                for k in range(n_lang):
                    sums[k] += theta[k] * row[k] / whole
            theta = [x / len(p) for x in sums]
        return theta, sum(math.log(sum(a * b for a, b in zip(theta, row, strict=True))) for row in p)

    like = [sum(math.log(row[k]) for row in p) for k in range(n_lang)]
    best = max(range(n_lang), key=lambda k: (like[k], -k))
    held = like[best]
    every, _ = mixture(range(n_lang), language.FEW_ROUNDS)
    order = sorted(range(n_lang), key=lambda k: -every[k])
    cost = language.ORDER * language.COST * math.log(max(len(p), 2)) / 2
    for size in range(2, n_lang + 1):
        theta, got = mixture(order[:size], language.ROUNDS)
        if got - held <= cost:
            break
        held, best = got, max(range(n_lang), key=lambda k: theta[k])  # noqa: B023
    return best


def test_grams_equal_plain_ones():
    texts = ["", "a", "Ab, ab ab!", "ñandú " * 3, "x" * 50, "123 --", " É ß ", "Ontier erersh lyor"]
    doc, bucket, count, some = language.grams(texts)
    for k, t in enumerate(texts):
        want = plain_grams(t)
        assert (doc == k).sum() == len(set(want)) and count[doc == k].sum() == len(want)
        assert some[k] == any(c.isalpha() for c in t)


def test_mixtures_equal_plain_ones():
    rng = np.random.default_rng(3)
    rows = corpus(rng, 200)
    model = language.fit([r[1] for r in rows], [r[2] for r in rows])
    asked = [prose(rng, a, int(rng.integers(1, 40))) + " " + prose(rng, b, int(rng.integers(0, 40))) for a in SYLLABLES for b in SYLLABLES for _ in range(3)]
    doc, bucket, count, _ = language.grams(asked)
    got, score = language.identify(model, doc, bucket, count, len(asked))
    for k in range(len(asked)):
        p = np.exp(model.log_p[np.repeat(bucket[doc == k], count[doc == k])].astype(float))
        assert plain_identify(p.tolist()) == got[k], asked[k]
    assert ((score >= 0) & (score <= 1)).all()


def test_language_sets():
    """Half and half is two languages; one language stays one."""
    rng = np.random.default_rng(5)
    rows = corpus(rng, 400)
    model = language.fit([r[1] for r in rows], [r[2] for r in rows])
    both = [prose(rng, "fr", 30) + " " + prose(rng, "de", 60) for _ in range(20)]
    doc, bucket, count, _ = language.grams(both)
    got, score = language.identify(model, doc, bucket, count, len(both))
    assert [model.languages[k] for k in got] == ["de"] * 20 and (score < 0.9).all() and (score > 0.5).all()
    one = [prose(rng, "es", 80) for _ in range(20)]
    doc, bucket, count, _ = language.grams(one)
    got, score = language.identify(model, doc, bucket, count, len(one))
    assert [model.languages[k] for k in got] == ["es"] * 20 and (score > 0.99).all()


@pytest.mark.parametrize("rows", [language.SAMPLE_ROWS, 40])
def test_held_out_accuracy(spark, rows):
    docs = corpus(np.random.default_rng(7), 1500)
    df = spark.createDataFrame(docs, SCHEMA)
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(df, language.train(df, rows)).collect()}
    asked = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 5 == 0]
    assert len(got) == 1500 and np.mean([got[d[0]] == d[2] for d in asked]) > 0.97


def test_edges(spark):
    """Null and empty texts, texts without letters, null langs and ids, repeated ids, long texts, clashing names, a rare language."""
    rng = np.random.default_rng(9)
    docs = [(*d, 1, "x") for d in corpus(rng, 300)]
    long_text = prose(rng, "fr", 60_000)
    docs += [(1000, None, "en", "s", 1, "x"), (1001, "", "fr", "s", 1, "x"), (1002, "12 -- 3!", "de", "s", 1, "x"), (1003, "the on", None, "s", 1, "x"), (None, prose(rng, "es", 40), "xx", "s", 1, "x"), (7, prose(rng, "de", 20), "de", "s", 1, "x"), (1005, long_text, None, "s", 1, "x")]
    rare = next(k for k in range(2000, 2100) if zlib.crc32(str(k).encode()) % 5 != 0)
    docs += [(rare, "kwyjx zzyxk qqwz " * 30, "qq", "s", 1, "x"), (5000, "kwyjx qqwz kwyjx", None, "s", 1, "x")]
    df = spark.createDataFrame([Row(*d) for d in docs], SCHEMA + ", lang_pred int, _share string")
    got = language.classify(df).collect()
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got}
    assert [by[k]["lang_pred"] for k in (1000, 1001, 1002)] == ["und"] * 3 and by[1000]["score"] == 0
    assert by[None]["lang_pred"] == "es" and by[None]["held_out"] and by[1005]["lang_pred"] == "fr" and by[5000]["lang_pred"] == "qq"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language.classify(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = language.classify(spark.createDataFrame([(1, "a b", None, "s")], SCHEMA)).first()
    assert (nothing["lang_pred"], nothing["score"]) == ("und", 0)


def test_long_texts_add_up():
    text = prose(np.random.default_rng(1), "de", 3000)
    pieces = list(language._parts(text, 500))
    assert "".join(pieces) == text and all(len(p) <= 500 for p in pieces)
    whole = language.grams([text])
    added = np.zeros(1 << language.BITS, int)
    for p in pieces:
        _, bucket, count, _ = language.grams([p])
        added[bucket] += count
    assert (np.flatnonzero(added) == whole[1]).all() and (added[whole[1]] == whole[2]).all()
