"""The normaliser's edge cases, against a restatement in plain Python."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spindrift.functions import text as T

CASES = [
    "don't go", "the, dogs.", "this is not good but ok", "the and of", "a b", "a\x1cb", "a　b", "a​b", "café", None, "", "   ", "One\nTwo  THREE\t four!",
    "dogs dog boxes box churches church ladies lady men wolves wolf", "children child", "however yet no", "İK K", "x" * 5000,
]


def plain(text):
    if text is None:
        return None
    text = re.sub("\n", " ", text.lower().strip())
    text = re.sub(r"[^A-Za-z0-9\s!?.,]", "", text)
    return " ".join(w for w in text.split() if w not in T.removed_stop_words())


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame(list(enumerate(CASES)), "id long, text string").cache()


def test_clean(cases):
    got = {r.id: r.out for r in cases.select("id", T.clean(F.col("text")).alias("out")).collect()}
    assert [got[k] for k in range(len(CASES))] == [plain(t) for t in CASES]
    assert got[0] == "dont go" and got[2] == "not good but ok" and got[3] == "" and got[9] is None


def test_counts(cases):
    c = F.col("text")
    rows = cases.select("text", T.word_count(c).alias("w"), F.char_length(c).alias("n"), T.punctuation_count(c).alias("p"), T.stop_word_count(c).alias("s")).where("text is not null").collect()
    for r in rows:
        assert (r.w, r.n) == (len(r.text.split()), len(r.text))
        assert r.p == sum(ch in T.PUNCTUATION for ch in r.text) and r.s == sum(w in T.STOP_WORDS for w in r.text.split())


def test_ngrams(cases):
    rows = cases.select("text", T.ngrams(T.analyzed(F.col("text")), 1, 3).alias("g")).where("text is not null").collect()
    for r in rows:
        words = re.findall(r"\b\w\w+\b", r.text.lower())
        assert Counter(r.g) == Counter(" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1))


def test_vectorizer_stop_words():
    assert len(T.VECTORIZER_STOP_WORDS) == 318 and sorted(T.VECTORIZER_STOP_WORDS) == T.VECTORIZER_STOP_WORDS


def test_cleaning_equals_its_steps(spark):
    """In batches as in single steps, for every white space and for what other alphabets have."""
    blanks = "".join(chr(k) for k in range(0x110000) if chr(k).isspace())
    texts = [None, "", " \n", "The NOT but\tisn't don't?", "\u0130stanbul \u212a na\u00efve\u00a0caf\u00e9", "a.b!c,d?e;f_g", "\x00\x7f\u200bx", *[f"not{b}x{b}{b}yet" for b in blanks]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    steps = T.joined(T.without(T.tokens(T.whitelist(T.newline_to_space(T.strip(F.lower("t"))))), T.removed_stop_words()))
    for r in df.select("t", T.clean(F.col("t")).alias("got"), steps.alias("want"), T.cleaned_words(T.clean(F.col("t"))).alias("words"), T.tokens(steps).alias("tokens")).collect():
        assert r.got == r.want and r.words == r.tokens, r
