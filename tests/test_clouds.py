"""Word clouds against a restatement in plain Python."""

from collections import Counter
from itertools import pairwise
from math import log

import numpy as np
from pyspark.sql import functions as F

from spindrift.operators import stats


def plain(texts, pairs):
    counted = Counter(w for t in texts for w in t)
    lower = {w.lower() for w in counted}
    root = {w: w.lower()[:-1] if w.lower().endswith("s") and not w.lower().endswith("ss") and w.lower()[:-1] in lower else w.lower() for w in counted}
    spelt = {}
    for w, n in counted.items():
        spelt.setdefault(root[w], Counter())[w[:-1] if root[w] != w.lower() else w] += n
    form = {w: min(spelt[root[w]].items(), key=lambda x: (-x[1], x[0]))[0] for w in counted}
    words = Counter()
    for w, n in counted.items():
        words[form[w]] += n
    if not pairs:
        return dict(words)
    both, total = Counter((form[a], form[b]) for t in texts for a, b in pairwise(t)), sum(words.values())
    like = lambda k, n, x: log(max(x, 1e-10)) * k + log(max(1 - x, 1e-10)) * (n - k)
    out = Counter(words)
    for (a, b), n in both.items():
        p, p1, p2 = words[b] / total, n / words[a], (words[b] - n) / (total - words[a]) if total > words[a] else 0
        if -2 * (like(n, words[a], p) + like(words[b] - n, total - words[a], p) - like(n, words[a], p1) - like(words[b] - n, total - words[a], p2)) > stats.COLLOCATION:
            out[a] -= n
            out[b] -= n
            out[f"{a} {b}"] = n
    return {w: n for w, n in out.items() if n > 0}


def test_clouds(spark):
    rng = np.random.default_rng(3)
    words = np.array(["cat", "cats", "Cat", "CATS", "dog", "gas", "glass", "glas", "x", "s", "new", "york", "ice", "cream", "bus"])
    texts = [[str(w) for w in rng.choice(words, rng.integers(0, 12))] + (["new", "york"] * 2 if k % 3 == 0 else []) for k in range(120)] + [[], ["York", "alone"]]
    rows = [(k % 2, t) for k, t in enumerate(texts)] + [(None, ["new", "york"] * 9)]
    df = spark.createDataFrame(rows, "of int, t array<string>")
    for pairs in (True, False):
        got = {r.word: r.n for r in stats.cloud(df, F.col("t"), by=None, pairs=pairs, fold=True).collect()}
        assert got == plain([t for _, t in rows], pairs)
        by = {}
        for r in stats.cloud(df, F.col("t"), by="of", pairs=pairs, fold=True).collect():
            by.setdefault(r.of, {})[r.word] = r.n
        assert by == {of: plain([t for o, t in rows if o == of], pairs) for of in (0, 1, None)}
    assert "new york" in plain([t for _, t in rows], True)
    first = stats.cloud(df, F.col("t"), 1).collect()
    assert len(first) == 1 and first[0].weight == 1
    assert stats.cloud(df.where("of = 9"), F.col("t"), pairs=True, fold=True).count() == 0


def test_texts_are_read_twice_at_most(spark):
    """Once for words and once for pairs, however often their counts are used."""
    read = spark.sparkContext.accumulator(0)

    def split(t):
        read.add(1)
        return t.split(" ")

    df = spark.createDataFrame([(k % 2, f"one Two twos word{k}") for k in range(50)], "c int, t string").repartition(2).localCheckpoint()
    stats.cloud(df, F.udf(split, "array<string>")(F.col("t")), by="c", pairs=True, fold=True).collect()
    assert read.value <= 200, read.value  # each branch may ask for a row's words twice, as a filter and as a value
