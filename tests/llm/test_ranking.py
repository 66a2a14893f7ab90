import math
import re

import numpy as np
import pytest
from pyspark.sql import Row

from spindrift.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items):
    held = [(d, plain(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, text in items:
        asked.setdefault(i, set()).update(plain(text))
    out = []
    for i, terms in asked.items():
        scores = []
        for d, w in held:
            m = 10 + 90 * len(w) * n_docs // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in terms if t in w)
            if s > 0:
                scores.append((-s, math.inf if d is None else d))
        out += [(i, k, None if d == math.inf else d, -s) for k, (s, d) in enumerate(sorted(scores)[:10], 1)]
    return sorted(out, key=str)


def corpus(rng, n):
    common, rare = ["the", "Of", "a1", "ñu"], [f"w{k}" for k in range(300)]
    docs = [(k, " ".join([*rng.choice(common, rng.integers(0, 40)), *rng.choice(rare, rng.integers(0, 30), p=np.arange(300, 0, -1) / np.arange(300, 0, -1).sum())])) for k in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " -- \x00\n"), (5, docs[5][1]), (None, docs[6][1]), (n + 3, docs[7][1]), (n + 4, "w299 " * 3000), (n + 5, "É" * 50 + "\x00the\x7fw1\t")]
    items = [(k, " ".join([*rng.choice(common, 3), *rng.choice(rare, 6)])) for k in range(20)] + [(100, None), (101, "unheard"), (3, "w298"), (None, "w7, W8; ñu")]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([Row(doc_id=d, text=t, n=1, terms="x", item=2) for d, t in docs], "doc_id long, text string, n int, terms string, item int"), spark.createDataFrame([Row(item_id=i, text=t) for i, t in items], "item_id long, text string")


@pytest.mark.parametrize("how", [{}, {"first": 8, "growth": 4}, {"first": 1, "growth": 2, "block_terms": 40}])
def test_ranks_equal_brute_force(spark, how):
    """One tier, several, and several blocks of items; null, empty and repeated rows, ties, clashing names."""
    docs, items = corpus(np.random.default_rng(2), 600)
    got = [tuple(r) for r in ranking.search(*frames(spark, docs, items), **how).collect()]
    assert sorted(got, key=str) == brute(docs, items)


def test_proof_and_falling_through(spark):
    """Items of rare words are proven in the first tier, those of common ones fall through."""
    rng = np.random.default_rng(4)
    docs = [(k, " ".join(rng.choice(["the", "of", "and"], 20)) + (f" key{k % 40} key{k % 40}" if k % 3 else "")) for k in range(1200)]
    items = [(k, f"key{k} the") for k in range(10)] + [(50, "the of and")]
    d, i = frames(spark, docs, items)
    told = {}
    rows = [(r["item_id"], bytes(r["term"])) for r in ranking.item_terms(i).collect()]
    got = [tuple(r) for r in ranking.search_block(d, ranking.Block(rows), first=40, growth=4, told=told).collect()]
    assert sorted(got, key=str) == brute(docs, items)
    assert told[0] == 10 and len(told) > 1


def test_empty(spark):
    d, i = frames(spark, [], [])
    assert ranking.search(d, frames(spark, [], [(1, "a")])[1]).count() == 0
    assert ranking.search(frames(spark, [(1, "a")], [])[0], i).count() == 0
    assert ranking.search(*frames(spark, [(1, "--"), (2, None)], [(1, "a")])).count() == 0


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(ranking, "CHUNK", 7)
    for text in ("", "abc", "aa bb  cccccccccccccccccccc d" * 5, "x" * 50, "ab-cd_Éf " * 20, " " * 30):
        assert [w for part in ranking.words(text.encode()) for w in part] == [w.encode() for w in plain(text)]
