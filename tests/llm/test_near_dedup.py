import math
import random
import re

import pytest

from spindrift.llm import near_dedup as op
from spindrift.llm.components import components


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {i: sets_of(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 7)))
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", " \n\t", "One", "one ", "a b c d", "A B\x0bC D", "a b c d e f", "x " * 50]
    for _ in range(n // 8):
        base = [word() for _ in range(rng.choice([5, 8, 40, 150, 400, 900]))]
        texts.append(" ".join(base))
        for _ in range(7):
            copy = list(base)
            for _ in range(int(rng.random() * 0.035 * len(copy)) + rng.randrange(2)):
                copy[rng.randrange(len(copy))] = word()
            texts.append((passage + " " if rng.random() < 0.3 else "") + " ".join(copy))
    texts += [rng.choice(texts) for _ in range(20)]
    rng.shuffle(texts)
    return [(5 * k + 3, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "block", "k"), [(1, 2048, 256), (2, 3, 64), (3, 2048, 64)])
def test_against_brute_force(spark, seed, block, k, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", block)
    monkeypatch.setattr(op, "K", k)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, [1], 0) for i, t in rows], "doc_id long, text string, low array<int>, rep int").repartition(4)
    got = op.dedup(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "A b c d e f"), (None, "z"), (None, None), (4, None)], "doc_id long, text string")
    got = sorted(map(tuple, op.dedup(docs).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 1, None, True), (None, 0, None, True), (4, 0, 4, True)], key=repr)
    assert op.keep_one(docs).where("doc_id is not null").count() == 2
    assert op.dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_few_words_alone(n):
    """A batch whose texts together have so many words."""
    text = " ".join("abcde"[:n])
    (got,), (beside, _) = op.shingle_sets([text]), op.shingle_sets([text, "some more words of another text"])
    assert len(got) == 1 and got.tolist() == beside.tolist()


def test_table_of_two_words(spark):
    docs = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    assert [tuple(r) for r in op.dedup(docs).collect()] == [(1, 1, 1, True)]


@pytest.mark.parametrize("n", [32, 256, 277, 400, 512])
def test_bound_of_the_binomial_tail(n):
    """A link falls short of the count that the filter asks for with the stated chance at most; the tail is summed up here term by term."""
    p, least = op.SHARE / 100, op.least_shared(n)
    below = lambda k: sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k))
    assert below(least) <= op.MISSED < below(least + 1)


def _template(n, words, own, seed=7):
    """n texts of one template, each with words of its own spread through it."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(words)]
    out = []
    for i in range(n):
        copy = list(base)
        for j, at in enumerate(rng.sample(range(words), own)):
            copy[at] = f"d{i}x{j}"
        out.append(" ".join(copy))
    return out


def test_pairs_of_a_template(spark):
    """Texts that all share about 0.8 with each other: nothing is linked, and few pairs are ever sent out."""
    n = 400
    texts = _template(n, 800, 9)
    sets = [set(x.tolist()) for x in op.shingle_sets(texts)]
    some = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(50)]
    assert 0.75 < sum(some) / 50 < 0.85
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sent = []
    stage = op.stage

    def counted(df, name, **options):
        out = stage(df, name, **options)
        if name in ("pairs", "further-links"):
            sent.append(out.count())
        return out

    op.stage = counted
    try:
        got = {r.doc_id: r.component_id for r in op.dedup(docs).collect()}
    finally:
        op.stage = stage
    assert got == {i: c for i, (_, c) in brute(rows).items()}
    assert sum(sent) < 60 * n < n * n / 2


@pytest.mark.parametrize("size", [op.BLOCK_BYTES, 1 << 14])
def test_second_pass_finds_what_the_first_left(spark, size, monkeypatch):
    """Links that no spanning forest of estimates holds, in blocks of few bytes too."""
    monkeypatch.setattr(op, "BLOCK_BYTES", size)
    monkeypatch.setattr(op, "COLUMNS", 128)
    rows = list(enumerate(_template(24, 900, 9) + _template(30, 900, 5)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in op.dedup(docs).collect()} == {i: c for i, (_, c) in brute(rows).items()}


def test_overlaps():
    rng = random.Random(1)
    sets = [{rng.randrange(300) for _ in range(rng.randrange(1, 200))} for _ in range(40)]
    got = op.overlaps([op.np.array(sorted(x), op.np.uint64) for x in sets])
    assert all(got[i, j] == len(sets[i] & sets[j]) for i in range(40) for j in range(40) if i != j)


def test_ids_on_different_texts(spark):
    """A repeated id doesn't hide links, and a text that is no near-duplicate isn't dropped for its id."""
    one, two, other = _template(2, 400, 3) + ["entirely different words stand in this text"]
    rows = [(7, one), (9, two), (9, other), (9, other), (8, two + " more"), (2, "few words"), (7, "short one")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, set_key string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op.dedup(docs).collect())
    assert [c for i, n, c in got if n > 300] == [7, 7, 7] and [(i, c) for i, n, c in got if n < 300] == [(2, 2), (7, 7), (9, 9), (9, 9)]
    stays = sorted((r.doc_id, r.text[:5]) for r in op.keep_one(docs).collect())
    assert stays == [(2, "few w"), (7, "short"), (7, one[:5]), (9, "entir")] or stays == sorted([(2, "few w"), (7, "short"), (7, one[:5]), (9, "entir")])


def test_very_long_text(spark):
    base = " ".join(f"w{k}" for k in range(120_000))
    rows = [(1, base), (2, base + " tail"), (3, base[: len(base) // 2]), (4, None), (5, "x" * 2_000_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (119_996, 1) and got[2] == (119_997, 1) and got[3][1] == 3 and got[4] == (0, 4) and got[5] == (1, 5)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2000 + k) for k in range(1, 50)]
    parent = {x: x for e in edges if e[0] != e[1] for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}
