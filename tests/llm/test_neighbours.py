import math

import numpy as np
import pytest

from spindrift.llm import neighbours as op


def test_chi_square():
    rng = np.random.default_rng(1)
    draws = (rng.normal(size=(200_000, 8)) ** 2).sum(axis=1)
    for p in (0.5, 0.9, 0.99):
        assert abs((draws < op.quantile(8, p)).mean() - p) < 0.005


def test_leaves_hold_every_point_within_their_boxes():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(size=(500, 4)), np.ones((70, 4))])
    tree, places = op.KdTree(points, 8), rng.normal(size=(3, 4))
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(570))
    away = tree.away(places)
    for q in range(3):
        for leaf, own in enumerate(tree.leaves):
            assert (((points[own] - places[q]) ** 2).sum(axis=1) >= away[q, leaf] - 1e-12).all()


@pytest.mark.parametrize("noise", [None, 0.1])
def test_recall_on_64_dimensions(noise):
    """Unit vectors at random, and copies of some with noise: recall, and for copies how few points are verified."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 64)) if noise is None else np.repeat(rng.normal(size=(300, 64)), 20, axis=0) + noise * rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = np.arange(0, 6000, 60)
    tree = op.KdTree(op._project(x, op.DIMENSIONS))
    number, exact, seen = op.search(tree, x, x[q], op._project(x[q], op.DIMENSIONS), 11, np.full(len(q), np.inf), op.quantile(op.DIMENSIONS, op.CONFIDENCE))
    d = np.sqrt(((x[q][:, None] - x[None]) ** 2).sum(axis=2))
    want = np.argsort(d, axis=1)[:, :11]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(number.tolist(), want.tolist(), strict=True)]) / 11 >= 0.95
    assert np.allclose(exact, np.take_along_axis(d, number, axis=1))
    assert noise is None or seen < 0.25 * len(q) * len(x)


def brute(vectors, queries, k):
    out = {}
    for q in queries:
        d = sorted((math.sqrt(((v - vectors[q][0]) ** 2).sum()), i) for i, (v, _) in vectors.items() if i != q)
        out[q] = d[:k]
    return out


@pytest.mark.parametrize("cell", [100, 65_536])
def test_recall_and_order(spark, cell, monkeypatch):
    monkeypatch.setattr(op, "CELL_BYTES", cell * 8 * 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    data = {i: (centres[i % 20] + 0.4 * rng.normal(size=16)).astype(np.float32).astype(float) for i in range(1500)}
    data |= {2000 + i: data[7] for i in range(300)}
    rows = [(i, v.tolist(), "x", 0) for i, v in data.items()]
    rows += [(5000, None, "x", 0), (5100, [0.0] * 16, "x", 0), (5200, [math.nan] * 16, "x", 0), (5300, [1.0] * 15 + [None], "x", 0), (5400, [math.inf] * 16, "x", 0), (None, [1.0] * 16, "x", 0), (5500, [1.0], "x", 0), (-1, [1.0], "x", 0)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, vector string, rank int").repartition(3)
    got = {}
    for r in op.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute({i: (v, 0) for i, v in data.items()}, [i for i in data if i % 100 == 0], 10)
    assert set(got) == set(want)
    hits = 0
    for q, own in got.items():
        own.sort()
        assert [r for r, *_ in own] == list(range(1, 11)) and [(s, i) for _, i, s in own] == sorted((s, i) for _, i, s in own)
        assert all(abs(s - math.sqrt(((data[q] - data[i]) ** 2).sum())) < 1e-12 for _, i, s in own)
        hits += len({i for _, i, _ in own} & {i for _, i in want[q]})
    assert hits >= 0.9 * 10 * len(want)
    exact = next(q for q in got if q >= 2000)
    assert [i for _, i, _ in sorted(got[exact])] == [i for _, i in want[exact]]


def test_repeated_ids_and_equal_queries(spark):
    from pyspark.sql import functions as F

    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [-0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in op.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    assert sorted(got[0]) == [(1, 1, 0.0), (2, 100, 0.0), (3, 1, 0.5), (4, 2, round(math.sqrt(5), 9))]
    assert sorted(got[100]) == [(1, 0, 0.0), (2, 0, 0.0), (3, 1, 0.0), (4, 1, 0.5), (5, 2, round(math.sqrt(5), 9))]


def test_few_rows(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in op.nearest(df, F.col("vec_id") == 0).collect()] == [(1, 1), (2, 2)]
    assert op.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert op.nearest(df.limit(1), F.col("vec_id") == 0).count() == 0
