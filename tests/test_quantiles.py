"""Exact quantiles against numpy."""

import numpy as np
import pytest

from spindrift.operators import quantiles as Q


@pytest.mark.parametrize(("how", "kind"), [({}, "whole"), ({}, "signed"), ({"slices": 64, "fetched": 40}, "normal"), ({"slices": 64, "fetched": 200}, "wide"), ({"slices": 64, "fetched": 1}, "whole")])
def test_quantiles_of_classes(spark, how, kind):
    """Many rounds of few slices, too; ties, values over many magnitudes, null values and classes."""
    rng = np.random.default_rng(1)
    x = {"whole": rng.integers(0, 50, 3000).astype(float), "normal": rng.normal(size=3000), "wide": 10.0 ** rng.uniform(-300, 300, 3000), "signed": rng.choice([-1e308, 1e308, 0.0, -0.5], 3000) * rng.uniform(0.5, 1, 3000)}[kind]
    of = rng.choice(["a", "b", None], 3000, p=[0.6, 0.3, 0.1])
    rows = [(o, None if k % 7 == 0 else float(v)) for k, (o, v) in enumerate(zip(of, x, strict=True))] + [("none", None)]
    held = Q.Counted(spark.createDataFrame(rows, "of string, x double"), "x", ["of"])
    shares = [0, 0.25, 0.5, 0.9, 1]
    got = held.quantiles(shares, **how)
    held.release()
    assert got.pop(("none",)) == [None] * 5 and set(got) == {("a",), ("b",), (None,)}
    for (o,), q in got.items():
        own = np.sort([v for p, v in rows if p == o and v is not None])
        for s, v in zip(shares, q, strict=True):
            at = s * (len(own) - 1)
            a, b = own[int(np.floor(at))], own[int(np.ceil(at))]
            assert v == pytest.approx(a if a == b else (np.ceil(at) - at) * a + (at - np.floor(at)) * b, rel=1e-12)


def test_infinite_values_and_nan(spark):
    rows = [(v,) for v in (float("-inf"), 1.0, 2.0, 3.0, float("inf"), float("nan"))]
    held = Q.Counted(spark.createDataFrame(rows, "x double"), "x")
    got = held.values_at({(): set(range(6))}, slices=16, fetched=1)[()]
    held.release()
    assert [got[k] for k in range(5)] == [r[0] for r in rows[:5]] and np.isnan(got[5])


def test_nothing_grows_on_the_driver(spark, monkeypatch):
    """A million different doubles: no more than the slices and the fetched values of a round ever come to the driver."""
    fetched = []
    real = type(spark.range(0)).collect
    monkeypatch.setattr(type(spark.range(0)), "collect", lambda self: fetched.append(real(self)) or fetched[-1])
    df = spark.range(1_000_000).selectExpr("hash(id) * 1e-3 + id * 1e-9 AS x")
    got = Q.quantiles(df, "x", [0.25, 0.5, 0.75], names=["a", "b", "c"])
    assert max(map(len, fetched)) <= Q.SLICES + 16 * Q.FETCHED
    monkeypatch.undo()
    want = np.quantile(df.toPandas().x.to_numpy(), [0.25, 0.5, 0.75])
    assert np.allclose(list(got.first()), want, rtol=1e-12)


def test_describe_box_and_empty(spark):
    rng = np.random.default_rng(2)
    x = np.r_[rng.integers(10, 30, 500), 200, 300]
    df = spark.createDataFrame([("a" if k % 2 else None, int(v)) for k, v in enumerate(x)], "of string, x int")
    d = Q.describe(df, "x").first()
    assert (d.n, d.min, d.max) == (502, 10, 300) and np.allclose([d.mean, d.std, d.p25, d.p50, d.p75], [x.mean(), x.std(ddof=1), *np.quantile(x, [0.25, 0.5, 0.75])])
    for r in Q.box(df, "x", "of").collect():
        own = x[1::2] if r.of else x[::2]
        a, b = np.quantile(own, [0.25, 0.75])
        inside = own[(own >= a - 1.5 * (b - a)) & (own <= b + 1.5 * (b - a))]
        assert (r.low, r.high, r.outliers) == (inside.min(), inside.max(), len(own) - len(inside))
    none = df.where("x < 0")
    assert Q.describe(none, "x").first().n == 0 and Q.box(none, "x").count() == 0 and Q.automatic_bins(none, "x").count() == 0
    assert Q.median_interval(none, "x", "of", "x").count() == 0


def test_bins_are_numpys(spark):
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=400), np.full(5, 3.0)):
        got = Q.automatic_bins(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").orderBy("bin").collect()
        n, edges = np.histogram(x, bins="auto")
        if len(set(x)) > 1:
            assert [r.n for r in got] == n.tolist() and np.allclose([r.low for r in got], edges[:-1])
        else:
            assert [r.n for r in got] == [5]


def test_interval_holds_the_median(spark):
    """Repetitions vary as medians of samples do, and each row is drawn once on average."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=2000)
    df = spark.createDataFrame([(k, "a", float(v)) for k, v in enumerate(x)], "id long, of string, x double")
    r = Q.median_interval(df, "id", "of", "x").first()
    error = 1.2533 / np.sqrt(2000)
    assert r.low < r.median < r.high and 2.5 * error < r.high - r.low < 5.5 * error
    assert abs(Q.drawn(df, "id").agg({"w": "sum"}).first()[0] / 2000 / Q.REPEATS - 1) < 0.01


def test_draws_are_added_up_before_they_become_rows(spark):
    """The parts add up to the draws of every row, null classes and ties too, and are far fewer than these."""
    df = spark.createDataFrame([(k, (None, "a", "b")[k % 3], float(k * k % 17) if k % 10 else None) for k in range(2000)], "id long, of string, x double").repartition(3)
    parts = Q.drawn_values(df, "id", "of", "x", most=300).persist()
    want = {(r.of, r.x, r.r): r.w for r in Q.drawn(df.where("x is not null"), "id").groupBy("of", "x", "r").agg({"w": "sum"}).toDF("of", "x", "r", "w").collect()}
    got = {(r.of, r.x, r.r): r.w for r in parts.groupBy("of", "x", "r").agg({"w": "sum"}).toDF("of", "x", "r", "w").where("w > 0").collect()}
    assert got == want and parts.count() < 0.35 * 1800 * Q.REPEATS
    parts.unpersist()
