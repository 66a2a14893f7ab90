"""Edge cases and invariants of the operators, on small rows."""

import datetime
import hashlib
import json
import math
import threading
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from spindrift.operators import boosting, cleaning, evaluate, features, kpi, models, sampling, stats
from spindrift.plans.registry import Models, Runs
from spindrift.plans.training import GRAPH, Training
from spindrift.sources import tables
from spindrift.streaming.trend import windowed_counts


def test_cleaning(spark):
    rows = [("ok", 1), ("ok", 1), ("ok", -1), ("OK", 1), ("   ", 0), (None, 1), ("x", None), ("a ", 0)]
    df = spark.createDataFrame(rows, "text string, category int")
    assert sorted(map(tuple, cleaning.ingest_clean(df, "text", ["text", "category"]).collect())) == [("OK", 1), ("a ", 0), ("ok", -1), ("ok", 1)]
    assert cleaning.duplicate_count(df).first()[0] == 1 and df.where(cleaning.is_blank(F.col("text"))).count() == 1
    with pytest.raises(ValueError, match="No comments provided"):
        cleaning.require_rows([], "comments")
    nulls = spark.createDataFrame([(t,) for t in ["null", "NA", "None", "n/a", "", "kept"]], "t string").where(cleaning.na_to_null(F.col("t")).isNull())
    assert nulls.count() == 5


def test_trend_gaps_and_absent_classes(spark):
    day = datetime.datetime
    df = spark.createDataFrame([(day(2024, 1, 5), 1), (day(2024, 4, 30, 23), -1), (day(2024, 4, 1), -1)], "ts timestamp, s int")
    got = sorted(map(tuple, kpi.trend(df, "ts", "s").collect()))
    assert [(r[0], r[1:5]) for r in got] == [(datetime.date(2024, 1, 31), (0, 0, 1, 1)), (datetime.date(2024, 4, 30), (2, 0, 0, 2))]
    assert all(abs(sum(r[5:]) - 100) < 1e-9 for r in got)


def test_summary_rounds_twice(spark):
    df = spark.createDataFrame([("a b", "x", 1), ("c", None, 1), ("d", "", 0)], "text string, author string, s int")
    r = kpi.summary(df, "text", "author", "s").first()
    assert (r.total_comments, r.unique_commenters, float(r.average_words), float(r.average_sentiment), float(r.normalised_score)) == (3, 2, 1.33, 0.67, 8.35)


def test_pie(spark):
    df = spark.createDataFrame([(1,), (1,), (-1,)], "sentiment int")
    assert [(r.label, r.n, r.shown) for r in kpi.pie(df).orderBy("position").collect()] == [("Positive", 2, "66.7%"), ("Neutral", 0, "0.0%"), ("Negative", 1, "33.3%")]
    with pytest.raises(Exception, match="sum to zero"):
        kpi.pie(df.where("sentiment = 7")).collect()


def test_ties_are_alphabetical(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "term string")
    assert [r.term for r in stats.top(df, "term", 3).collect()] == ["c", "a", "b"]
    assert {r.character: r.n for r in stats.characters(spark.createDataFrame([("aé",), (None,), ("a",), ("",)], "t string"), "t").collect()} == {"a": 2, "é": 1, " ": 2}


def test_tfidf_norms_and_vectors(spark):
    df = spark.createDataFrame([(1, "red blue blue"), (2, "red green"), (3, "!"), (4, None)], "id long, text string")
    long = features.tfidf(df, "id", "text", 10, (1, 2)).collect()
    for k in (1, 2):
        assert abs(sum(r.weight**2 for r in long if r.id == k) - 1) < 1e-12
    assert not [r for r in long if r.id in (3, 4)]
    vec = features.Vectorizer(10, (1, 2)).fit(df, "text")
    names = vec.feature_names()
    got = {(r.id, names[j]): v for r in vec.transform(df, "text").collect() for j, v in enumerate(r.features.toArray()) if v}
    assert {k: round(v, 9) for k, v in got.items()} == {(r.id, r.term): round(r.weight, 9) for r in long}


def test_split_is_disjoint_stratified_and_stable(spark):
    df = spark.createDataFrame([(k, k % 3 - 1 if k % 10 else 1) for k in range(1000)], "id long, category int")
    a = {r.id: (r.category, r.is_test) for r in sampling.split(df, "id", stratify="category").collect()}
    b = {r.id: (r.category, r.is_test) for r in sampling.split(df.repartition(7), "id", stratify="category").collect()}
    assert a == b and len(a) == 1000
    for c in (-1, 0, 1):
        own = [t for k, t in a.values() if k == c]
        assert sum(own) == math.ceil(len(own) * 0.2)
    assert sampling.undersample(df, "id", "category").groupBy("category").count().select("count").distinct().count() == 1


def test_resampling(spark):
    rows = [(k, [float(k % 7), float(k // 7)], 0 if k < 40 else 1) for k in range(52)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label int")
    for out in (sampling.smote(df, "id", "x", "label"), sampling.resample(df, "oversampling", "id", "x", "label")):
        assert {r.label: r["count"] for r in out.groupBy("label").count().collect()} == {0: 40, 1: 40}
    own = [r[1] for r in rows if r[2] == 1]
    new = sampling.smote(df, "id", "x", "label").where("id is null").collect()
    assert len(new) == 28 and all(min(c[j] for c in own) <= r.x[j] <= max(c[j] for c in own) for r in new for j in (0, 1))
    assert sampling.adasyn(df, "id", "x", "label").count() > 52
    assert sampling.smote_enn(df, "id", "x", "label").count() <= 80
    with pytest.raises(ValueError, match="unknown method"):
        sampling.resample(df, "none", "id", "x", "label")


def test_report_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (0, 1), (-1, -1)], "label int, prediction int")
    got = {r.name: r for r in evaluate.report(df).collect()}
    assert got["0"].precision == got["0"].recall == got["0"].f1 == 0 and got["accuracy"].f1 == 0.75 and got["1"].support == 2
    flat = {r.name: r.value for r in evaluate.flat_report(evaluate.report(df)).collect()}
    assert flat["test_1_recall"] == 1.0 and "test_accuracy_f1" not in flat
    assert {r.actual: tuple(r)[1:] for r in evaluate.confusion_matrix(df).collect()} == {1: (0, 0, 2), 0: (0, 0, 1), -1: (1, 0, 0)}


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([('said "hi",\nbye', 1), ("NA", 0), (None, -1)], "clean_comment string, category int")
    tables.write_single_csv(df, str(tmp_path / "one"))
    assert sorted(map(repr, map(tuple, tables.read_csv(spark, str(tmp_path / "one")).collect()))) == sorted(map(repr, [('said "hi",\nbye', 1), (None, 0), (None, -1)]))
    assert tables.read_filled(spark, str(tmp_path / "one")).where("clean_comment = ''").count() == 2
    assert tables.read_preprocessed(spark, str(tmp_path / "one")).count() == 1
    (tmp_path / "p.yaml").write_text("# x\ndata:\n  test_size: 0.2\nmodel:\n  ngram_range: [1, 3]\n  name: gbt\n")
    assert tables.load_params(str(tmp_path / "p.yaml")) == {"data": {"test_size": 0.2}, "model": {"ngram_range": [1, 3], "name": "gbt"}}
    bodies = spark.createDataFrame([(1, '{"comments":[{"text":"a","timestamp":"2024-01-01T00:00:00Z","authorId":"u"},{"text":null}]}')], "id int, body string")
    assert [r.text for r in tables.request_timed_comments(bodies).orderBy("position").collect()] == ["a", None]
    senti = spark.createDataFrame([('{"sentiment_data":[{"timestamp":"2024-03-01T10:00:00Z","sentiment":-1}]}',)], "body string")
    assert tables.request_sentiments(senti).first().timestamp == datetime.datetime(2024, 3, 1, 10)
    urls = spark.createDataFrame([("https://www.youtube.com/watch?v=abc_DEF-123&t=1",), ("https://example.com",)], "u string")
    assert [r[0] for r in urls.select(tables.video_id(F.col("u"))).collect()] == ["abc_DEF-123", ""]


@pytest.mark.parametrize("field", tables.MISSING)
@pytest.mark.parametrize("empty", [None, [], {}])
def test_requests_without_content(field, empty):
    with pytest.raises(ValueError, match=tables.MISSING[field]):
        tables.required({field: empty}, field)
    with pytest.raises(ValueError):
        tables.required({}, field)
    assert tables.required({field: [1]}, field) == [1]


def test_pages_stop_between_pages(spark):
    page = lambda n: '{"items":[' + ",".join(['{"snippet":{"topLevelComment":{"snippet":{"textOriginal":"t","publishedAt":"2024-01-01T00:00:00Z","authorChannelId":{"value":""}}}}}'] * n) + "]}"
    got = tables.comment_pages(spark.createDataFrame([(k, page(100 if k else 99)) for k in range(8)], "number int, page string"))
    assert got.count() == 599 and got.first().authorId == "Unknown"


def _comments(spark):
    rows = [(f"{w} thing number {k}", c) for k in range(60) for w, c in (("lovely", 1), ("plain", 0), ("awful", -1))]
    return spark.createDataFrame([*rows, *rows[:5], (None, 1), (" ", 0)], "clean_comment string, category int")


def test_training_pipeline(spark, tmp_path):
    errors = tmp_path / "errors.log"
    work = Training(spark, f"file://{tmp_path}", max_features=20, ngram_range=(1, 1), params=models.Params(rounds=4, depth=2), error_file=str(errors))
    every = [name for name, *_ in GRAPH]
    assert work.run(_comments(spark), "run-1") == every and work.run(_comments(spark), "run-1") == []
    assert work.run(_comments(spark), "run-2") == ["evaluate", "register"]
    work.max_features = 10
    assert work.run(_comments(spark), "run-2") == ["build", "evaluate", "register"]
    held = Models(spark, f"file://{tmp_path}/models")
    held.move("sentiment", 2, "Production")
    assert {(r.version, r.stage) for r in held.table().collect()} == {(1, "Staging"), (2, "Production"), (3, "Staging")}
    assert held.path_of("sentiment", stage="Production") == work.at("model")
    runs = Runs(spark, f"file://{tmp_path}/runs").table().orderBy("run_id").collect()
    assert runs[0].metrics["test_1_recall"] >= 0.9 and json.loads(runs[0].signature)["inputs"] == [{"name": "clean_comment", "type": "string"}]
    matrix = spark.read.parquet(runs[0].artifacts["confusion_matrix_test"])
    assert matrix.count() == 9 and matrix.where("actual = predicted").agg(F.sum("n")).first()[0] >= 30
    asked = spark.createDataFrame([("Lovely things!",), ("awful",), (None,)], "clean_comment string")
    assert [r.sentiment for r in work.score(asked).collect()][:2] == [1, -1]
    with pytest.raises(ValueError, match="clean_comment string"):
        work.score(asked.withColumnRenamed("clean_comment", "text"))
    with pytest.raises(ValueError, match="no version"):
        held.move("sentiment", 9, "Production")
    with pytest.raises(FileNotFoundError, match="interim"):
        broken = Training(spark, f"file://{tmp_path}/other", error_file=str(errors))
        broken.preprocess = broken.build = lambda: None
        broken.run(_comments(spark))
    assert "interim missing" in errors.read_text()


def test_two_writers_never_share_a_version(spark, tmp_path):
    held = Models(spark, f"file://{tmp_path}/models")
    first = held._claim("version-m", 1)
    assert (first, held.register("m", "r", "p"), held.register("m", "r", "p")) == (1, 2, 3)


def test_boosted_trees_against_plain_growth():
    """The first tree's root split and leaf values equal those found by trying every split; more rounds fit the labels."""
    rng = np.random.default_rng(3)
    x = np.where(rng.random((60, 6)) < 0.5, np.round(rng.normal(size=(60, 6)), 1), 0.0)
    y = (x[:, 2] > 0.2).astype(int) + (x[:, 4] < -0.3)
    w = rng.random(60) + 0.5
    rows = [np.flatnonzero(r) for r in x]
    m = boosting.Matrix(np.r_[0, np.cumsum([len(r) for r in rows])], np.concatenate(rows).astype(np.int32), x[x != 0], y, w)
    p = boosting.Boosting(rounds=1, rate=0.3, depth=1, least_rows=5, bins=63)
    got = boosting.grow(m, 3, p)
    base = np.log(np.bincount(y, w) / w.sum())
    q = np.exp(base) / np.exp(base).sum()
    score = lambda g, h: max(abs(g) - p.l1, 0) ** 2 / (h + p.l2)
    for k in range(3):
        g, h = (q[k] - (y == k)) * w, q[k] * (1 - q[k]) * w * 1.5
        best = (0.0, None)
        for c in range(6):
            for t in np.unique(x[:, c])[:-1]:
                left = x[:, c] <= t
                if min(left.sum(), (~left).sum()) >= p.least_rows and min(h[left].sum(), h[~left].sum()) >= p.least_weight:
                    gain = score(g[left].sum(), h[left].sum()) + score(g[~left].sum(), h[~left].sum()) - score(g.sum(), h.sum())
                    best = max(best, (gain, (c, t)), key=lambda b: b[0])
        root = got.roots[k]
        c, t = best[1]
        assert got.column[root] == c and (x[:, c] <= got.bound[root]).tolist() == (x[:, c] <= t).tolist()
        left = x[:, c] <= t
        for child, side in ((got.left[root], left), (got.right[root], ~left)):
            want = -np.sign(g[side].sum()) * max(abs(g[side].sum()) - p.l1, 0) / (h[side].sum() + p.l2) * p.rate
            assert abs(got.value[child] - want) < 1e-9
    more = boosting.grow(m, 3, boosting.Boosting(rounds=40, least_rows=3))
    assert (more.scores(m.first, m.column, m.value).argmax(axis=1) == y).mean() > 0.95
    none = boosting.grow(m.rows(np.arange(0)), 3, p)
    assert none.scores(m.first, m.column, m.value).shape == (60, 3)


def test_boosted_model_survives_saving(spark, tmp_path):
    rows = [(k, Vectors.sparse(4, [k % 3], [1.0 + k]), float(k % 3), 1.0) for k in range(90)]
    df = spark.createDataFrame(rows, ["doc_id", "features", "label", "weight"])
    model = boosting.BoostedTrees(boosting.Boosting(rounds=5, least_rows=2)).fit(df.repartition(3))
    model.save(spark, f"file://{tmp_path}/m")
    a, b = (sorted((r.doc_id, r.prediction, tuple(r.probability)) for r in x.transform(df).collect()) for x in (model, boosting.load(spark, f"file://{tmp_path}/m")))
    assert a == b and all(p == k % 3 for k, p, _ in a) and df.limit(0).count() == model.transform(df.limit(0)).count()
    found, accuracy = models.search(df, trials=3)
    assert accuracy > 0.9 and 50 <= found.rounds <= 300


def test_concatenated(spark):
    rows = [(3, 0, "cc"), (1, 1, None), (1, 0, "a"), (900, 2, "dddd"), (1, 2, "é")]
    got = stats.concatenated(spark.createDataFrame(rows, "a long, b long, t string"), "t", "a", "b").collect()
    whole = " ".join(["a", "é", "cc", "dddd"])
    assert len(got) == 4 and all(whole[r.start : r.start + len(r.t)] == r.t for r in got)


def test_inspection(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "x", 1), (3, None, 1), (4, None, 1)], "id int, text string, label int")
    assert {r.label: r.n for r in cleaning.null_label_counts(df, "text", "label").collect()} == {0: 1, 1: 2}
    assert [tuple(r) for r in cleaning.info(df).orderBy("position").collect()] == [(0, "id", "int", 4), (1, "text", "string", 1), (2, "label", "int", 4)]
    assert [r.id for r in cleaning.tail(df, "id", 2).collect()] == [4, 3] and [r.id for r in cleaning.head(df, "id", 2).collect()] == [1, 2]
    urls = spark.createDataFrame([("see http://localhost",), ("https://a.b",), ("http:// x",), ("none",)], "t string")
    assert [r[0] for r in urls.select(F.col("t").rlike(cleaning.URL)).collect()] == [True, True, False, False]


def test_cut_takes_the_first_by_hash(spark):
    df = spark.createDataFrame([(k, k % 4) for k in range(500)] + [(900, None)], "id long, c int")
    for n in (0, 1, 7, 125, 1000):
        got = sampling.cut(df, "id", ["c"], lambda total, n=n: F.least(total, F.lit(n))).collect()
        of = lambda k: hashlib.md5(f"42||{k}".encode()).hexdigest()
        for c in (0, 1, 2, 3, None):
            own = sorted((r.id for r in got if r.c == c), key=of)
            assert {r.id for r in got if r.c == c and r._chosen} == set(own[:n])


def test_stream(spark, tmp_path):
    day = datetime.datetime
    rows = [(day(2024, 1, 1, h), s) for h, s in ((1, 1), (2, -1), (23, 0))] + [(day(2024, 1, 2, 5), 1), (day(2024, 1, 3, 5), 1)]
    spark.createDataFrame(rows, "ts timestamp, s int").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, s int").parquet(str(tmp_path / "in"))
    out = windowed_counts(stream, "ts", "s").writeStream.format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination(60)
    got = {r.start.day: (r.negative, r.neutral, r.positive) for r in spark.table("windows").collect()}
    assert got[1] == (1, 1, 1) and 3 not in got


def test_terms_are_counted_before_they_become_rows(spark):
    """A task hands on counts, not occurrences, however few different terms it may hold; null and short texts have none of the longer n-grams."""
    texts = [None, "", "one", "aa bb aa bb aa", "bb cc", "aa bb aa bb aa"] * 5
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    total, held = Counter(), Counter()
    for t in texts:
        w = (t or "").split()
        own = [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
        total.update(own)
        held.update(set(own))
    want = {(t, n, held[t]) for t, n in total.items()}
    assert {tuple(r) for r in features.vocabulary(df, "t", (1, 3)).collect()} == want
    assert {tuple(r) for r in features.counts(df, "t", (1, 3), most=2).collect()} == want
    assert "Generate" not in features.vocabulary(df, "t", (1, 3))._jdf.queryExecution().executedPlan().toString()


def test_rare_words_make_no_terms(spark):
    """A vocabulary with a bound is the head of the whole one, and n-grams with words too rare for it aren't counted."""
    df = spark.createDataFrame([(f"aa bb cc aa bb rare{k} aa bb dd{k % 3}",) for k in range(40)], "t string")
    whole = features.vocabulary(df, "t", (1, 3)).orderBy(F.desc("total"), "term").collect()
    for n in (1, 2, 4, 7, 1000):
        assert features.vocabulary(df, "t", (1, 3), n).collect() == whole[:n], n
    ranked = features.ranked_terms(df, "t", 3, 4)
    assert ranked.where("term LIKE '%rare%'").isEmpty()
    assert [features.first_terms(ranked, hi, 4) for hi in (2, 3)] == [[(r.term, r.df) for r in whole if r.term.count(" ") < hi][:4] for hi in (2, 3)]


def test_small_leaves_look_at_few_cells(monkeypatch):
    """Every split is the best of all, whichever of a leaf's cells are held; leaves of few entries don't scan all cells."""
    rng = np.random.default_rng(5)
    n, c = 3000, 40
    x = np.where(rng.random((n, c)) < 0.08, rng.integers(-3, 9, (n, c)) / 4, 0.0)
    y = (x[:, 0] + x[:, 1] > 0.5).astype(int) + (x[:, 2] > 0.25)
    y = np.where(rng.random(n) < 0.2, rng.integers(0, 3, n), y)
    row, column = np.nonzero(x)
    m = boosting.Matrix(np.r_[0, np.cumsum(np.bincount(row, minlength=n))], column.astype(np.int32), x[x != 0], y, rng.random(n) + 0.5)
    scanned, best = [], boosting._Grower._best
    monkeypatch.setattr(boosting._Grower, "_best", lambda self, held, totals: scanned.append(held[-1].shape[-1]) or best(self, held, totals))
    p = boosting.Boosting(rounds=1, rate=0.3, depth=9, leaves=512, least_rows=1, l1=0.0, l2=1.0)
    got = boosting.grow(m, 3, p)
    assert sum(scanned) < 0.7 * max(scanned) * len(scanned)
    base = np.log(np.bincount(y, m.weight) / m.weight.sum())
    q = np.exp(base) / np.exp(base).sum()
    score = lambda g, h: g * g / (h + p.l2)
    looked = 0
    for k in range(3):
        g, h = (q[k] - (y == k)) * m.weight, q[k] * (1 - q[k]) * m.weight * 1.5
        of = {got.roots[k]: np.ones(n, bool)}
        while of:
            at, rows = of.popitem()
            whole = score(g[rows].sum(), h[rows].sum())
            gain = lambda left: score(g[left].sum(), h[left].sum()) + score(g[rows & ~left].sum(), h[rows & ~left].sum()) - whole  # noqa: B023, E731
            ok = lambda left: left.any() and (rows & ~left).any() and min(h[left].sum(), h[rows & ~left].sum()) >= p.least_weight  # noqa: B023, E731
            if got.column[at] >= 0 and looked < 60:
                sides = [rows & (x[:, j] <= v) for j in range(c) for v in np.unique(x[rows, j])[:-1]]
                most = max(gain(s) for s in sides if ok(s))
                assert gain(rows & (x[:, got.column[at]] <= got.bound[at])) == pytest.approx(most, rel=1e-9)
                looked += 1
            if got.column[at] >= 0:
                left = rows & (x[:, got.column[at]] <= got.bound[at])
                of |= {got.left[at]: left, got.right[at]: rows & ~left}
            else:
                assert got.value[at] == pytest.approx(-g[rows].sum() / (h[rows].sum() + p.l2) * p.rate, abs=1e-9)
    assert looked > 20


def test_trees_are_grown_on_all_rows(spark):
    """The shares that a model begins with are those of every row, however many there are."""
    df = spark.range(210_000).selectExpr("id AS doc_id", "CAST(id % 1000 = 0 AS double) AS label", "1.0D AS weight", "CAST(id % 7 AS double) AS x")
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    model = boosting.BoostedTrees(boosting.Boosting(rounds=1, depth=1), classes=2).fit(df)
    assert np.exp(model.trees.base) == pytest.approx([0.999, 0.001], rel=1e-12)


@pytest.mark.parametrize("p", [boosting.Boosting(rounds=4, leaves=9, least_rows=4), boosting.Boosting(rounds=4, depth=5, leaves=32, least_rows=1, l1=0.0, l2=1.0)])
def test_groups_of_columns_grow_the_same_trees(spark, monkeypatch, p):
    """Binned entries of more than a task's bound stay in groups of columns, and their trees are those of one task, equal gains included."""
    rng = np.random.default_rng(8)
    n, c = 700, 25
    x = np.where(rng.random((n, c)) < 0.3, rng.normal(0.5, 1, (n, c)), 0.0)
    y = (x[:, 0] + x[:, 1] > 0.5).astype(int) + (x[:, 2] > 0.25)
    y = np.where(rng.random(n) < 0.2, rng.integers(0, 3, n), y)
    rows = [(k, Vectors.sparse(c, np.flatnonzero(r), r[r != 0]), float(a), float(w)) for k, (r, a, w) in enumerate(zip(x, y, rng.random(n) + 0.5, strict=True))]
    df = spark.createDataFrame(rows, ["doc_id", "features", "label", "weight"]).repartition(3)
    one = boosting.BoostedTrees(p).fit(df).trees
    monkeypatch.setattr(boosting, "IN_TASK", 0)
    monkeypatch.setattr(boosting, "GROUP", 600)
    many = boosting.BoostedTrees(p).fit(df.repartition(2)).trees
    assert len(one.column) > 100
    for name in ("column", "left", "right", "roots"):
        assert getattr(one, name).tolist() == getattr(many, name).tolist(), name
    for name in ("bound", "value", "base"):
        assert np.allclose(getattr(one, name), getattr(many, name), rtol=1e-9, atol=1e-12), name


def test_vectors_are_cut_from_counts(spark):
    """Vectors of a shorter vocabulary, cut from counts of a longer one, are those that the texts give; null and foreign texts have none."""
    texts = ["aa bb aa cc", "bb cc dd", None, "", "zz", "dd dd aa bb", "ee aa bb cc dd"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").repartition(3)
    ranked = [(r.term, r.df) for r in features.vocabulary(df, "t", (1, 2)).orderBy(F.desc("total"), "term").collect()]
    counted = features.Vectorizer(len(ranked), (1, 2)).of_terms(ranked, len(texts)).counted(df, "t")
    for n in (1, 3, len(ranked)):
        for tfidf in (False, True):
            vec = features.Vectorizer(n, (1, 2), tfidf).of_terms(ranked, len(texts))
            got, want = (sorted(map(tuple, x.select("k", "features").collect())) for x in (vec.of_counts(counted), vec.transform(df, "t")))
            assert [(k, v.size, v.indices.tolist(), v.values.tolist()) for k, v in got] == [(k, v.size, v.indices.tolist(), v.values.tolist()) for k, v in want]


def test_a_sweep_counts_texts_once(spark, monkeypatch):
    """Settings of one range share the counts of training and test texts."""
    read, terms = [], features.Vectorizer._terms
    monkeypatch.setattr(features.Vectorizer, "_terms", lambda self, df, text: read.append(text) or terms(self, df, text))
    rows = [(k, f"{('good', 'bad', 'plain')[k % 3]} words here {k % 5}", (1, -1, 0)[k % 3]) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, t string, category int")
    grid = [{"max_features": n, "ngram_range": (1, 2), "tfidf": w} for n in (4, 8) for w in (False, True)]
    got = models.sweep(df, "doc_id", "t", grid, models.Params(trees=3, forest_depth=3))
    assert [s for s, _ in got] == grid and got[-1][1] > 0.9 and len(read) == 2


def test_boosted_fits_of_a_stack_begin_together(spark, monkeypatch):
    """Each is a long task, so none waits for another's end."""
    p, fit = models.Params(folds=5, neighbours=3, rounds=5, depth=3), boosting.BoostedTrees.fit
    met = threading.Barrier(p.folds + 1)
    monkeypatch.setattr(boosting.BoostedTrees, "fit", lambda self, df: met.wait(60) >= 0 and fit(self, df))
    rows = [(k, Vectors.sparse(4, [k % 3], [1.0 + k % 7]), float(k % 3), 1.0) for k in range(150)]
    df = spark.createDataFrame(rows, ["doc_id", "features", "label", "weight"])
    got = models.stack(df.where("doc_id % 5 > 0"), df.where("doc_id % 5 = 0"), "doc_id", [models.boosted(p), models.logistic(20)], p).collect()
    assert len(got) == 30 and all(r.prediction == r.label for r in got)


def test_scoring_holds_a_few_rows_at_a_time():
    """Not a full table of all rows of a batch by all columns."""
    n, c = 20_000, 4000
    column = np.arange(c)
    trees = boosting.Trees(np.r_[column, -1, -1], np.r_[np.full(c, 0.5), 0.0, 0.0], np.r_[np.full(c, c), -1, -1], np.r_[np.full(c, c + 1), -1, -1], np.r_[np.zeros(c), 1.0, 2.0], np.array([0, 1]), np.zeros(2))
    tracemalloc.start()
    got = trees.scores(np.arange(n + 1), np.arange(n) % c, np.ones(n))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6 and got[:3].tolist() == [[2.0, 1.0], [1.0, 2.0], [1.0, 1.0]]
