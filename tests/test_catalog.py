"""Every query that has SQL gives the rows that DuckDB gives, on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from spindrift.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clients stamps".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in found.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want


def test_null_text_labels_count_comments(spark, tmp_path):
    """Every document without an English text counts, with or without a label."""
    spark.createDataFrame([(1, "a", "en"), (2, "b", "de"), (3, None, "en"), (4, "d", None), (5, "e", "fr")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.category: r.n for r in catalog.queries()["f08_null_text_labels"](spark, str(tmp_path)).collect()}
    assert got == {1: 1, 0: 1, -1: 1, None: 1}


def test_model_queries_have_full_parameters(monkeypatch):
    """What the model queries hand to the models, without a fit."""
    full, seen = catalog.models.Params(), []
    note = lambda name, out: lambda *a, **b: seen.append((name, *a, *b.values())) or out

    class Anything:
        def __getattr__(self, name):
            return lambda *a, **b: self

    monkeypatch.setattr(catalog.scratch, "table", lambda df, name: df)

    some = Anything()
    monkeypatch.setattr(catalog, "_labelled_comments", lambda *a: some)
    monkeypatch.setattr(catalog, "_lemmatizer", lambda *a: some)
    monkeypatch.setattr(catalog.sampling, "train_test", lambda *a, **b: (some, some))
    monkeypatch.setattr(catalog.features, "Vectorizer", note("vectorizer", some))
    for name, out in {"labelled": some, "boosted": some, "tuned": some, "forest": some, "logistic": some, "stack": some, "search": (full, 0.5), "trained_and_scored": (some, some), "sentiment": some, "sweep": []}.items():
        monkeypatch.setattr(catalog.models, name, note(name, out))

    def used(query):
        seen.clear()
        catalog.queries()[query](some, "")
        return {x[0]: x[1:] for x in seen}

    m01, m02, m03, m06, m07 = map(used, ("m01_boosted_trees", "m02_random_forest", "m03_boosted_trees_tuned", "m06_stacking", "m07_search"))
    assert m01["boosted"] == (full,) and m01["vectorizer"][0] == 1000
    assert m02["forest"] == (full,) and m02["vectorizer"][0] == 10_000
    assert m03["search"] == (some,) and m03["tuned"] == (full,)
    assert m06["stack"][-1] == full and len(m06["stack"][3]) == 2 and m06["boosted"][0].rounds == 367 and m06["logistic"] == () and m06["vectorizer"][0] == 10_000
    assert m07["search"] == (some,) and m07["vectorizer"][0] == 1000
    assert all(used(q)["logistic"] == () for q in ("m04_logistic", "m09_batch_predict"))
    assert all(used(q)["sweep"][-1] == full for q in ("v07_vectorizer_sweep", "v08_vocabulary_sweep"))


def test_import_without_a_session_or_jars(tmp_path):
    """The entry module and all SQL come from the sources alone: no session, and none of Spark's libraries."""
    code = f"""
import pathlib, pyspark
real = pathlib.Path(pyspark.__file__).parent
pyspark.__file__ = {str(tmp_path / "pyspark" / "__init__.py")!r}
import __spark_entry__ as e
assert len(e.queries()) > 100 and len(e.oracle_sql()) > 90
from pyspark import SparkContext
assert SparkContext._active_spark_context is None
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_training_texts_are_normalised_once(spark, monkeypatch):
    """What splits, vocabularies and vectors read holds the texts, not the work of their normalising; a scorer fits its lemmas once."""
    fits, fit = [], catalog.Lemmatizer.fit
    monkeypatch.setattr(catalog.Lemmatizer, "fit", lambda self, *a, **b: fits.append(1) or fit(self, *a, **b))
    seen = []
    monkeypatch.setattr(catalog.models.LogisticRegression, "fit", lambda self, df: seen.append(df))
    catalog._scorer(spark, "/root/testdata/sf0.001")
    assert len(fits) == len(seen) == 1
    assert "EvalPython" not in catalog._training_comments(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
