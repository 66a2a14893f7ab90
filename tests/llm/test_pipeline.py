"""The pipeline on a small corpus, stage by stage, against plain Python."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from spindrift.llm import packing, pii
from spindrift.llm.near_dedup import shingle_sets


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    texts, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        text = "\n".join(" ".join(word() for _ in range(9)).capitalize() + "." for _ in range(4))
        texts.append(text if good else text.upper().replace(" ", "!! "))
        labels.append((i, int(good)))
    texts += [texts[1], texts[1] + " ", texts[2].replace(" ", "  "), texts[4] + " extra", texts[5] + " mail a.b@c.example.org"]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(900, None, None, None, None), (901, "", "en", "s", 0)]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, seen = docs.columns, [{r.doc_id: r.text for r in docs.collect()}]
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        docs = step(spark, docs, folder).cache()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
            seen.append({r.doc_id: r.text for r in docs.collect()})
    everything, good, exact, near, masked = seen
    assert all(i in good for i in everything if i < 300 and i % 3) and not any(i in good for i in everything if i < 300 and i % 3 == 0)
    by_norm = {}
    for i, t in good.items():
        by_norm.setdefault(re.sub(r"\s", "", t or ""), []).append((-len(t or ""), i))
    assert set(exact) == {min(v)[1] for v in by_norm.values()}
    sets = dict(zip(exact, [set(s.tolist()) for s in shingle_sets([t or "" for t in exact.values()])], strict=True))
    kept = set(exact)
    for i in sorted(exact):
        if any(j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) for j in exact):
            kept.discard(i)
    assert set(near) == kept
    assert set(masked) == kept and all(masked[i] == (None if t is None else pii.masked(t, frozenset())) for i, t in near.items())
    assert {r.doc_id for r in docs.collect()} == kept


def test_run(spark, folder):
    packed = corpus_pipeline.run(spark, folder)
    assert packed.count() >= 190 and {"doc_id", "sequence_id", "offset"} <= set(packed.columns)


def test_run_gives_sequences(spark, folder):
    packed = corpus_pipeline.run(spark, folder).cache()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in packed.collect())
    got = packing.sequences(packed).collect()
    assert 0 < max(len(r.ids) for r in got) <= 4 * packing.CAPACITY
    assert sum(len(r.ids) for r in got) == 4 * sum(r.length for r in packed.collect())


def test_edges(spark, tmp_path):
    """An empty table; and one with nulls, repeated rows, a very long text and columns that clash with the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, set_key string, key string, score double, stays boolean"
    long_text = "\n".join(f"Plain words number {k} of a very long document stand here." for k in range(20_000))
    good = "Plain words of a short document stand here and they are quite good."
    rows = [(1, long_text), (2, good), (2, good), (3, good + " "), (4, None), (5, ""), (None, good + " And a further sentence follows."), (6, long_text + "\nOne line more.")]
    known = spark.createDataFrame([(1, 1), (2, 1), (7, 0)], "doc_id long, quality int")
    for name, held, want in (("none", [], set()), ("some", rows, {1, 3, 4, 5, None})):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", 0.5, True) for i, t in held], schema).write.parquet(f"{at}/documents.parquet")
        known.write.parquet(f"{at}/labels.parquet")
        docs = spark.read.parquet(f"{at}/documents.parquet")
        for _, step in corpus_pipeline.STAGES[1:4]:  # the classifier's verdict on such rows isn't the matter here
            docs = step(spark, docs, at)
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        assert {r.doc_id for r in docs.collect()} <= want | {4, 5} and (not held or {1, 3, None} <= {r.doc_id for r in docs.collect()})
        assert corpus_pipeline.run(spark, at).count() >= 0


def test_columns_of_any_name(spark, folder):
    """Four stages leave columns alone that are named like their own, or hold dots, quotes and maps."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ["_key", "_n", "_stays", "_hot", "_cold", "_by", "_weight", "_hot_key", "_join_by", "_kept_key", "_Kept_N", "_join", "key", "digest", "a.b", "c`d", "row", "_score", "_set", "_first", "text_key"]
    more = {n: F.concat(F.lit(f"{n}="), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in names}
    wide = docs.select("*", *[c.alias(n) for n, c in more.items()], F.create_map(F.lit("k"), "doc_id").alias("m"), F.lit(1).alias("_kept_"))
    hot = wide.unionByName(wide.where("doc_id = 3")).unionByName(wide.where("doc_id = 3"))  # a key that several rows have
    for _, step in corpus_pipeline.STAGES[:4]:
        out = step(spark, hot, folder)
        assert out.columns == wide.columns and out.schema.simpleString() == wide.schema.simpleString()
        rows = out.collect()
        assert rows and all(r[n] == f"{n}={'-' if r.doc_id is None else r.doc_id}" for r in rows for n in names) and all(r.m == {"k": r.doc_id} and r["_kept_"] == 1 for r in rows)


def test_names():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert sum(n.startswith("op") for n in names) == 13
