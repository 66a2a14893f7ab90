import hashlib
import re
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from spindrift.llm import exact_dedup as op
from spindrift.llm import filters

ROWS = [(1, "a b"), (2, "ab "), (3, "a\tb\n\n"), (4, None), (5, ""), (6, " \n"), (7, "x" * 50_000), (8, "x" * 50_000), (8, "x" * 50_000), (None, "ab"), (9, "é "), (10, "é"), (None, None)]


def brute(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, k, i))
    out = {}
    for norm, g in groups.items():
        best = min(g)
        for x in g:
            out[x[3]] = (x[4], best[4], len(g), hashlib.sha256(norm.encode()).hexdigest())
    return sorted(map(repr, out.values())), len(groups)


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_against_brute_force(spark, digest_bytes, monkeypatch):
    rows = ROWS + [(100 + i, f"t {i % 400}" + " " * (i % 7)) for i in range(900)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, keep_id int").repartition(3)
    got = op.dedup(docs, digest_bytes).collect()
    want, n = brute(rows)
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == want
    assert sum(r.kept for r in got) == n
    stays = op.keep_first(docs).collect()
    assert len(stays) == n and stays[0].__fields__ == docs.columns


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op.dedup(docs).count() == 0


def batch(spark, ids):
    return op.entries_of(spark.createDataFrame([(i, f"text {i % 500}" + " " * (i % 3)) for i in ids], "doc_id long, text string"))


def test_batches_levels_and_lookups(spark, tmp_path):
    """Batches become runs, full levels are merged, the survivor of each digest is that of all rows; filters rule buckets out."""
    index = op.Index(spark, f"file://{tmp_path}/index", 64)
    for k in range(op.FANOUT - 1):
        index.add(batch(spark, range(100 * k, 100 * k + 150)))
    assert [level for level, _ in index.runs.values()] == [0] * (op.FANOUT - 1)
    index.add(batch(spark, range(5000, 5020)))
    assert [level for level, _ in index.runs.values()] == [1]
    index.add(batch(spark, [3, 9003]))
    assert sorted(level for level, _ in index.runs.values()) == [0, 1]
    every = [i for k in range(op.FANOUT - 1) for i in range(100 * k, 100 * k + 150)] + list(range(5000, 5020)) + [3, 9003]
    groups = defaultdict(list)
    for i in every:
        groups[i % 500].append((-(i % 3), i))
    got = index.entries().collect()
    assert len(got) == len(groups) and sorted((r.doc_id, r.members) for r in got) == sorted((min(g)[1], len(g)) for g in groups.values())
    found = index.lookup(batch(spark, [3]))
    assert {r.doc_id for r in found.collect()} <= {3, 503, 5003, 9003} and found.count() == 2
    assert index.touched <= 4 < index.skipped
    assert index.lookup(batch(spark, [499_999 + 77]).select(F.unhex(F.sha2(F.lit("none"), 256)).alias("digest"))).count() == 0


def test_filters_never_lose_a_member(spark):
    digests = [hashlib.sha256(str(k).encode()).digest() for k in range(5000)]
    held = filters.of(spark.createDataFrame([(d,) for d in digests[:2500]], "digest binary").repartition(3))
    told = filters.holds(held.words, digests, held.k)
    assert told[:2500].all() and told[2500:].mean() < 0.01
    assert filters.size_for(10**12) == filters.MOST_BITS and filters.probes(filters.MOST_BITS, 10**12) == 1


def test_rows_that_repeat_and_extra_columns(spark):
    rows = [(1, "a", "x")] * 3 + [(2, "a", "y"), (3, "b", "z"), (3, "b ", "z"), (None, "c", "n"), (None, "c", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    assert sorted(repr(tuple(r)) for r in op.keep_first(docs).collect()) == sorted(map(repr, [(1, "a", "x"), (3, "b ", "z"), (None, "c", "n")]))
