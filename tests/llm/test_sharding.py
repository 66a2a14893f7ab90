import itertools
import random
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import sharding as op


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=3), st.lists(st.integers(0, 4), min_size=1, max_size=3), st.data())
def test_flow_is_cheapest(supply, demand, data):
    gap = sum(supply) - sum(demand)
    (demand if gap > 0 else supply).append(abs(gap))
    costs = [[data.draw(st.integers(0, 5)) for _ in demand] for _ in supply]
    got = op.min_cost_flow(dict(enumerate(supply)), dict(enumerate(demand)), lambda a, b: float(costs[a][b]))
    assert [sum(got[a, b] for b in range(len(demand))) for a in range(len(supply))] == supply
    assert [sum(got[a, b] for a in range(len(supply))) for b in range(len(demand))] == demand
    best = {tuple(supply): 0}
    for b, need in enumerate(demand):  # by every way to fill one sink after another
        after = {}
        for left, spent in best.items():
            for take in itertools.product(*[range(x + 1) for x in left]):
                if sum(take) == need:
                    rest, c = tuple(x - t for x, t in zip(left, take, strict=True)), spent + sum(t * costs[a][b] for a, t in enumerate(take))
                    after[rest] = min(c, after.get(rest, c))
        best = after
    assert sum(n * costs[a][b] for (a, b), n in got.items()) == min(best.values())


def test_layout(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, "", "é" * rng.randrange(60), "word " * rng.randrange(300)])) for k in range(1003)] + [(5, "same")] * 3 + [(None, "n")] * 4 + [(7, "long" * 60_000)]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, shard int, size string").repartition(3)
    got = op.layout(docs).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for k in counts:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(counts[k]))
    assert all(r.law == "rows" and r.grown_shard is None for r in got)
    # No fewer rows could move, and those that move are small ones.
    moved = [r["size"] for r in got if r.moved]
    assert len(moved) <= len(rows) * 0.30 and sum(moved) / len(moved) < sum(r["size"] for r in got) / len(got) / 2


def test_only_affected_files_are_rewritten(spark, monkeypatch):
    """Blocks that stay whole keep their files; old files of the others aren't read any more; the layout is read from files."""
    monkeypatch.setattr(op, "BLOCK_ROWS", 16)
    docs = spark.createDataFrame([(k, "w" * (k * 7 % 900)) for k in range(3000)], "doc_id long, text string").repartition(3)
    path = op.store(docs)
    before = set(op.open_store(spark, path).inputFiles())
    found = op.reshard(spark, path)
    rows = found.read()
    files = set(rows.inputFiles())
    kept, affected = {found._folder(x) for x in found.kept}, {found._folder(x) for x in found.affected}
    bare = lambda f: f.removeprefix("file:").replace("///", "/")
    folder = lambda f: bare(f.rsplit("/", 1)[0])
    plain = lambda fs: {bare(f) for f in fs}
    assert {folder(f) for f in files & before} == plain(kept) and not plain(kept) & plain(affected)
    assert {folder(f) for f in before} == plain(kept) | plain(affected)
    assert all("/rewritten/" in f for f in files - before) and len(affected) < len(kept)
    got = rows.select("doc_id", "shard", "slot", "moved").collect()
    assert sorted(r.doc_id for r in got) == list(range(3000)) and 0.2 < sum(r.moved for r in got) / 3000 < 0.3
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(375))
    written = spark.read.parquet(found.written).count()
    assert sum(r.moved for r in got) <= written <= sum(r.moved for r in got) + 6 * 2 * 40


def test_one_row_repeated(spark, monkeypatch):
    """Rows that are all the same are still spread over blocks."""
    monkeypatch.setattr(op, "BLOCK_ROWS", 64)
    docs = spark.createDataFrame([(1, "same text")] * 1000, "doc_id long, text string")
    path = op.store(docs)
    assert max(n for _, n in op.blocks(op.open_store(spark, path)).values()) < 200
    got = op.layout(docs).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [125] * 8


def test_few_and_none(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert sorted(r.slot for r in op.layout(docs).collect()) == [0, 0]
    assert op.layout(docs.limit(0)).count() == 0
