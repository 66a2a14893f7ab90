import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spindrift.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=12), st.integers(0, 40))
def test_fullest(counts, room):
    sums = {0}
    for length, n in counts.items():
        for _ in range(n):
            sums |= {s + length for s in sums if s + length <= room}
    got = packing.fullest(counts, room)
    assert sum(k * n for k, n in got.items()) == max(sums) and all(n <= counts[k] for k, n in got.items())


def test_plan_is_near_the_least():
    rng = random.Random(1)
    counts = Counter(min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20_000))
    _, n = packing.plan(counts)
    assert n <= -(-sum(k * c for k, c in counts.items()) // 2048) + 5


def test_packed(spark):
    rng = random.Random(2)
    texts = [None, "", "a", "a", "Hello <|endoftext|> you", " word" * 2047, " word" * 2048, " word" * 6000, "é\n\n x"] + [" and of" * rng.randrange(700) for _ in range(200)]
    rows = [(k if k else None, t, -1) for k, t in enumerate(texts)] + [(2, "a", -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int").repartition(3)
    packed = packing.pack(docs, PATH).cache()
    library = Tokenizer.from_file(PATH)
    ids = {k: library.encode(t or "", add_special_tokens=False).ids + [0] for k, t, _ in rows}
    got = packed.collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        data = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids == data and r.ids_crc32 == zlib.crc32(data)
    for k, own in by_doc.items():
        if k != 2:
            own.sort(key=lambda r: r.piece)
            assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids[k])
            assert all(r.length == 2048 for r in own[1:])
    assert len(by_doc[2]) == 2
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_sequence) <= -(-sum(r.length for r in got) // 2048) + 2
    assert packing.sequences(packed).count() == len(by_sequence)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
