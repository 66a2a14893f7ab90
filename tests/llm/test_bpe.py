import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spindrift.llm import bpe, packing, segment

PATH = public_tokenizers.path("word_bpe_49k.json")
BYTE_PATH = public_tokenizers.path("byte_bpe_50k.json")
CHARS = st.one_of(st.sampled_from(list("ab stdrevml'’.,!0129 \n\t\r ÀéÉßüΣσςİıǅ́²Ⅷ漢字🙂 \x1c\x85_-<|>")), st.characters(exclude_categories=["Cs"]))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(library, texts):
    ids = bpe.encoder(PATH).encode(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [i.tolist() for i in ids] == want
    assert [bpe.encoder(PATH).decode(i) for i in ids] == library.decode_batch(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(CHARS, max_size=60), min_size=1, max_size=6))
def test_as_the_library(library, texts):
    same(library, texts)


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(CHARS, max_size=300), min_size=1, max_size=4), st.integers(1, 9))
def test_small_leaves(library, texts, leaf):
    old = bpe.LEAF, bpe.REACH, bpe.WORD_LEAF
    try:
        bpe.LEAF, bpe.REACH, bpe.WORD_LEAF = leaf, 2, 4
        bpe.encoder(PATH).words.clear()
        same(library, texts)
    finally:
        bpe.LEAF, bpe.REACH, bpe.WORD_LEAF = old
        bpe.encoder(PATH).words.clear()


def test_every_code_point(library):
    """Each between letters, digits, blanks and marks, in both vocabularies."""
    points = segment.every_point()
    texts = []
    for a in range(0x20, len(points), 256):
        texts.append(" ".join(f"a{c}b {c} 1{c}{c}2" for c in map(chr, points[a : a + 256])))
    texts += ["".join(f"e{c}\u0301\u0323 " for c in map(chr, points[a : a + 64])) for a in range(0x20, 0x3000, 64)]
    same(library, texts)
    plain = Tokenizer.from_file(BYTE_PATH)
    got = packing.encoder(BYTE_PATH).encode(texts)
    assert [i.tolist() for i in got] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_words_of_one_hash(monkeypatch):
    """Words are told apart by their code points, whatever their hashes."""
    monkeypatch.setattr(segment, "hashes", lambda cp, start, end: (end - start).astype(segment.np.uint64) << segment.np.uint64(64 - segment._SLOT_BITS) | segment.np.uint64(1))
    seen = segment.Lookup(segment.byte_words, lambda w: [len(w), *map(ord, w)])
    for texts in (["ab cd ab", "xy"], ["cd ab xy zz", "zz"], ["ab"]):
        start, end, ids, count, _ = seen.words(texts)
        whole = "".join(texts)
        assert ids.tolist() == [x for a, b in zip(start, end, strict=True) for x in (b - a, *map(ord, whole[a:b]))]


def test_parts_of_a_long_text():
    texts = ["it's  a \n text " * 400, "x" * 5000, "a b " * 900 + "<|endoftext|> tail " * 300, "漢字 " * 2000]
    old, segment.CHUNK = segment.CHUNK, 64
    try:
        got = packing.ByteEncoder(BYTE_PATH).encode(texts)
        assert all("".join(segment.parts(t, 64)) == t for t in texts) and len(segment.parts(texts[0], 64)) > 10
    finally:
        segment.CHUNK = old
    assert [i.tolist() for i in got] == [e.ids for e in Tokenizer.from_file(BYTE_PATH).encode_batch(texts, add_special_tokens=False)]


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_long_and_special(library):
    same(library, ["a" * 9000, "thesandtion" * 3000, "", " ", "x <|endoftext|>y<|startoftext|>", "-=" * 6000, "1" * 5000, ("don't we'll " * 4000)])


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(CHARS, max_size=60), min_size=1, max_size=6))
def test_byte_words(texts):
    t = Tokenizer.from_file(BYTE_PATH)
    cp, at = segment.points(texts)
    start, end = segment.byte_words(cp, at)
    joined = "".join(texts)
    got = [joined[a:b] for a, b in zip(start, end, strict=True)]
    want = [x[a:b] for x in texts for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(x)]
    assert got == want


def test_query_columns(spark):
    docs = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (3, "Hello, World's", "z"), (None, "Hello, World's", "z")], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.encode(docs, PATH).collect()}
    assert got[1].ids == got[2].ids == b"" and got[1].decoded == "" and got[3].ids == got[None].ids


def test_a_lookup_is_small():
    """Every worker of an executor has one: all its tables together are bounded."""
    held = segment.Lookup(segment.byte_words, lambda w: [len(w)])
    assert sum(x.nbytes for x in vars(held).values() if hasattr(x, "nbytes")) <= 21 << 20
