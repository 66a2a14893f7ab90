import base64
import hashlib
import struct

import pytest
import zstandard

from spindrift.llm import warc


def brute(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        f = first.get(h or "")
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == f else "revisit", None if i == f else f))
    return sorted(map(repr, out))


ROWS = [(3, "http://a/é b", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "http://c\r\nX: y", None), (9, "u", ""), (None, "u", ""), (None, "u", "only"), (5, "u", "x" * 300_000)] + [
    (100 + k, f"http://h/{k}", f"<html><body><p>page {k % 60} of the same kind</p>{'<li>item</li>' * (k % 9)}</body></html>") for k in range(200)
]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, refers_to string").repartition(3)
    archives = warc.write(pages).cache()
    got = warc.read(archives).collect()
    assert sorted(repr(tuple(r)[:5]) for r in got) == brute(ROWS)
    html = {r[0]: r[2] for r in ROWS if r[0] is not None}
    assert all(bytes(r.payload).decode() == (html[r.page_id] or "") for r in got if r.record_type == "response" and r.page_id is not None)
    warc.export(archives, str(tmp_path))
    seen = 0
    for path in tmp_path.glob("*.warc.zst"):
        data = path.read_bytes()
        magic, n = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D
        reader, at = zstandard.ZstdDecompressor(dict_data=warc._kind(data[8 : 8 + n])), 8 + n
        while at < len(data):
            one = reader.decompressobj()
            text = one.decompress(data[at:])
            at = len(data) - len(one.unused_data)
            warc.parse(text)
            seen += 1
    assert seen == len(ROWS)


def test_archives_are_bounded(monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5000)
    monkeypatch.setattr(warc, "TRAIN_BYTES", 2000)
    data = [warc.record(k, "u", b"abc" * k, None) for k in range(100)]
    out = list(warc.frames(iter(data)))
    assert len({n for n, _, _ in out}) > 3
    assert list(warc.unpack((str(n), f) for n, _, f in out)) == data


def test_damage_is_noticed():
    with pytest.raises(ValueError, match="digest"):
        warc.parse(warc.record(1, "u", b"abc", None).replace(b"abc", b"abd"))


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repeated_id_with_an_equal_payload(spark):
    """Each row of the smallest id is a response; other ids revisit it."""
    pages = spark.createDataFrame([(3, "u", "same"), (3, "u", "same"), (5, "u", "same"), (None, "u", "same"), (4, None, None)], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=repr)
    assert got == sorted([(3, "response", None), (3, "response", None), (5, "revisit", 3), (None, "revisit", 3), (4, "response", None)], key=repr)
