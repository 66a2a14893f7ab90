"""WARC archives compressed record by record with a Zstandard dictionary of their own.

Each task writes its rows to archives of bounded size.  The first records of an
archive train a dictionary; the archive begins with it, in a skippable frame,
and every record follows as a frame of its own, so that any record can be read
from the dictionary and its frame alone.  Of records with equal payloads that
with the smallest id is the response, and the others revisit it.

An archive is a row for each frame, with the frame's offset, in a table that all
executors can reach; laid end to end the frames are the ``.warc.zst`` file,
which :func:`export` writes where the folder is mounted.

Defined results: null html is an empty payload; null ids come after all others
and stay null; of rows that repeat an id with an equal payload each is a
response; a null url has no target header; an empty table makes no archive;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import bounded_batches, skew_join, stage, tidy

#: Bytes of records in an archive, and of those at its beginning that train its dictionary of at most so many bytes.
ARCHIVE_BYTES, TRAIN_BYTES, DICTIONARY_BYTES = 64 << 20, 4 << 20, 110 << 10
LEVEL = 3
#: Tasks that read archives at most; with more archives each reads several, one after the other.
MOST_READERS = 20_000
DATE = "2024-01-01T00:00:00Z"
#: Magic number of the skippable frame that holds a dictionary (fixed value).
MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FRAMES = "archive string, offset long, frame binary"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    head.append(f"WARC-Date: {DATE}")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of a record; its lengths and digest have to agree."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest(payload) != told):
        raise ValueError("the payload doesn't have its record's digest")
    number = lambda name: int(re.search(r"<urn:page:(-?\d+)>", fields[name])[1]) if name in fields else None
    return number("WARC-Record-ID"), size, told, kind, number("WARC-Refers-To"), payload if kind == "response" else None


def dictionary(samples: list[bytes]) -> bytes:
    """Trained on the samples; what is too little to train on serves as it is."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:16384]


def _kind(raw: bytes) -> zstandard.ZstdCompressionDict:
    trained = raw[:4] == b"\x37\xa4\x30\xec"
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def frames(records: Iterator[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(archive number, offset, frame) of all records, in order."""
    number, held, size = 0, [], 0
    packer, offset = None, 0

    def start():
        raw = dictionary(held)
        first = struct.pack("<II", MAGIC, len(raw)) + raw
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=_kind(raw), write_content_size=True, write_checksum=True), first

    def flush():
        nonlocal packer, offset, held
        if not held:
            return
        if packer is None:
            packer, first = start()
            yield number, 0, first
            offset = len(first)
        for x in held:
            frame = packer.compress(x)
            yield number, offset, frame
            offset += len(frame)
        held = []

    for x in records:
        held.append(x)
        size += len(x)
        if packer is not None or size >= TRAIN_BYTES:
            yield from flush()
        if size >= ARCHIVE_BYTES:
            number, size, packer = number + 1, 0, None
    yield from flush()


def unpack(found: Iterator[tuple[str, bytes]]) -> Iterator[bytes]:
    """The records of frames (archive, frame) that come in order."""
    reader, archive = None, None
    for name, frame in found:
        if name != archive:
            magic, size = struct.unpack("<II", frame[:8])
            if magic != MAGIC or len(frame) != 8 + size:
                raise ValueError("an archive has to begin with its dictionary")
            reader, archive = zstandard.ZstdDecompressor(dict_data=_kind(frame[8:])), name
        else:
            yield reader.decompress(frame)


def marked(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers_to."""
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("_digest"))
    groups = stage(rows.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_copies")), "payloads")
    total = groups.agg(F.sum("_copies")).first()[0] or 0
    out = skew_join(rows, groups.where("_copies > 1"), "_digest", F.col("_copies"), total)
    return out.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"))


def write(pages: DataFrame) -> DataFrame:
    """The archives: archive, offset, frame; in a table of their own."""

    def run(batches):
        def records():
            for batch in batches:
                for p, u, h, r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    yield record(p, u, (h or "").encode("utf-8", "surrogatepass"), r)

        name, out, size = f"{TaskContext.get().partitionId():06d}", [], 0
        for number, offset, frame in frames(records()):
            out.append((f"{name}-{number:06d}", offset, frame))
            size += len(frame)
            if size >= 4 << 20:
                yield _rows(out)
                out, size = [], 0
        if out:
            yield _rows(out)

    return stage(marked(bounded_batches(pages)).mapInArrow(tidy(run), FRAMES), "archives")


def _rows(out) -> pa.RecordBatch:
    a, o, f = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(o, pa.int64()), pa.array(f, pa.binary())], names=["archive", "offset", "frame"])


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives, parsed and checked."""

    def run(batches):
        def found():
            for batch in batches:
                yield from zip(batch.column("archive").to_pylist(), batch.column("frame").to_pylist(), strict=True)

        names = [x.split()[0] for x in READ.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        out, size = [], 0
        for data in unpack(found()):
            row = parse(data)
            out.append(row if payloads else (*row[:5], None))
            size += len(data) if payloads else 200
            if size >= 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return _in_order(archives).select("archive", "frame").mapInArrow(tidy(run), READ)


def _in_order(archives: DataFrame) -> DataFrame:
    """Frames in order, about an archive to a task, as long as there are no more than MOST_READERS archives."""
    n = archives.select("archive").distinct().count()
    return archives.repartition(min(max(n, 1), MOST_READERS), "archive").sortWithinPartitions("archive", "offset")


def export(archives: DataFrame, folder: str) -> None:
    """Write each archive as a .warc.zst file; ``folder`` has to be mounted on all executors."""

    def run(batches):
        at, name = None, None
        for batch in batches:
            for a, f in zip(batch.column("archive").to_pylist(), batch.column("frame").to_pylist(), strict=True):
                if a != name:
                    if at:
                        at.close()
                        os.replace(f"{folder}/.{name}", f"{folder}/{name}.warc.zst")
                    at, name = open(f"{folder}/.{a}", "wb"), a
                at.write(f)
        if at:
            at.close()
            os.replace(f"{folder}/.{name}", f"{folder}/{name}.warc.zst")
        yield from ()

    _in_order(archives).mapInArrow(run, "x int").write.format("noop").mode("overwrite").save()


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the archives."""
    return read(write(pages), payloads=False).drop("payload")
