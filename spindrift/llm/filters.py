"""Bloom filters of digests, built by tasks and sized by what they hold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import column, fresh, skew_join, stage

#: Bits for each member, up to MOST_BITS in all (64 MiB): a filter of more members lets more strangers pass, but never loses a member.
MEMBER_BITS, MOST_BITS, LEAST_BITS = 16, 1 << 29, 1 << 16
_BLOCK = 15


def size_for(members: int) -> int:
    bits = LEAST_BITS
    while bits < min(MOST_BITS, MEMBER_BITS * members):
        bits *= 2
    return bits


def probes(bits: int, members: int) -> int:
    """How many bits a member sets: the number that lets the fewest strangers pass."""
    return max(1, min(8, round(0.69 * bits / max(members, 1))))


def positions(digests: list[bytes], bits: int, k: int) -> np.ndarray:
    """The bits of each digest, a row for each."""
    raw = np.frombuffer(b"".join(d[:16].ljust(16, b"\0") for d in digests), "<u8").reshape(-1, 2)
    shift = np.uint64(64 - (bits.bit_length() - 1))
    a = (raw[:, 0] ^ raw[:, 1] >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    b = (raw[:, 1] ^ raw[:, 0] >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(k, dtype=np.uint64)) >> shift).astype(np.int64)


def bitmap(digests: list[bytes], bits: int, k: int) -> np.ndarray:
    out = np.zeros(bits // 8, np.uint8)
    at = positions(digests, bits, k).ravel()
    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out


def holds(words: np.ndarray, digests: list[bytes], k: int) -> np.ndarray:
    at = positions(digests, len(words) * 8, k)
    return ((words[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


class Filter:
    """Told apart on every executor whether a digest may be a member."""

    def __init__(self, words: np.ndarray, k: int):
        self.words, self.k = words, k


def of(members: DataFrame) -> Filter:
    """The filter of ``members.digest``.  Tasks set the bits of its blocks; the driver lays the blocks side by side."""
    held = stage(members.select("digest"), "members")
    n = held.count()
    bits = size_for(n)
    k = probes(bits, n)
    words = np.zeros(bits // 8, np.uint8)

    def spots(batches):
        for batch in batches:
            at = np.unique(positions(batch.column("digest").to_pylist(), bits, k)) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> _BLOCK).astype(np.int32)), pa.array((at & ((1 << _BLOCK) - 1)).astype(np.int32))], names=["block", "bit"])

    def blocks(batches):
        now, own = None, None
        for batch in batches:
            block, bit = batch.column("block").to_numpy(), batch.column("bit").to_numpy()
            for b in np.unique(block):
                if b != now:
                    if own is not None:
                        yield _row(now, own)
                    now, own = b, np.zeros(1 << (_BLOCK - 3), np.uint8)
                at = bit[block == b]
                np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        if own is not None:
            yield _row(now, own)

    found = held.mapInArrow(spots, "block int, bit int").repartition("block").sortWithinPartitions("block").mapInArrow(blocks, "block int, bits binary")
    table = found.toArrow()
    for b, own in zip(table["block"].to_pylist(), table["bits"].to_pylist(), strict=True):
        words[b << (_BLOCK - 3) : (b + 1) << (_BLOCK - 3)] = np.frombuffer(own, np.uint8)
    return Filter(words, k)


def _row(block, own) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(block)], pa.int32()), pa.array([own.tobytes()])], names=["block", "bits"])


def probe(spark, held: Filter):
    """A function of a column of digests: whether each may be a member."""
    shared = spark.sparkContext.broadcast(held)

    @F.arrow_udf("boolean")
    def maybe(digests: pa.Array) -> pa.Array:
        return pa.array(holds(shared.value.words, digests.to_pylist(), shared.value.k) if len(digests) else np.empty(0, bool))

    return maybe


def kept_rows(docs: DataFrame, key: Column, verdicts: DataFrame, extra: int = 0) -> DataFrame:
    """The rows of ``docs`` whose key stays, and one row of each key.

    ``verdicts``: key and stays, a row for each row of ``docs``, and ``extra`` more for a key that stays.  A filter of the keys that go, or that several
    rows have, decides which rows travel; all others stay where they are, so what is shuffled is about what is dropped."""
    own = fresh("_kept", docs)
    k, n, stays = f"{own}_key", f"{own}_n", f"{own}_stays"
    per = verdicts.select(F.col("key").alias(k), "stays").groupBy(k).agg(F.count(F.lit(1)).alias(n), F.max("stays").alias(stays))
    moved = stage(per.where((F.col(n) > 1 + extra) | ~F.col(stays)), "moved")
    maybe = probe(docs.sparkSession, of(moved.select(F.col(k).alias("digest"))))
    columns = [column(c) for c in docs.columns]
    held = docs.withColumn(k, key)
    rest = skew_join(held.where(maybe(k)), moved, k, F.col(n), moved.agg(F.sum(n)).first()[0] or 0)
    settled = rest.where(F.coalesce(stays, F.lit(True))).dropDuplicates([k])
    return held.where(~maybe(k)).select(*columns).unionByName(settled.select(*columns))
