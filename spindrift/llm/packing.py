"""Best-fit packing by minimum bin slack.

Documents become token ids and pieces of at most ``capacity`` ids.  How many
pieces there are of each length is all that the packing needs, so the driver
holds one count for each possible length.  For each bin it takes the longest
piece left and finds, by subset sums over the lengths left (a bitset, longer
lengths first), the combination that fills the bin fullest; the combination is
removed as many times as the counts allow.  Every removal uses up a length, or
leaves less than half of what a bin takes of it, so the plan is bounded by the
capacity (22 000 combinations for 2048) and not by the corpus.

Pieces then get gapless numbers within their length, counted by bucket so that a
frequent length gathers nowhere, and look up their bin and place in the plan.

Defined results: a null or empty text has the end id alone; rows that repeat
are packed as often as they occur; null ids stay null; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm import segment
from spindrift.llm.common import bounded_batches, stage, tidy

CAPACITY = 2048
#: The id that ends every document.
END_ID = 0
_PIECES = "doc_id long, piece int, start long, length long, ids binary"


#: What a vocabulary file has to say for ids to be the library's (fixed values).
KNOWN = {
    "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
    "model.type": "BPE", "model.end_of_word_suffix": None, "model.continuing_subword_prefix": None, "model.dropout": None, "model.ignore_merges": False,
}


class ByteEncoder:
    """Ids as the tokenizers library gives them for a byte-level vocabulary without normaliser."""

    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        segment.require(spec, path, KNOWN)
        shown = {c: b for b, c in enumerate(segment.byte_letters())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(shown[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.ranks, self.core = ranks, tiktoken.Encoding("bytes", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.special_at = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.words = segment.Lookup(segment.byte_words, self._word)

    def _word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        known = self.ranks.get(raw)
        return [known] if known is not None else self.core.encode_single_piece(raw)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        parts, owner = [], []
        for k, t in enumerate(texts):
            cut = self.special_at.split(t) if self.special_at and "<|" in t else [t]
            if len(t) > segment.CHUNK:
                cut = [x for c in cut for x in segment.parts(c)]
            parts += cut
            owner += [k] * len(cut)
        if len(parts) == len(texts):
            return self._ids(parts)
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for a, b in segment.chunks(parts):
            for k, p, ids in zip(owner[a:b], parts[a:b], self._ids(["" if p in self.special else p for p in parts[a:b]]), strict=True):
                out[k].append(np.array([self.special[p]], np.int32) if p in self.special else ids)
        return [np.concatenate(x) for x in out]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        start, _, ids, count, at = self.words.words(texts)
        total = np.r_[0, np.cumsum(count, dtype=np.int64)][np.searchsorted(start, at)]
        return [ids[a:b] for a, b in zip(total, total[1:], strict=False)]


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece, with its ids as little-endian unsigned 32-bit integers."""

    kinds = segment.share(docs.sparkSession)

    def run(batches):
        segment.use(kinds)
        enc = encoder(path)
        try:
            yield from cut(enc, batches)
        finally:
            enc.words.clear()  # what is known of words would stay with a worker that waits

    def cut(enc, batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keys = batch.column("doc_id")
            for a, b in segment.chunks(texts):
                row, number, start, length, raw = [], [], [], [], []
                for k, ids in enumerate(enc.encode(texts[a:b]), a):
                    data = np.append(ids, END_ID).astype("<u4").tobytes()
                    n = len(ids) + 1
                    at, end = 0, n % capacity or capacity
                    while at < n:
                        row.append(k)
                        number.append(number[-1] + 1 if at else 0)
                        start.append(at)
                        length.append(end - at)
                        raw.append(data[4 * at : 4 * end])
                        at, end = end, end + capacity
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(raw, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(tidy(run), _PIECES)


def fullest(counts: dict[int, int], room: int) -> Counter:
    """The lengths, longer ones first, whose sum comes closest to ``room`` from below."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        most, times = min(counts[length], room // length), 1
        while most > 0:
            times = min(times, most)
            wider = (reach | reach << length * times) & mask
            if wider != reach:
                steps.append((length, times, reach))
                reach = wider
            most -= times
            times *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, Counter()
    for length, times, before in reversed(steps):
        if not before >> at & 1:
            out[length] += times
            at -= length * times
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, first number, pieces a bin, first sequence, offset in the bin), in order; and how many sequences."""
    left = {k: n for k, n in counts.items() if n > 0}
    used: Counter = Counter()
    rows, sequence = [], 0
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        taken = fullest({k: n for k, n in rest.items() if n}, capacity - longest)
        taken[longest] += 1
        times = min(left[k] // n for k, n in taken.items())
        offset = 0
        for length in sorted(taken, reverse=True):
            rows.append((length, used[length], taken[length], sequence, offset))
            offset += length * taken[length]
            used[length] += taken[length] * times
            left[length] -= taken[length] * times
            if not left[length]:
                del left[length]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5), sequence


def numbered(found: DataFrame) -> DataFrame:
    """``number``: gapless from 0 within each length; ``row``, a number of its own for each piece, deals them out."""
    buckets = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.withColumn("_bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("length").alias("_l"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    nth = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("row"))
    out = dealt.withColumn("_nth", nth).join(sizes, F.expr("length = _l and _bucket = _b"))
    return out.withColumn("number", F.col("_first") + F.col("_nth") - 1).drop("_bucket", "_l", "_b", "_first", "_nth")


def place(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found``: row, length and more, read from a table.  Adds sequence_id and offset."""
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most `capacity` rows
    steps, _ = plan(counts, capacity)
    held = found.sparkSession.sparkContext.broadcast(steps)
    shift = np.int64(1 << 44)

    def run(batches):
        length, first, each, sequence, offset = held.value.T
        key = length * shift + first
        for batch in batches:
            n, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            at = np.searchsorted(key, n * shift + number, "right") - 1
            nth = number - first[at]
            batch = batch.append_column("sequence_id", pa.array(sequence[at] + nth // each[at], pa.int64()))
            yield batch.append_column("offset", pa.array(offset[at] + nth % each[at] * n, pa.int64()))

    source = numbered(found)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields) + ", sequence_id long, offset long"
    return source.mapInArrow(run, schema).drop("number")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Every piece with its sequence and its place there; its ids, or their CRC-32 alone."""
    found = pieces(docs, path, capacity)
    found = found.withColumns({"ids_crc32": F.crc32("ids"), "row": F.monotonically_increasing_id()})
    return place(stage(found if keep_ids else found.drop("ids"), "pieces"), capacity).drop("row")


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each packed sequence; a sequence has at most ``capacity`` of them."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
