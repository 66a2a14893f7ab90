"""Near-duplicates by bottom-k sketches of word shingles.

One hash function maps a document's distinct five-word shingles to numbers; the
k smallest are its sketch.  Documents with equal sets collapse to one
representative.  The 32 smallest numbers of each representative open inverted
lists.  Documents with a similarity of 0.85 share at least so many of these 32
numbers (but for one pair in a million) that it is enough for each to list some
of its rarest; that keeps passages which very many documents share out of the
lists.  Of lists with the same members one is compared.

Within a list, of which no task holds more than a block, sketches give the
overlap of each pair of similar size.  Below the smaller of both sketches' last
numbers the sketches hold everything, so the ratio of shared to all numbers
there estimates the similarity (and is the similarity, for sets within k).
Pairs below the lowest count that a link's sketches can show, but for one link
in a million, are dropped.  Of the others a list first emits a spanning forest,
strongest first, which is verified on the full sets by exact Jaccard; linked
documents become components.  A second pass looks at lists whose members are
still in different components: members with a doubtful partner meet in blocks
of bounded bytes with their full sets, each loaded once, where all overlaps are
counted exactly.  No step emits more pairs than a list has members.

Defined results: null, empty and blank texts have no shingles and are linked
with nothing; rows that repeat share their representative; a row without id
names no component: it belongs to the one of an equal set, else it stays with a
null component; rows that share an id but not their set are judged each by
their own text; ties go to the smallest id; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import filters, segment
from spindrift.llm.common import bounded_batches, skew_join, stage, tidy
from spindrift.llm.components import components

WORDS = 5
#: Numbers of a sketch; how many of them may open lists.
K, LISTED = 256, 32
#: A link: SHARE of 100 parts of the union are shared.
SHARE = 85
#: The chance that a link's sketches fall short of the count that the filter asks for.
MISSED = 1e-6
#: Members of a list that one task compares, and bytes of full sets, by blocks.
BLOCK, BLOCK_BYTES = 2048, 32 << 20
#: Columns of a block's table of shared shingles that are held at a time.
COLUMNS = 1 << 16
_NO_ID = np.iinfo(np.int64).max
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and where it starts."""
    data = np.frombuffer(raw, np.uint8)
    change = np.flatnonzero(np.diff(np.r_[False, ~_BREAK[data], False].astype(np.int8)))
    start, end = change[::2], change[1::2]
    return segment.hashes(data, start, end) if len(start) else np.empty(0, np.uint64), start


def _word_hashes(text: str) -> np.ndarray:
    """The hashes of a text's words, some at a time: a long text's arrays would be many times its size."""
    raw = text.encode("utf-8", "surrogatepass").translate(_LOWER)
    out, at = [], 0
    while at < len(raw):
        m = _GAP.search(raw, at + segment.CHUNK)
        end = m.start() if m else len(raw)
        out.append(_hashed(raw[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 63-bit numbers."""
    found = [_word_hashes(t) for t in texts] if len(texts) > 1 and any(len(t) > segment.CHUNK for t in texts) else None
    if found is None and len(texts) == 1:
        found = [_word_hashes(texts[0])]
    out = [np.empty(0, np.uint64)] * len(texts)
    if found is not None:
        h, first = np.concatenate(found), np.r_[0, np.cumsum([len(x) for x in found])]
    else:
        raw = b"\n".join(t.encode("utf-8", "surrogatepass") for t in texts).translate(_LOWER) + b"\n"
        h, start = _hashed(raw)
        first = np.searchsorted(start, np.r_[0, np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts])])
    if not len(h):
        return out
    rolled = np.zeros(len(h), np.uint64)
    for j in range(WORDS):
        rolled[: max(0, len(h) - j)] += h[j:] * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1) + 2 * j * j) % 2**64 | 1)
    mixed = _mix(rolled)
    for k in range(len(texts)):
        a, b = first[k], first[k + 1]
        if b - a >= WORDS:
            out[k] = np.unique(mixed[a : b - WORDS + 1])
        elif b > a:
            few = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    few = few * np.uint64(0xD6E8FEB86659FD93) + x
            out[k] = _mix(np.array([few], np.uint64))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(1)


def least_shared(draws: int) -> int:
    """The largest count of which fewer are shared, among so many numbers of the union, with a chance of up to MISSED where SHARE of them should be."""
    p, below = SHARE / 100, 0.0
    term = draws * math.log(1 - p)  # by logarithms, as the first terms are too small for a number
    for k in range(draws + 1):
        if below + math.exp(term) > MISSED:
            return k
        below += math.exp(term)
        term += math.log((draws - k) / (k + 1) * p / (1 - p)) if k < draws else 0
    return draws


#: Of the numbers that may open lists, so many are shared by a link; for sets below that, at least half of all.
_LISTED_SHARED = least_shared(LISTED)
#: For unions of up to two sketches.
_LEAST = np.array([least_shared(n) for n in range(2 * K + 1)])


def _sketches(batches):
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for a, b in segment.chunks(texts):
            sets = shingle_sets(texts[a:b])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(a, b - a).fill_null(_NO_ID), batch.column("text_key").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_set_key(s) for s in sets], pa.binary()),
                    pa.array([s[:LISTED].astype(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([s[:K].tobytes() for s in sets], pa.binary()),
                ],
                names=["doc_id", "text_key", "n_shingles", "set_key", "low", "sketch"],
            )


def _set_key(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _text_key():
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id (a null as the largest number), a key of the text, n_shingles, a key of the whole set, its smallest numbers, its sketch."""
    keyed = docs.select("doc_id", "text", _text_key().alias("text_key"))
    return keyed.mapInArrow(tidy(_sketches), "doc_id long, text_key binary, n_shingles long, set_key binary, low array<long>, sketch binary")


def lists(reps: DataFrame) -> DataFrame:
    """(number, node, members): the inverted lists of at least two representatives, each set of members once."""
    opened = reps.select("node", F.least("n_shingles", F.lit(LISTED)).alias("size"), F.explode("low").alias("number"))
    total = reps.agg(F.sum(F.size("low"))).first()[0] or 0
    often = opened.groupBy("number").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    shared = skew_join(opened, often, "number", F.col("often"), total).where("often is not null")
    # Numbers of its own are each document's rarest; they use up places, but need no list.
    own = shared.groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("often", "number"))).alias("found"))
    places = F.expr(f"size - least(int(ceil(size / 2)), {_LISTED_SHARED}) + 1 - (size - size(found))")
    rows = own.select("node", F.explode(F.slice("found", F.lit(1), F.greatest(places, F.lit(0)))).alias("x")).select(F.col("x.number").alias("number"), "node")
    rows = stage(rows, "lists")
    mark = lambda seed: F.sum(F.xxhash64("node", F.lit(seed)).cast("decimal(20,0)"))
    sizes = rows.groupBy("number").agg(F.count(F.lit(1)).alias("members"), mark(1).alias("_x"), mark(2).alias("_y")).where("members > 1")
    # Lists with the same members (told by two sums of hashes) would give the same pairs: one of them stands for all.
    once = sizes.groupBy("members", "_x", "_y").agg(F.min("number").alias("number")).select("number", "members")
    return stage(skew_join(rows, once, "number", F.col("members"), rows.count()).where("members is not null"), "shared-lists")


def units(members: DataFrame, blocks) -> DataFrame:
    """Deals each list to units: the list itself, or for one of several ``blocks`` every two of these."""
    out = members.withColumn("_n", blocks.cast("int")).withColumn("_b", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
    grid = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda o: F.struct(F.least(o, F.col("_b")).alias("i"), F.greatest(o, F.col("_b")).alias("j")))
    out = out.withColumn("_u", F.explode(grid)).withColumn("side", F.when(F.col("_u.i") == F.col("_u.j"), 2).when(F.col("_b") == F.col("_u.i"), 0).otherwise(1))
    return out.withColumn("unit", F.xxhash64("number", "_u.i", "_u.j")).drop("_n", "_b", "_u", "members")


class _Forest:
    def __init__(self, labels):
        self.of = {x: x for x in labels}

    def root(self, x):
        while self.of[x] != x:
            self.of[x] = self.of[self.of[x]]
            x = self.of[x]
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        self.of[max(a, b)] = min(a, b)
        return a != b


def _estimates(sets: list[np.ndarray], n: np.ndarray, label: np.ndarray, side: np.ndarray):
    """Pairs of different labels that may be links, row by row: (i, js, estimates, whether each is exact)."""
    order = np.argsort(n, kind="stable")
    flat = np.concatenate([sets[i] for i in order])
    size = np.array([len(sets[i]) for i in order])
    at = np.r_[0, np.cumsum(size)]
    values, number, times = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    words = max(1, (int((times > 1).sum()) + 63) // 64)
    bits = np.zeros((len(order), words), np.uint64)
    row = np.repeat(np.arange(len(order)), size)
    common = times[number] > 1
    spot = place[number[common]]
    np.bitwise_or.at(bits, (row[common], spot >> 6), np.uint64(1) << (spot & 63).astype(np.uint64))
    n, label, side = n[order], label[order], side[order]
    last = np.array([s[-1] for s in (sets[i] for i in order)])
    whole = n <= K
    top = np.where(whole, np.uint64(np.iinfo(np.int64).max), last)
    for i in range(len(order) - 1):
        stop = np.searchsorted(n, n[i] * 100 / SHARE, "right")
        j = np.arange(i + 1, stop)
        j = j[(label[j] != label[i]) & ((side[j] != side[i]) | (side[j] == 2))]
        if not len(j):
            continue
        both = np.bitwise_count(bits[i] & bits[j]).sum(axis=1).astype(np.int64)
        near = 2 * both >= _LEAST[np.minimum(size[i], size[j])]  # a cheap bound far below what a link has
        j, both = j[near], both[near]
        if not len(j):
            continue
        tau = np.minimum(top[i], top[j])
        mine = np.searchsorted(flat[at[i] : at[i + 1]], tau, "right")
        theirs = np.array([size[k] if top[k] <= top[i] else np.searchsorted(flat[at[k] : at[k + 1]], top[i], "right") for k in j])
        union = mine + theirs - both
        sure = whole[i] & whole[j]
        ok = np.where(sure, 100 * both >= SHARE * union, both >= _LEAST[np.minimum(union, 2 * K)])
        if ok.any():
            yield int(order[i]), order[j[ok]], both[ok] / union[ok], sure[ok]


def _strongest(label: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Of rows (estimate, i, j) a spanning forest of the labels, strongest first."""
    forest, keep = _Forest(set(label.tolist())), []
    for k in np.argsort(-pairs[:, 0], kind="stable"):
        if forest.join(int(label[int(pairs[k, 1])]), int(label[int(pairs[k, 2])])):
            keep.append(k)
    return pairs[keep]


def _first_pairs(node, n, label, side, sets) -> list[tuple]:
    """(node, node, sure): a spanning forest of the sure pairs and one of the doubtful ones; no more is ever held."""
    sure_forest, out, held, waiting = _Forest(set(label.tolist())), [], np.empty((0, 3)), 0
    parts = []
    for i, js, estimate, sure in _estimates(sets, n, label, side):
        for j in js[sure]:
            if sure_forest.join(int(label[i]), int(label[j])):
                out.append((node[i], node[j], True))
        if not sure.all():
            parts.append(np.c_[estimate[~sure], np.full((~sure).sum(), i), js[~sure]])
            waiting += len(parts[-1])
        if waiting > 16 * len(node):
            held, parts, waiting = _strongest(label, np.concatenate([held, *parts])), [], 0
    if parts:
        held = _strongest(label, np.concatenate([held, *parts]))
    return out + [(node[int(i)], node[int(j)], False) for _, i, j in held]


def _doubtful(node, n, label, side, sets) -> list[int]:
    """The members with a partner of another label that may be a link, but isn't sure."""
    found = np.zeros(len(node), bool)
    for i, js, _, sure in _estimates(sets, n, label, side):
        if not sure.all():
            found[i] = True
            found[js[~sure]] = True
    return node[found].tolist()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How much every two sets share, by bits of the numbers that at least two of them have."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, number, times = np.unique(flat, return_inverse=True, return_counts=True)
    common = times[number] > 1
    row, spot = row[common], (np.cumsum(times > 1) - 1)[number[common]]
    order = np.argsort(spot, kind="stable")
    row, spot = row[order], spot[order]
    out = np.zeros((len(sets), len(sets)), np.int32)
    for a in range(0, int(spot[-1]) + 1 if len(spot) else 0, COLUMNS):
        lo, hi = np.searchsorted(spot, [a, a + COLUMNS])
        width = (min(COLUMNS, int(spot[hi - 1]) - a + 1) + 63) // 64
        bits = np.zeros((len(sets), width), np.uint64)
        own = spot[lo:hi] - a
        np.bitwise_or.at(bits, (row[lo:hi], own >> 6), np.uint64(1) << (own & 63).astype(np.uint64))
        live = np.flatnonzero(bits.any(axis=1))
        step = max(1, (1 << 21) // max(1, width * 8))
        for k, i in enumerate(live):
            for b in range(k + 1, len(live), step):
                j = live[b : b + step]
                out[i, j] += np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int32)
    return out + out.T


def _exact_pairs(node, label, side, sets) -> list[tuple]:
    """A spanning forest of the links, by the full sets."""
    n = np.array([len(x) for x in sets])
    both, forest, out = overlaps(sets), _Forest(set(label.tolist())), []
    for i in range(len(node) - 1):
        j = np.arange(i + 1, len(node))
        ok = (100 * both[i, j] >= SHARE * (n[i] + n[j] - both[i, j])) & (label[j] != label[i]) & ((side[j] != side[i]) | (side[j] == 2))
        out += [(node[i], node[k], True) for k in j[ok] if forest.join(int(label[i]), int(label[k]))]
    return out


def _by_unit(columns: tuple[str, ...], close, rows):
    """In order of unit come its members; ``close`` makes of them what ``rows`` turns into a batch."""

    def run(batches):
        held: list[tuple] = []
        unit = None

        def done():
            if len(held) > 1 and len({x[2] for x in held}) > 1:
                return close(held)
            return []

        for batch in batches:
            out = []
            for x in zip(*(batch.column(c).to_pylist() for c in ("unit", *columns)), strict=True):
                if x[0] != unit:
                    out += done()
                    held, unit = [], x[0]
                held.append(x)
            if out:
                yield rows(out)
        if out := done():
            yield rows(out)

    return run


def _arrays(held, *numbers: int) -> list[np.ndarray]:
    return [np.array([x[c] for x in held], np.int64) for c in numbers]


def _first_of_unit(held):
    node, label, n, side = _arrays(held, 1, 2, 3, 4)
    return _first_pairs(node, n, label, side, [np.frombuffer(x[5], np.uint64) for x in held])


def _doubtful_of_unit(held):
    node, label, n, side, number = _arrays(held, 1, 2, 3, 4, 6)
    return [(number[0], x) for x in _doubtful(node, n, label, side, [np.frombuffer(x[5], np.uint64) for x in held])]


def _exact_of_unit(held):
    node, label, side = _arrays(held, 1, 2, 3)
    return _exact_pairs(node, label, side, [np.frombuffer(x[4], np.uint64) for x in held])


def _pair_rows(out) -> pa.RecordBatch:
    a, b, sure = zip(*out, strict=True)
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sure, pa.bool_())], names=["a", "b", "sure"])


def _member_rows(out) -> pa.RecordBatch:
    number, node = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(node, pa.int64())], names=["number", "node"])


_SKETCHED = ("node", "label", "n_shingles", "side", "sketch", "number")
_WHOLE = ("node", "label", "side", "shingles")


def _dealt(members: DataFrame, blocks, data: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    held = units(members, blocks).join(data, "node")
    return held.repartition("unit").sortWithinPartitions("unit").select("unit", *columns)


def candidate_pairs(members: DataFrame, sketched: DataFrame) -> DataFrame:
    """``members``: number, node, members, label.  Pairs (a, b, sure) of different labels, each once."""
    dealt = _dealt(members, F.ceil(F.col("members") / BLOCK), sketched, _SKETCHED)
    pairs = dealt.mapInArrow(tidy(_by_unit(_SKETCHED, _first_of_unit, _pair_rows)), "a long, b long, sure boolean")
    return stage(pairs.groupBy("a", "b").agg(F.max("sure").alias("sure")), "pairs")


def _full_sets(batches):
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for a, b in segment.chunks(texts):
            sets = shingle_sets(texts[a:b])
            yield pa.RecordBatch.from_arrays([pa.array([_set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_key", "shingles"])


def full_sets(docs: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes ``asked`` (node); ``nodes``: node, rep, set_key.  Texts are read again, of few others by a filter."""
    wanted = stage(nodes.join(asked.select("node").distinct(), "node", "left_semi").select("node", "rep", "set_key"), "asked")
    maybe = filters.probe(docs.sparkSession, filters.of(wanted.select(_key(F.col("rep")).alias("digest"))))
    texts = docs.where("doc_id is not null").select("doc_id", "text").where(maybe(_key(F.col("doc_id"))))
    made = texts.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("text").mapInArrow(tidy(_full_sets), "set_key binary, shingles binary")
    return stage(made.join(wanted.select("node", "set_key"), "set_key").groupBy("node").agg(F.min("shingles").alias("shingles")), "full-sets")


def _key(column):
    return F.unhex(F.md5(column.cast("string")))


def _verify(batches):
    for batch in batches:
        keep = []
        # Views of the batch, pair by pair: long texts have large sets, and a copy of a whole batch would double them.
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= SHARE * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def first_links(docs: DataFrame, members: DataFrame, sketched: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) of the lists' spanning forests: sure ones, and doubtful ones that their full sets confirm."""
    pairs = candidate_pairs(members.withColumn("label", F.col("node")), sketched)
    out, doubtful = pairs.where("sure").select("a", "b"), pairs.where("not sure").select("a", "b")
    if doubtful.isEmpty():
        return out
    sets = full_sets(docs, nodes, doubtful.select(F.explode(F.array("a", "b")).alias("node")))
    joined = doubtful.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return stage(out.unionByName(joined.select("a", "b", "x", "y").mapInArrow(tidy(_verify), "a long, b long")), "links")


def further_links(docs: DataFrame, members: DataFrame, sketched: DataFrame, nodes: DataFrame, joined: DataFrame) -> DataFrame | None:
    """Links between the components ``joined`` (node, component), from every doubtful pair of a list; None if there is none."""
    labels = joined.select(F.col("node").alias("_node"), "component")
    labelled = members.join(labels, F.col("node") == F.col("_node"), "left").select("number", "node", "members", F.coalesce("component", "node").alias("label"))
    apart = labelled.groupBy("number").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.max("members").alias("_members")).where("_lo <> _hi").select("number", "_members")
    rest = stage(skew_join(labelled, apart, "number", F.col("_members"), labelled.count()).where("_members is not null").drop("_members"), "lists-apart")
    dealt = _dealt(rest, F.ceil(F.col("members") / BLOCK), sketched, _SKETCHED)
    open_ = stage(dealt.mapInArrow(tidy(_by_unit(_SKETCHED, _doubtful_of_unit, _member_rows)), "number long, node long").distinct(), "doubtful")
    if open_.isEmpty():
        return None
    held = open_.join(nodes.select("node", "n_shingles"), "node")
    held = held.join(labels, F.col("node") == F.col("_node"), "left").select("number", "node", "n_shingles", F.coalesce("component", "node").alias("label"))
    sizes = held.groupBy("number").agg(F.count(F.lit(1)).alias("members"), F.sum(F.col("n_shingles") * 8).alias("bytes"))
    both = stage(skew_join(held, sizes, "number", F.col("members"), held.count()), "doubtful-lists")
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("bytes") / BLOCK_BYTES))
    whole = _dealt(both.drop("n_shingles"), blocks, full_sets(docs, nodes, open_), _WHOLE)
    return stage(whole.mapInArrow(tidy(_by_unit(_WHOLE, _exact_of_unit, _pair_rows)), "a long, b long, sure boolean").select("a", "b").distinct(), "further-links")


def representatives(found: DataFrame) -> DataFrame:
    """A row for each different set: its smallest id, its numbers, how many documents have it, and a node of its own.

    The node is the smallest id; where other sets share that id, numbers above all ids tell them apart."""
    known = found.where((F.col("n_shingles") > 0) & (F.col("doc_id") < F.lit(int(_NO_ID))))
    reps = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("low").alias("low"), F.count(F.lit(1)).alias("copies"))
    reps = stage(reps, "sets")
    clash = stage(reps.groupBy("rep").agg(F.count(F.lit(1)).alias("_n"), F.min("set_key").alias("_first")).where("_n > 1").select(F.col("rep").alias("_rep"), "_first"), "clashes")
    if clash.isEmpty():
        return reps.withColumn("node", F.col("rep"))
    above = reps.agg(F.max("rep")).first()[0] + 1
    first = reps.join(clash.select(F.col("_first").alias("set_key"), F.lit(True).alias("_is")), "set_key", "left")
    held = first.join(clash.select("_rep"), F.col("rep") == F.col("_rep"), "left")
    own = F.when(F.col("_rep").isNull() | F.col("_is"), F.col("rep")).otherwise(F.lit(above) + F.monotonically_increasing_id())
    return stage(held.withColumn("node", own).drop("_rep", "_is"), "nodes")


def merged(joined: DataFrame, more: DataFrame) -> DataFrame:
    """The components (node, component) after further links (a, b): those that are linked become one.  Only these go through the steps again."""
    label = lambda c: F.coalesce(F.col(c), F.col(c[1:]))
    of = lambda c: joined.select(F.col("node").alias(f"_n{c}"), F.col("component").alias(f"_{c}"))
    met = more.join(of("a"), F.col("a") == F.col("_na"), "left").join(of("b"), F.col("b") == F.col("_nb"), "left")
    again = stage(components(met.select(label("_a").alias("u"), label("_b").alias("v"))), "merged").select(F.col("node").alias("_old"), F.col("component").alias("_new"))
    old = joined.join(again, F.col("component") == F.col("_old"), "left").select("node", F.coalesce("_new", "component").alias("component"))
    # Nodes that had no link before are components of their own.
    first = again.join(joined.select(F.col("component").alias("_known")).distinct(), F.col("_old") == F.col("_known"), "left_anti").select(F.col("_old").alias("node"), F.col("_new").alias("component"))
    return stage(old.unionByName(first), "components")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and component_id (the largest number for none), n_shingles, set_key, text_key of every row."""
    found = stage(sketches(bounded_batches(docs)), "sketches")
    reps = representatives(found)
    members = lists(reps)
    nodes = reps.select("node", "rep", "set_key", "n_shingles")
    listed = reps.join(members.select("node").distinct(), "node", "left_semi").select("node", "set_key")
    maybe = filters.probe(docs.sparkSession, filters.of(listed.select(F.col("set_key").alias("digest"))))
    sketched = found.where("n_shingles > 0").select("set_key", "n_shingles", "sketch").where(maybe("set_key")).groupBy("set_key").agg(F.min(F.struct("n_shingles", "sketch")).alias("x"))
    sketched = stage(sketched.join(listed, "set_key").select("node", "x.*"), "listed-sketches")
    linked = first_links(docs, members, sketched, nodes)
    joined = stage(components(linked.toDF("u", "v")), "components")
    more = further_links(docs, members, sketched, nodes, joined)
    if more is not None and not more.isEmpty():
        joined = merged(joined, more)
    named = reps.join(joined.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("set_key", "rep", F.coalesce("component", "node").alias("component"), "copies")
    # A component's number is its smallest node; where that stands for a repeated id, the id is looked up.
    stand_ins = reps.where("node <> rep").select(F.col("node").alias("_stand"), F.col("rep").alias("_for"))
    named = named.join(stand_ins, F.col("component") == F.col("_stand"), "left").select("set_key", F.coalesce("_for", "component").alias("component_id"), "copies")
    out = skew_join(found.select("doc_id", "n_shingles", "set_key", "text_key"), named, "set_key", F.col("copies"), found.count())
    return out.select("doc_id", "n_shingles", "set_key", "text_key", F.coalesce("component_id", "doc_id").alias("component_id"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    null, out = F.lit(int(_NO_ID)), classes(docs)
    return out.select(F.nullif("doc_id", null).alias("doc_id"), "n_shingles", F.nullif("component_id", null).alias("component_id"), (F.col("component_id") == F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, and all rows without id.

    Of rows with the component's id and the same set one text stays, and of rows that repeat it in full one row;
    a row of a repeated id whose own text belongs to another component goes with that."""
    null, known = F.lit(int(_NO_ID)), docs.where("doc_id is not null")
    told = classes(docs).where(F.col("doc_id") < null).withColumn("_set", F.coalesce("set_key", "text_key"))
    told = stage(told.select("doc_id", "text_key", "_set", (F.col("component_id") == F.col("doc_id")).alias("_first")), "told")
    chosen = told.where("_first").groupBy("doc_id", "_set").agg(F.min("text_key").alias("text_key")).select(_row_key().alias("key"), F.lit(True).alias("stays"))
    verdicts = told.select(_row_key().alias("key"), F.lit(False).alias("stays")).unionByName(chosen)
    return filters.kept_rows(known, _row_key(_text_key()), verdicts, extra=1).unionByName(docs.where("doc_id is null"))


def _row_key(text_key="text_key"):
    return F.unhex(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.hex(text_key))))
