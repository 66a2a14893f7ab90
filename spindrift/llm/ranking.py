"""Ranked lexical search with a tiered index: high-impact postings first, exact results.

Documents are searched for a stated set of items, taken in blocks of a bounded
number of terms, so that what is sent to the tasks is bounded.  One pass over
the texts counts each document's terms and keeps the postings of terms that
items of the block ask for.  A posting's impact is the part of the score that
depends on the document; counts of postings by term and level of impact, of
which there are LEVELS, tell where a term's tiers begin: the first holds some
FIRST postings with the highest impacts, each further one GROWTH times as many.
Postings of equal level stay together.  For each term and tier the highest
impact left below is kept as the residual bound.  The index has a row for each
document and its postings by tier in columns of their own, so that a search of
the high tiers reads those alone.

A search begins with the first tier.  What a document's postings there add up
to is the least it can score; with the residual bounds of the terms not seen in
it, it is also the most.  The tenth best of the least scores is an item's
threshold.  If documents without any posting in the tier can't reach it, the
documents that can are scored in full, and the best ten of these are proven
exact.  Items that lack this proof fall through to the next tier with the
thresholds they have; in the last tier nothing is left below, so scores are
whole.  Tasks keep the ten best of their documents for each item, which loses
none of the ten best of all.

Defined results: a null or empty text has no terms and is found by nothing; a
null item text asks for nothing; item rows that share an id are one item, with
the terms of all, and null ids are one such; documents that repeat are ranked
each by itself; equal scores go by the smaller id, null ids last; no document
with terms, or an empty table, gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import bounded_batches, stage, tidy

#: Terms are runs of bytes that none of these separate (ASCII, but letters and digits); A-Z become a-z.
_FOLD = bytes(c if c > 0x7F or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
#: Results of an item.
TOP = 10
#: Levels that impacts are counted by, and the largest impact there is.
LEVELS, LARGEST = 256, 1_000_000
#: Postings of a term in the first tier, and how many times as many the next ones hold.
FIRST, GROWTH = 4096, 16
#: Terms of the items that are searched for together.
BLOCK_TERMS = 200_000
#: Bytes of a text that are split at a time, and products of postings and items that are held.
CHUNK, PRODUCTS = 1 << 20, 1 << 21
_NO_ID = np.iinfo(np.int64).max


def words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, some at a time."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            part = text[at:end].translate(_FOLD)
            cut = part.rfind(b" ")
            while cut < 0 and end < len(text):  # a term longer than a chunk
                end += CHUNK
                part = text[at:end].translate(_FOLD)
                cut = part.rfind(b" ")
            if end < len(text):
                end = at + cut + 1
                part = part[:cut]
        else:
            part = text[at:].translate(_FOLD)
        yield part.split()
        at = end


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the different terms of each item, as binary."""

    def run(batches):
        for batch in batches:
            ids, terms = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = set().union(*words(text or b""))
                ids += [item] * len(own)
                terms += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], names=["item_id", "term"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).mapInArrow(tidy(run), "item_id long, term binary").distinct()


class Block:
    """Items that are searched for together: their terms' numbers, and for each term the items that ask for it."""

    def __init__(self, rows: list[tuple[int | None, bytes]]):
        self.items = sorted({i for i, _ in rows}, key=lambda i: _NO_ID if i is None else i)
        self.vocabulary = {t: k for k, t in enumerate(sorted({t for _, t in rows}))}
        place = {i: k for k, i in enumerate(self.items)}
        pairs = sorted((self.vocabulary[t], place[i]) for i, t in rows)
        self.term, self.item = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))


def _batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values.astype(np.int32)))


def postings(docs: DataFrame, block: Block) -> DataFrame:
    """(doc_id, n, terms, tfs) for every document: its number of terms, and those of the block's terms it holds."""
    held = docs.sparkSession.sparkContext.broadcast(block.vocabulary)

    def run(batches):
        number = held.value
        for batch in batches:
            terms, tfs, counts, sizes = [], [], [], []
            for text in batch.column("text").to_pylist():
                found, n = [], 0
                for part in words(text or b""):
                    n += len(part)
                    found.append(np.array([k for k in map(number.get, part) if k is not None], np.int64))
                own, tf = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64),) * 2
                terms.append(own)
                tfs.append(tf)
                counts.append(len(own))
                sizes.append(n)
            flat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
            yield _batch({"doc_id": batch.column("doc_id"), "n": pa.array(sizes, pa.int64()), "terms": _lists(flat(terms), np.array(counts, int)), "tfs": _lists(flat(tfs), np.array(counts, int))})

    narrow = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return narrow.mapInArrow(tidy(run), "doc_id long, n long, terms array<int>, tfs array<int>")


class Tiers:
    """For each of the block's terms: its weight, the lowest level of each tier, and the highest impact below each."""

    def __init__(self, n_terms: int, n_tiers: int):
        self.weight = np.zeros(n_terms, np.int64)
        self.lowest = np.full((n_tiers, n_terms), LEVELS, np.int64)
        self.residual = np.zeros((n_tiers, n_terms), np.int64)


def _impact(tf, n, n_docs: int, n_terms: int):
    return 1_000_000_000 * tf // (1000 * tf + 8 * (10 + 90 * n * n_docs // n_terms))


def _level(impact):
    return np.minimum(impact * LEVELS // LARGEST, LEVELS - 1)


def tiers(held: DataFrame, block: Block, n_docs: int, n_terms: int, first: int = FIRST, growth: int = GROWTH) -> Tiers:
    """From the counts of postings by term and level.  What comes to the driver is a row for each term and tier of the block."""
    each = held.select("n", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(F.col("p.terms").alias("term"), F.col("p.tfs").cast("long").alias("tf"), "n")
    impact = F.expr(f"1000000000L * tf div (1000L * tf + 8L * (10L + 90L * n * {n_docs}L div {n_terms}L))")
    counted = each.withColumn("impact", impact).withColumn("level", F.least(F.expr(f"impact * {LEVELS}L div {LARGEST}L"), F.lit(LEVELS - 1)))
    counted = counted.groupBy("term", "level").agg(F.count(F.lit(1)).alias("c"), F.max("impact").alias("top"))
    down = Window.partitionBy("term").orderBy(F.desc("level"))  # LEVELS rows at most
    before = F.coalesce(F.sum("c").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The tier of a level: 0 where fewer than `first` postings come before, then by powers of `growth`.
    steps = F.when(before < first, F.lit(0)).otherwise(F.floor(F.log(before / float(first)) / F.log(F.lit(float(growth)))) + 1)
    placed = counted.withColumn("tier", steps.cast("int")).groupBy("term", "tier").agg(F.sum("c").alias("c"), F.min("level").alias("lowest"), F.max("top").alias("top"))
    rows = placed.collect()
    out = Tiers(len(block.vocabulary), 1 + max((r["tier"] for r in rows), default=0))
    df = np.zeros(len(block.vocabulary), np.int64)
    for r in rows:
        df[r["term"]] += r["c"]
        out.lowest[r["tier"], r["term"]] = r["lowest"]
        if r["tier"]:
            out.residual[: r["tier"], r["term"]] = np.maximum(out.residual[: r["tier"], r["term"]], r["top"])
    out.weight[:] = [weight(n_docs, d) if d else 0 for d in df.tolist()]
    # A tier that a term has no postings in begins where the one above does.
    out.lowest = np.minimum.accumulate(out.lowest, axis=0)
    return out


def index(held: DataFrame, t: Tiers, n_docs: int, n_terms: int) -> DataFrame:
    """(doc_id, t0, i0, t1, i1, ...): a document's terms in each tier with their impacts; documents without postings have no row."""
    lowest = held.sparkSession.sparkContext.broadcast(t.lowest)
    n_tiers = len(t.lowest)

    def run(batches):
        floor = lowest.value
        for batch in batches:
            lists = batch.column("terms")
            counts = np.diff(lists.offsets.to_numpy())
            term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
            row = np.repeat(np.arange(batch.num_rows), counts)
            impact = _impact(tf, batch.column("n").to_numpy()[row], n_docs, n_terms)
            level = _level(impact)
            tier = (level < floor[:, term]).sum(axis=0)
            columns = {"doc_id": batch.column("doc_id")}
            for k in range(n_tiers):
                own = tier == k
                per = np.bincount(row[own], minlength=batch.num_rows)
                columns |= {f"t{k}": _lists(term[own], per), f"i{k}": _lists(impact[own], per)}
            yield _batch(columns)

    schema = "doc_id long, " + ", ".join(f"t{k} array<int>, i{k} array<int>" for k in range(n_tiers))
    return held.where(F.size("terms") > 0).mapInArrow(tidy(run), schema)


class _Best:
    """The best TOP documents of each item among those offered, ties by the smaller id."""

    def __init__(self, least: np.ndarray):
        self.least = least.copy()
        self.held = [np.empty((0, 3), np.int64)]
        self.waiting = 0

    def offer(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        self.held.append(np.stack([item, score, doc], axis=1))
        self.waiting += len(item)
        if self.waiting > 100_000:
            self.settle()

    def settle(self) -> np.ndarray:
        rows = np.concatenate(self.held)
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        nth = np.arange(len(rows)) - np.searchsorted(rows[:, 0], rows[:, 0])
        rows = rows[nth < TOP]
        full = rows[nth[nth < TOP] == TOP - 1]
        self.least[full[:, 0]] = np.maximum(self.least[full[:, 0]], full[:, 1])
        self.held, self.waiting = [rows], 0
        return rows


class _Asked:
    """For each term the open items that ask for it, for adding up products of postings and items."""

    def __init__(self, term: np.ndarray, item: np.ndarray, open_: np.ndarray, n_terms: int):
        self.n = len(open_)
        keep = open_[item]
        self.item = item[keep]
        self.first = np.searchsorted(term[keep], np.arange(n_terms + 1))

    def sums(self, row: np.ndarray, term: np.ndarray, values: list[np.ndarray], rows: int) -> list[np.ndarray]:
        """For each of ``values``, one for a posting: their sums over rows and items.  Below 2**53, so exact as doubles."""
        counts = self.first[term + 1] - self.first[term]
        out = [np.zeros(rows * self.n) for _ in values]
        ends = np.cumsum(counts)
        lo = 0
        while lo < len(term):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PRODUCTS, "right")))
            c = counts[lo:hi]
            at = np.arange(int(c.sum())) + np.repeat(self.first[term[lo:hi]] - (np.cumsum(c) - c), c)
            cell = np.repeat(row[lo:hi], c) * self.n + self.item[at]
            for total, v in zip(out, values, strict=True):
                total += np.bincount(cell, np.repeat(v[lo:hi], c), rows * self.n)
            lo = hi
        return [x.reshape(rows, self.n) for x in out]


def _scan(found: DataFrame, block: Block, t: Tiers, depth: int, open_: np.ndarray, least: np.ndarray, prove: bool) -> DataFrame:
    """(item, doc_id, score) of the best documents of each task's part of the index, for the open items.

    Without ``prove``: by what the tiers up to ``depth`` add up to, from ``least`` on.  With it: of the documents that
    can reach ``least`` by the residual bounds, by their full scores."""
    read = len(t.lowest) if prove else depth + 1
    shared = found.sparkSession.sparkContext.broadcast((block.term, block.item, t.weight, t.residual[depth] * t.weight, open_, least))

    def run(batches):
        terms, items, weight, bound, open_, least = shared.value
        asked, best = _Asked(terms, items, open_, len(weight)), _Best(least)
        unseen = np.bincount(items, bound[terms], len(open_))  # of a document without postings in these tiers
        per = max(1, (1 << 21) // len(open_))  # documents at a time
        for whole in batches:
            for at in range(0, whole.num_rows, per):
                batch = whole.slice(at, per)
                docs = batch.column("doc_id").fill_null(_NO_ID).to_numpy()
                row, term, impact, upto = [], [], [], 0
                for k in range(read):
                    lists = batch.column(f"t{k}")
                    row.append(np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())))
                    term.append(lists.flatten().to_numpy().astype(np.int64))
                    impact.append(batch.column(f"i{k}").flatten().to_numpy().astype(np.int64))
                    upto = upto + len(row[-1]) if k <= depth else upto
                row, term, impact = (np.concatenate(x) for x in (row, term, impact))
                value = (impact * weight[term]).astype(float)
                if not prove:
                    scores = asked.sums(row, term, [value], batch.num_rows)[0]
                else:
                    part, seen = asked.sums(row[:upto], term[:upto], [value[:upto], bound[term[:upto]].astype(float)], batch.num_rows)
                    may = (part + unseen - seen >= best.least) & open_
                    live = may.any(axis=1)
                    again = live[row]
                    number = np.cumsum(live) - 1
                    scores = asked.sums(number[row[again]], term[again], [value[again]], int(live.sum()))[0]
                    scores = np.where(may[live], scores, 0)
                    docs = docs[live]
                r, i = np.nonzero((scores >= np.maximum(best.least, 1)) & open_)
                best.offer(i, scores[r, i].astype(np.int64), docs[r])
        rows = best.settle()
        yield _batch({"item": pa.array(rows[:, 0].astype(np.int32)), "score": pa.array(rows[:, 1]), "doc_id": pa.array(rows[:, 2])})

    columns = ["doc_id", *[f"{c}{k}" for k in range(read) for c in "ti"]]
    return found.select(*columns).mapInArrow(tidy(run), "item int, score long, doc_id long")


def _ranked(scored: DataFrame) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def search_block(docs: DataFrame, block: Block, first: int = FIRST, growth: int = GROWTH, told: dict | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score) of the block's items."""
    spark = docs.sparkSession
    held = stage(postings(docs, block), "postings")
    n_docs, n_terms = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    schema = "item_id long, rank int, doc_id long, score long"
    if not n_terms:
        return spark.createDataFrame([], schema)
    t = tiers(held, block, n_docs, n_terms, first, growth)
    found = stage(index(held, t, n_docs, n_terms), "index")
    n = len(block.items)
    open_, least, parts = np.ones(n, bool), np.zeros(n, np.int64), []
    last = len(t.lowest) - 1
    for depth in range(last + 1):
        scored = _scan(found, block, t, depth, open_, least, prove=False)
        if depth == last:
            parts.append(scored)
            break
        # The tenth best of the least scores; a row for each open item.
        for r in _ranked(scored).where(F.col("rank") == TOP).select("item", "score").collect():
            least[r["item"]] = max(least[r["item"]], r["score"])
        unseen = np.bincount(block.item, (t.residual[depth] * t.weight)[block.term], n)
        proven = open_ & (unseen < least)
        if told is not None:
            told[depth] = int(proven.sum())
        if proven.any():
            parts.append(_scan(found, block, t, depth, proven, least, prove=True))
        open_ = open_ & ~proven
        if not open_.any():
            break
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    names = F.array(*[F.lit(i).cast("long") for i in block.items])
    doc = F.when(F.col("doc_id") != _NO_ID, F.col("doc_id"))
    return _ranked(scored).select(F.get(names, F.col("item")).alias("item_id"), F.col("rank").cast("int").alias("rank"), doc.alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, block_terms: int = BLOCK_TERMS, **how) -> DataFrame:
    """``docs``: doc_id, text; ``items``: item_id, text.  (item_id, rank, doc_id, score) of each item's TOP best documents."""
    terms = stage(item_terms(items), "items")
    n = terms.count()
    blocks = max(1, -(-n // block_terms))
    dealt = terms.withColumn("_b", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        rows = [(r["item_id"], bytes(r["term"])) for r in dealt.where(F.col("_b") == b).select("item_id", "term").collect()]  # about block_terms
        if rows:
            out = out.unionByName(search_block(docs, Block(rows), **how))
    return out
