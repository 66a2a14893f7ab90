"""Resharding by minimum-cost flow.

A store keeps its rows in shards and, within these, in blocks of rows of like
size, each a folder of files.  Given the capacity of every new shard in rows, a
minimum-cost flow from what each old shard has of each size class to the new
shards finds the transfers that move the fewest bytes, rows of a class counting
as its mean: staying costs nothing, moving costs that mean.  The flow has a node
for each old shard and size class, whatever the number of rows.

Its transfers become ranges of row numbers within a size class.  A block that
stays whole keeps its files; all others are affected, and their rows are written
once more, to files of their new shards.  The new layout is a manifest of kept
blocks and the rewritten files: it is read from these alone, and old files of
affected blocks are never opened again.

Capacities that differ by one at most give the law ``rows``.

Defined results: a null text has one byte of size and the CRC of an empty text;
rows that repeat are rows of their own, dealt to blocks by their place in the
input; ties go by place too; null ids are dealt out by the hash of a null and of
their text; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import shared_path

OLD_SHARDS, NEW_SHARDS = 6, 8
#: Rows that a block should have, and how many blocks a store should have beyond one for each shard and class: larger stores have larger blocks.
BLOCK_ROWS, MOST_BLOCKS = 1024, 1 << 16
#: Size classes to each doubling of the size.
CLASSES = 2


def min_cost_flow(supply: dict, demand: dict, cost) -> Counter:
    """How much goes from each source to each sink at the least cost in all; supply and demand have equal sums.

    Successive shortest paths with potentials: each augments along the cheapest path of the residual graph."""
    sources, sinks = list(supply), list(demand)
    left, room = dict(supply), dict(demand)
    flow: Counter = Counter()
    price = dict.fromkeys([("s", a) for a in sources] + [("t", b) for b in sinks], 0.0)
    for a in sources:
        while left[a] > 0:
            # Cheapest way from this source to any sink with room, over sinks that may give back what others sent.
            dist, come, done, queue = {("s", a): 0.0}, {}, set(), [(0.0, 0, ("s", a))]
            tick, goal = 0, None
            while queue:
                d, _, node = heapq.heappop(queue)
                if node in done:
                    continue
                done.add(node)
                kind, x = node
                if kind == "t" and room[x] > 0:
                    goal = node
                    break
                steps = [(("t", b), cost(x, b)) for b in sinks] if kind == "s" else [(("s", s), -cost(s, x)) for s in sources if flow[s, x] > 0]
                for other, c in steps:
                    new = d + c + price[node] - price[other]
                    if other not in done and new < dist.get(other, float("inf")) - 1e-12:
                        dist[other], come[other] = new, node
                        tick += 1
                        heapq.heappush(queue, (new, tick, other))
            far = dist[goal]
            for node, d in dist.items():
                price[node] += min(d, far) if node in done else far
            for node in price:
                if node not in dist:
                    price[node] += far
            path, node = [], goal
            while node in come:
                path.append((come[node], node))
                node = come[node]
            amount = min(left[a], room[goal[1]], *[flow[v[1], u[1]] for u, v in path if u[0] == "t"])
            for u, v in path:
                if u[0] == "s":
                    flow[u[1], v[1]] += amount
                else:
                    flow[v[1], u[1]] -= amount
            left[a] -= amount
            room[goal[1]] -= amount
    return +flow


def even(rows: int, shards: int) -> list[int]:
    """Capacities that differ by one at most."""
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def size_of(text) -> F.Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


_BLOCK = ["old_shard", "class", "part"]


def store(docs: DataFrame, shards: int = OLD_SHARDS) -> str:
    """Write ``docs`` as a store of so many shards; its path.  A text is shuffled once, to its block."""
    h = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))
    size = size_of(F.col("text"))
    rows = docs.select(
        "doc_id", "text", F.pmod(h, F.lit(shards)).cast("int").alias("old_shard"), F.floor(CLASSES * F.log2(size.cast("double"))).cast("int").alias("class"),
        size.alias("size"), F.monotonically_increasing_id().alias("_place"),
    )
    counts = {(r["old_shard"], r["class"]): r["count"] for r in rows.groupBy("old_shard", "class").count().collect()}  # shards times size classes
    each = max(BLOCK_ROWS, -(-sum(counts.values()) // MOST_BLOCKS))
    parts = docs.sparkSession.createDataFrame([(*k, -(-n // each)) for k, n in counts.items()], "_o int, _c int, parts int")
    dealt = rows.join(F.broadcast(parts), F.expr("old_shard = _o and class = _c")).withColumn("part", F.pmod(F.xxhash64("_place"), F.col("parts")).cast("int"))
    nth = F.row_number().over(Window.partitionBy(*_BLOCK).orderBy("size", "doc_id", "_place"))
    path = shared_path(docs.sparkSession, "store")
    dealt.withColumn("pos", nth.cast("long") - 1).select("doc_id", "text", "size", "pos", *_BLOCK).write.option("compression", "zstd").partitionBy(*_BLOCK).parquet(path)
    return path


_STORED = "doc_id long, text string, size long, pos long"


def open_store(spark, path: str) -> DataFrame:
    return spark.read.schema(f"{_STORED}, old_shard int, class int, part int").parquet(path)


def transfers(held: DataFrame, capacities: list[int] | None = None, shards: int = NEW_SHARDS) -> DataFrame:
    """Ranges (old_shard, class, first, end, shard, slot): rows of a class by their number, where they go, and the first one's place there."""
    spark = held.sparkSession
    found = held.groupBy("old_shard", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect()  # shards times size classes
    rows = {(r["old_shard"], r["class"]): r["n"] for r in found}
    mean = {(r["old_shard"], r["class"]): r["bytes"] / r["n"] for r in found}
    room = dict(enumerate(capacities or even(sum(rows.values()), shards)))
    flow = min_cost_flow(dict(sorted(rows.items())), room, lambda a, b: 0.0 if a[0] == b else mean[a])
    plan, slot = [], Counter()
    for a in sorted(rows):
        at = 0
        # What moves has the first numbers, so that it is whole blocks as far as can be.
        for b in sorted((b for b in room if flow[a, b]), key=lambda b: (b == a[0], b)):
            n = flow[a, b]
            plan.append((*a, at, at + n, b, slot[b]))
            at, slot[b] = at + n, slot[b] + n
    return spark.createDataFrame(plan, "old_shard int, class int, first long, end long, shard int, slot long")


def blocks(held: DataFrame) -> dict[tuple, tuple[int, int]]:
    """Of each block (old shard, class, part), how many rows of its class come before it, and how many it has; bounded by MOST_BLOCKS."""
    out, before = {}, Counter()
    for r in sorted(held.groupBy(*_BLOCK).count().collect()):
        key = (r["old_shard"], r["class"])
        out[*key, r["part"]] = before[key], r["count"]
        before[key] += r["count"]
    return out


class Layout:
    """A resharded store: ``kept`` are blocks (old shard, class, part) whose files stay, with the place of their first row;
    ``affected`` those whose rows were written to ``written``, by shard."""

    def __init__(self, spark, path: str, kept: list[tuple], affected: list[tuple], written: str | None):
        self.spark, self.path, self.kept, self.affected, self.written = spark, path, kept, affected, written

    def _folder(self, block: tuple) -> str:
        return f"{self.path}/old_shard={block[0]}/class={block[1]}/part={block[2]}"

    def read(self) -> DataFrame:
        """doc_id, text, size, shard, slot, moved (whether its row was written again), from kept and rewritten files alone."""
        columns, out = ["doc_id", "text", "size", "shard", "slot", "moved"], None
        if self.kept:
            places = self.spark.createDataFrame([x[:4] for x in self.kept], "_o int, _c int, _p int, first long")
            held = self.spark.read.schema(f"{_STORED}, old_shard int, class int, part int").option("basePath", self.path).parquet(*[self._folder(x) for x in self.kept])
            held = held.join(F.broadcast(places), F.expr("old_shard = _o and class = _c and part = _p"))
            out = held.withColumns({"shard": F.col("old_shard"), "slot": F.col("first") + F.col("pos"), "moved": F.lit(False)}).select(*columns)
        if self.written:
            again = self.spark.read.schema("doc_id long, text string, size long, slot long, moved boolean, shard int").parquet(self.written).select(*columns)
            out = again if out is None else out.unionByName(again)
        return out


def reshard(spark, path: str, capacities: list[int] | None = None, shards: int = NEW_SHARDS) -> Layout | None:
    """Plan the transfers and rewrite the affected files; None for an empty store."""
    held = open_store(spark, path)
    known = blocks(held)
    if not known:
        return None
    plan = transfers(held, capacities, shards).collect()  # shards times size classes, and a few more
    ranges: dict[tuple, list] = {}
    for r in plan:
        ranges.setdefault((r["old_shard"], r["class"]), []).append(r)
    kept, affected = [], []
    for block, (before, n) in known.items():
        over = [r for r in ranges[block[:2]] if r["first"] < before + n and r["end"] > before]
        if len(over) == 1 and over[0]["shard"] == block[0]:
            kept.append((*block, over[0]["slot"] + before - over[0]["first"]))
        else:
            affected += [(*block, before, r["first"], r["end"], r["shard"], r["slot"]) for r in over]
    written = None
    if affected:
        to = spark.createDataFrame(affected, "_o int, _c int, _p int, before long, first long, end long, shard int, _slot long")
        layout_ = Layout(spark, path, [], [], None)
        rows = spark.read.schema(f"{_STORED}, old_shard int, class int, part int").option("basePath", path).parquet(*sorted({layout_._folder(x) for x in affected}))
        number = F.col("before") + F.col("pos")
        met = rows.join(F.broadcast(to), F.expr("old_shard = _o and class = _c and part = _p")).where((number >= F.col("first")) & (number < F.col("end")))
        written = shared_path(spark, "rewritten")
        met.select("doc_id", "text", "size", (F.col("_slot") + number - F.col("first")).alias("slot"), (F.col("shard") != F.col("old_shard")).alias("moved"), "shard").write.option("compression", "zstd").partitionBy("shard").parquet(written)
    return Layout(spark, path, kept, sorted({x[:3] for x in affected}), written)


_LAYOUT = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int, moved boolean"


def layout(docs: DataFrame, old_shards: int = OLD_SHARDS, shards: int = NEW_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, moved."""
    spark = docs.sparkSession
    found = reshard(spark, store(docs, old_shards), shards=shards)
    if found is None:
        return spark.createDataFrame([], _LAYOUT)
    return found.read().select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "moved",
    )
