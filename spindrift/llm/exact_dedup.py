"""Exact dedup by a log-structured merge index.

Every row becomes a digest entry.  Memtables of a bounded number of entries
collapse equal digests and flush sorted runs.  The runs of a batch are merged by
digest into one run of the first level, laid out in buckets of the digest, each
with a Bloom filter; compaction merges runs of a level, once there are enough,
into one of the next.  Of each digest the entry that survives is kept: the most
code points, then the smallest id.  A lookup asks the filters, and reads only
those buckets of runs that may hold what is asked.

Digests with several rows are hits.  A filter sized by the hits decides which
texts travel for byte verification: by digest, the least and the greatest
normalised text have to be the same bytes.  Where they are not, the rows of that
digest are grouped by their whole text instead.

Defined results: a null text counts as empty; a null id is larger than any
other and stays null; repeated rows (same id, same text) form one group, of
which one row is kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import filters
from spindrift.llm.common import shared_path, skew_join, stage, tidy

#: White space that the normalisation deletes.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: Entries that a memtable holds before it flushes a run, and runs of a level that are merged into one of the next.
MEMTABLE, FANOUT = 131_072, 4
#: Entries that a bucket of a run should have, and the most buckets.
BUCKET_ENTRIES, MOST_BUCKETS = 1 << 20, 4096
_NO_ID = np.iinfo(np.int64).max
_RUN = "digest binary, n_points int, doc_id long, row long, members long"
_FILTER = "run int, bucket int, bits binary, k int"


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    raw = batch.column("digest")
    width = len(raw[0].as_py()) if len(raw) else 0
    digests = np.frombuffer(b"".join(raw.to_pylist()), dtype=f"V{width}") if width else np.empty(0, "V1")
    ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
    return digests, batch.column("n_points").to_numpy(), ids, batch.column("row").to_numpy(), batch.column("members").to_numpy()


def _collapse(digests, points, ids, rows, members, in_order=False):
    """One entry for each digest, sorted: the survivor, and how many rows it stands for."""
    keys = digests.view(np.uint8).reshape(len(digests), -1)
    if not in_order:
        order = np.lexsort((rows, ids, -points.astype(np.int64), *keys.T[::-1]))
        digests, points, ids, rows, members, keys = (x[order] for x in (digests, points, ids, rows, members, keys))
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    return digests[first], points[first], ids[first], rows[first], np.add.reduceat(members, first)


def _entries(digests, points, ids, rows, members) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(digests.tolist(), pa.binary()), pa.array(points, pa.int32()), pa.array(ids, pa.int64(), mask=ids == _NO_ID), pa.array(rows, pa.int64()), pa.array(members, pa.int64())],
        names=["digest", "n_points", "doc_id", "row", "members"],
    )


def _memtable(batches):
    """Collapse up to MEMTABLE entries in memory, flush them sorted, begin anew."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(_columns(batch))
        n += batch.num_rows
        if n >= MEMTABLE:
            yield _entries(*_collapse(*map(np.concatenate, zip(*held, strict=True))))
            held, n = [], 0
    if held:
        yield _entries(*_collapse(*map(np.concatenate, zip(*held, strict=True))))


def _merge(batches):
    """Merge what comes in order of digest; the last digest of a batch waits for the next."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = _columns(batch)
        if last is not None:
            now = tuple(np.concatenate([a, b]) for a, b in zip(last, now, strict=True))
        now = _collapse(*now, in_order=True)
        last = tuple(x[-1:] for x in now)
        if len(now[1]) > 1:
            yield _entries(*(x[:-1] for x in now))
    if last is not None:
        yield _entries(*last)


class Index:
    """Runs of digest entries (digest, n_points, doc_id, row, members) in a folder that all executors share.

    ``runs`` says of each run its level and entries; a folder belongs to one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.runs: dict[int, tuple[int, int]] = {}
        self.made = 0
        #: Of the last lookup: buckets of runs that were read, and that the filters ruled out.
        self.touched = self.skipped = 0

    def _bucket(self) -> Column:
        lead = F.conv(F.hex(F.substring(F.rpad("digest", F.lit(2), F.lit(b"\0")), F.lit(1), F.lit(2))), 16, 10).cast("int")
        return F.shiftright(lead * self.buckets, 16).alias("bucket")

    def _at(self, run: int) -> str:
        return f"{self.path}/run-{run}"

    def _write(self, entries: DataFrame, level: int) -> None:
        """Merge ``entries`` by digest into a run of ``level``, with its filters."""
        run, self.made = self.made, self.made + 1
        dealt = entries.withColumn("bucket", self._bucket()).repartition(self.buckets, "bucket")
        merged = dealt.sortWithinPartitions("digest", F.col("n_points").desc(), F.col("doc_id").asc_nulls_last(), "row").drop("bucket").mapInArrow(tidy(_merge), _RUN)
        merged.withColumn("bucket", self._bucket()).write.option("compression", "zstd").partitionBy("bucket").parquet(self._at(run))
        n = self._read([run]).count()
        self.runs[run] = (level, n)
        bits = filters.size_for(-(-n // self.buckets))
        k = filters.probes(bits, -(-n // self.buckets))

        def filtered(batches):
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                bucket, digests = batch.column("bucket").to_numpy(zero_copy_only=False), np.array(batch.column("digest").to_pylist(), object)
                for b in np.unique(bucket):
                    own = filters.bitmap(digests[bucket == b].tolist(), bits, k)
                    held[int(b)] = held[int(b)] | own if int(b) in held else own
            for b, own in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([run], pa.int32()), pa.array([b], pa.int32()), pa.array([own.tobytes()]), pa.array([k], pa.int32())], names=["run", "bucket", "bits", "k"])

        self._read([run]).select("bucket", "digest").mapInArrow(filtered, _FILTER).write.parquet(f"{self.path}/filter-{run}")

    def _read(self, runs: list[int]) -> DataFrame:
        parts = [self.spark.read.schema(f"{_RUN}, bucket int").parquet(self._at(r)) for r in runs]
        return reduce(DataFrame.unionByName, parts)

    def add(self, rows: DataFrame) -> None:
        """``rows``: digest, n_points, doc_id, row.  A batch becomes a run; then levels that are full are compacted."""
        flushed = stage(rows.select("digest", F.col("n_points").cast("int").alias("n_points"), "doc_id", "row", F.lit(1).cast("long").alias("members")).mapInArrow(tidy(_memtable), _RUN), "flushed")
        self._write(flushed, 0)
        self.compact()

    def compact(self) -> None:
        level = 0
        while any(of >= level for of, _ in self.runs.values()):
            full = [r for r, (of, _) in self.runs.items() if of == level]
            if len(full) >= FANOUT:
                self._write(self._read(full).drop("bucket"), level + 1)
                for r in full:
                    del self.runs[r]
            level += 1

    def entries(self) -> DataFrame:
        """A row for each digest, whatever the runs it is in; of one run it is the run."""
        held = self._read(list(self.runs))
        if len(self.runs) == 1:
            return held.drop("bucket")
        dealt = held.repartition(self.buckets, "bucket").sortWithinPartitions("digest", F.col("n_points").desc(), F.col("doc_id").asc_nulls_last(), "row")
        return dealt.drop("bucket").mapInArrow(tidy(_merge), _RUN)

    def lookup(self, asked: DataFrame) -> DataFrame:
        """The entries of ``asked.digest``, from those buckets of runs alone whose filters may hold one of them."""
        known = self.spark.read.schema(_FILTER).parquet(*[f"{self.path}/filter-{r}" for r in self.runs])
        wanted = stage(asked.select("digest").distinct(), "asked")
        both = known.withColumns({"kind": F.lit(0), "digest": F.lit(None).cast("binary")}).unionByName(
            wanted.select(F.lit(None).cast("int").alias("run"), self._bucket(), F.lit(None).cast("binary").alias("bits"), F.lit(None).cast("int").alias("k"), F.lit(1).alias("kind"), "digest")
        )

        def maybe(batches):
            bucket, held, found = None, {}, set()
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("bucket", "kind", "run", "bits", "k", "digest")]
                for b, kind, run, bits, k, digest in zip(*columns, strict=True):
                    if b != bucket:
                        bucket, held = b, {}
                    if kind == 0:
                        own = np.frombuffer(bits, np.uint8)
                        held[run, k] = held[run, k] | own if (run, k) in held else own
                    else:
                        for (r, k_), own in held.items():
                            if (r, b) not in found and filters.holds(own, [digest], k_)[0]:
                                found.add((r, b))
            if found:
                r, b = zip(*sorted(found), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(b, pa.int32())], names=["run", "bucket"])

        places = both.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(maybe, "run int, bucket int").collect()  # runs times buckets at most
        self.touched = len(places)
        self.skipped = known.select("run", "bucket").distinct().count() - self.touched
        if not places:
            return self.spark.createDataFrame([], _RUN)
        found = None
        for run in sorted({p["run"] for p in places}):
            # The base path keeps the bucket a column; other buckets' files aren't opened.
            part = self.spark.read.schema(_RUN).parquet(*[f"{self._at(run)}/bucket={p['bucket']}" for p in places if p["run"] == run])
            found = part if found is None else found.unionByName(part)
        return found.join(wanted, "digest", "left_semi")


def index_of(rows: DataFrame, total: int) -> Index:
    """An index of its own for ``rows`` (digest, n_points, doc_id, row), of which there are ``total``."""
    buckets = min(MOST_BUCKETS, max(8, -(-total // BUCKET_ENTRIES)))
    out = Index(rows.sparkSession, shared_path(rows.sparkSession, "index"), buckets)
    out.add(rows)
    return out


def entries_of(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """doc_id, n_points, sha, digest, and a number of its own for every row; in a table, as the numbers have to stay."""
    sha = F.unhex(F.sha2(normalised(F.col("text")), 256))
    rows = docs.select("doc_id", _points(), sha.alias("sha"), F.monotonically_increasing_id().alias("row"))
    return stage(rows, "entries").withColumn("digest", F.substring("sha", 1, digest_bytes))


def _points() -> Column:
    return F.coalesce(F.char_length("text"), F.lit(0)).alias("n_points")


def verdicts(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_points for every row; ``digest_bytes`` shortens the index's digests, for tests of the byte verification."""
    spark = docs.sparkSession
    rows = entries_of(docs, digest_bytes)
    total = rows.count()
    hits = index_of(rows, total).entries().where("members > 1")
    maybe = filters.probe(spark, filters.of(hits.select("digest")))
    norm = normalised(F.col("text"))
    texts = docs.select("doc_id", _points(), norm.alias("norm"), F.substring(F.unhex(F.sha2(norm, 256)), 1, digest_bytes).alias("digest"))
    checked = texts.where(maybe("digest")).groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("greatest"))
    collided = stage(checked.where("least <> greatest").select("digest"), "collided")
    found = hits.select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), "members")
    if not collided.isEmpty():
        # Different texts under one digest: their rows are told apart by the digest of the whole text, and its survivor found anew.
        held = rows.join(F.broadcast(collided) if collided.count() < 100_000 else collided, "digest", "left_semi")
        best = F.min(F.struct((-F.col("n_points")).alias("p"), F.coalesce("doc_id", F.lit(int(_NO_ID))).alias("id"), F.col("row").alias("r")))
        exact = held.groupBy("sha").agg(best.alias("b"), F.count(F.lit(1)).alias("members")).where("members > 1")
        exact = exact.select(F.col("sha").alias("digest"), F.nullif("b.id", F.lit(int(_NO_ID))).alias("keep_id"), F.col("b.r").alias("keep_row"), "members")
        found = stage(found.join(collided, "digest", "left_anti").unionByName(exact), "found")
        rows = rows.join(collided.withColumn("hit", F.lit(True)), "digest", "left").withColumn("digest", F.when(F.col("hit"), F.col("sha")).otherwise(F.col("digest"))).drop("hit")
    out = skew_join(rows, found, "digest", F.col("members"), total)
    alone = F.col("members").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("members", F.lit(1)).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "n_points",
    )


def dedup(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """A row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    return verdicts(docs, digest_bytes).drop("n_points")


def _key(doc_id: str, sha, points) -> Column:
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), sha, points.cast("string"))))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat in full, one."""
    told = verdicts(docs).select(_key("doc_id", F.col("text_sha256"), F.col("n_points")).alias("key"), F.col("kept").alias("stays"))
    return filters.kept_rows(docs, _key("doc_id", F.sha2(normalised(F.col("text")), 256), F.coalesce(F.char_length("text"), F.lit(0))), told)
