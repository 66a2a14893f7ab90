"""Shared ground of the operators: staged tables, and joins that survive hot keys."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key above this share of the rows counts as hot, so there are at most this many hot keys.
HOT_KEYS = 1000

_STAGED: list[tuple[SparkSession, str]] = []
_OWN_ROOT: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share.  Where the session names none, a temporary one serves a local master alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not _OWN_ROOT:
        _OWN_ROOT.append("file://" + tempfile.mkdtemp(prefix="spindrift-"))
    return _OWN_ROOT[0]


#: Rows of a batch that goes to Python; with long texts or large sets in a row, Spark's own default takes too much memory.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of such a batch, unless the session names its own bound.
BATCH_BYTES = 1 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after the session's batches have been made as small as BATCH_ROWS and BATCH_BYTES."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH, "10000")) <= BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))
    if conf.get(_BYTES, None) is None:
        conf.set(_BYTES, str(BATCH_BYTES))
    return df


def tidy(run):
    """``run``, a function of batches, after which the worker hands freed memory back: workers stay alive between tasks, and several beside each other."""

    def tidied(batches):
        pa.set_memory_pool(pa.system_memory_pool())  # others keep what they are given back
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc can
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidied


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's process ends."""
    path = f"{shared_root(spark)}/spindrift/{uuid.uuid4().hex}/{name}"
    _STAGED.append((spark, path))
    return path


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Remove every staged table; results that read them can't be used any more."""
    while _STAGED:
        spark, path = _STAGED.pop()
        with contextlib.suppress(Py4JError, ConnectionError, AttributeError):  # the session's JVM may be gone
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


atexit.register(release)


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, or with marks added what no column of the frames begins with, upper or lower case."""
    taken = [c.lower() for df in frames for c in df.columns]
    while any(c.startswith(name.lower()) for c in taken):
        name += "_"
    return name


def column(name: str) -> Column:
    """The column of exactly that name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered_columns(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by their place: functions of batches can't take every name."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def _content(df: DataFrame) -> Column:
    """A hash of a row's columns, but for those that hold maps, which Spark doesn't hash."""
    return F.xxhash64(*[column(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.typeName() != "variant"])


def skew_join(left: DataFrame, right: DataFrame, key: str, weight: Column, total: int) -> DataFrame:
    """Left join with ``right``, which has one row for each key, text, binary or a whole number that isn't negative.

    ``weight`` is how many rows of ``left`` the key has, out of ``total``.  Keys
    with more than a thousandth of them, of which there can't be over a
    thousand, are broadcast; the rest are shuffled, and rows that have met their
    hot key are dealt out by their content so that they don't gather anywhere.
    Columns of ``left`` may have any name but those of ``right``'s own.
    """
    # Written once, as both parts are taken from it: else each would be computed anew, and its sorts held beside those of the joins.
    own = fresh("_join", left, right)
    size, by = f"{own}_weight", f"{own}_by"
    names = [c for c in right.columns if c != key]
    right = stage(right.withColumn(size, weight), "joined-by-key")
    least = max(1, total // HOT_KEYS)
    named = lambda kind: [column(key).alias(f"{own}_{kind}"), *[column(c).alias(f"{own}_{kind}_{c}") for c in names]]
    hot = right.where(F.col(size) > least).select(*named("hot"))
    # A key that no row has keeps this side from being empty: then the plan is the same whatever the data.
    nobody = {"long": F.lit(-1), "string": F.lit("")}.get(right.schema[key].dataType.typeName(), F.lit(b"")).cast(right.schema[key].dataType)
    none = left.sparkSession.range(1).select(nobody.alias(f"{own}_hot"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"{own}_hot_{c}") for c in names])
    hot = hot.unionByName(none)
    cold = right.where(F.col(size) <= least).select(*named("cold"))
    kind, h = left.schema[key].dataType, _content(left)
    spread = F.when(h < 0, h).otherwise(-h - 1) if kind.typeName() == "long" else F.concat(F.lit("~"), h.cast("string")).cast(kind)
    met = left.join(F.broadcast(hot), column(key) == F.col(f"{own}_hot"), "left")
    met = met.withColumn(by, F.when(F.col(f"{own}_hot").isNull(), column(key)).otherwise(spread))
    out = met.join(cold, F.col(by) == F.col(f"{own}_cold"), "left")
    return out.select(*[column(c) for c in left.columns], *[F.coalesce(column(f"{own}_hot_{c}"), column(f"{own}_cold_{c}")).alias(c) for c in names])
