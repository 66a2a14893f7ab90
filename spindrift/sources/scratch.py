"""Places for tables that a query writes and reads again, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_PLACES: list[tuple[SparkSession, str]] = []
_OWN: list[str] = []


def root(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; where it names nothing, a temporary folder serves a local master, and any other is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="spindrift-"))
    return _OWN[0]


def place(spark: SparkSession, name: str) -> str:
    """A new path, removed when the process ends."""
    path = f"{root(spark)}/spindrift-{uuid.uuid4().hex}"
    _PLACES.append((spark, path))
    return f"{path}/{name}"


def table(df: DataFrame, name: str) -> DataFrame:
    """``df``, written and read back: its lineage is cut, and lost executors lose nothing of it."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def release() -> None:
    """Remove what was written; results that read it can't be used any more."""
    while _PLACES:
        spark, path = _PLACES.pop()
        with contextlib.suppress(Py4JError, ConnectionError, AttributeError):  # the session's JVM may be gone
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
