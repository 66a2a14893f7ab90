"""Runs and registered models as tables."""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = "run_id string, experiment string, params map<string,string>, metrics map<string,double>, tags map<string,string>, artifacts map<string,string>, signature string"
MODELS = "name string, version int, run_id string, model_path string, stage string"


def logger(name: str, error_file: str | None = None) -> logging.Logger:
    """Everything to the console, errors to a file too."""
    out = logging.getLogger(name)
    if not out.handlers:
        out.setLevel(logging.DEBUG)
        out.addHandler(logging.StreamHandler())
    if error_file and not any(isinstance(h, logging.FileHandler) and h.baseFilename == error_file for h in out.handlers):
        to_file = logging.FileHandler(error_file)
        to_file.setLevel(logging.ERROR)
        out.addHandler(to_file)
    return out


def signature(inputs: DataFrame, outputs: DataFrame | None = None) -> str:
    """Names and types of what a model takes and gives."""
    of = lambda df: [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields]
    return json.dumps({"inputs": of(inputs), "outputs": of(outputs) if outputs is not None else []})


def require(df: DataFrame, held: str) -> DataFrame:
    """``df``, if it has the input columns of a signature with their types; else a ValueError."""
    own = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wrong = [f"{x['name']} {x['type']}" for x in json.loads(held)["inputs"] if own.get(x["name"]) != x["type"]]
    if wrong:
        raise ValueError(f"missing or of another type: {', '.join(wrong)}")
    return df


def signature_rows(spark: SparkSession, held: str) -> DataFrame:
    """(role, position, name, type) of a signature."""
    found = json.loads(held)
    rows = [(role, k, x["name"], x["type"]) for role in ("inputs", "outputs") for k, x in enumerate(found[role])]
    return spark.createDataFrame(rows, "role string, position int, name string, type string")


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _files(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _files(spark, path)
    fs.delete(at, True)


class Runs:
    """An append-only table of runs in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def log(self, run_id: str, experiment: str, params: dict, metrics: dict, tags: dict | None = None, artifacts: dict | None = None, held: str | None = None) -> None:
        """``held``: the model's signature."""
        texts = lambda d: {k: str(v) for k, v in (d or {}).items()}
        row = (run_id, experiment, texts(params), {k: float(v) for k, v in metrics.items()}, texts(tags), texts(artifacts), held)
        self.spark.createDataFrame([row], RUNS).coalesce(1).write.mode("append").parquet(self.path)

    def log_table(self, run_id: str, name: str, df: DataFrame) -> str:
        """Store a small table as an artifact of a run; its path."""
        path = f"{self.path}-artifacts/{run_id}/{name}"
        df.coalesce(1).write.mode("overwrite").parquet(path)
        return path

    def log_dataset(self, run_id: str, name: str, df: DataFrame) -> str:
        """Store a dataset, however large, as an artifact of a run; its path."""
        path = f"{self.path}-artifacts/{run_id}/datasets/{name}"
        df.write.mode("overwrite").parquet(path)
        return path

    def table(self) -> DataFrame:
        return self.spark.read.schema(RUNS).parquet(self.path)


class Models:
    """Versions of models and their stages, one small file for each change; the latest stage of a version counts.

    A version, or the number of a change, belongs to whoever creates its marker file, which a file system lets one
    writer do; so two writers never get the same."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _log(self) -> DataFrame | None:
        return self.spark.read.schema(MODELS + ", change long").parquet(f"{self.path}/log") if exists(self.spark, f"{self.path}/log") else None

    def _claim(self, kind: str, least: int) -> int:
        n = least
        while True:
            fs, at = _files(self.spark, f"{self.path}/claims/{kind}-{n}")
            fs.mkdirs(at.getParent())
            try:
                fs.create(at, False).close()
                return n
            except Exception:
                if not fs.exists(at):
                    raise
                n += 1

    def _append(self, row: tuple) -> None:
        log = self._log()
        change = self._claim("change", 1 if log is None else (log.agg(F.max("change")).first()[0] or 0) + 1)
        self.spark.createDataFrame([(*row, change)], MODELS + ", change long").coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def table(self) -> DataFrame:
        log = self._log()
        if log is None:
            return self.spark.createDataFrame([], MODELS)
        latest = log.groupBy("name", "version").agg(F.max_by(F.struct("run_id", "model_path", "stage"), "change").alias("x"))
        return latest.select("name", "version", "x.*")

    def register(self, name: str, run_id: str, model_path: str, stage: str = "Staging") -> int:
        version = self._claim(f"version-{name}", (self.table().where(F.col("name") == name).agg(F.max("version")).first()[0] or 0) + 1)
        self._append((name, version, run_id, model_path, stage))
        return version

    def move(self, name: str, version: int, stage: str) -> None:
        row = self.table().where((F.col("name") == name) & (F.col("version") == version)).first()
        if row is None:
            raise ValueError(f"no version {version} of {name}")
        self._append((name, version, row["run_id"], row["model_path"], stage))

    def path_of(self, name: str, version: int | None = None, stage: str | None = None) -> str:
        """Where a version's model lies."""
        return self.row_of(name, version, stage)["model_path"]

    def row_of(self, name: str, version: int | None = None, stage: str | None = None):
        """A version's row; the latest one, of a stage if one is named."""
        held = self.table().where(F.col("name") == name)
        held = held.where(F.col("version") == version) if version is not None else held
        row = (held.where(F.col("stage") == stage) if stage else held).orderBy(F.desc("version")).first()
        if row is None:
            raise ValueError(f"no such version of {name}")
        return row
