"""The training pipeline: ingest, preprocess, build, evaluate, register.

:data:`GRAPH` says what each stage needs and makes, and the run follows it: a
stage fails if one of its inputs is missing, and is passed over if its outputs
are there and neither its inputs nor its parameters have changed since.  Each
stage reads what the one before it wrote, so a failed run goes on from there."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import boosting, cleaning, evaluate, features, models, sampling
from spindrift.operators.lemmas import Lemmatizer
from spindrift.plans.registry import Models, Runs, exists, logger, require, signature
from spindrift.sources import tables

#: (stage, inputs, outputs, parameters), in the order in which they run.
GRAPH = [
    ("ingest", ["input"], ["raw"], ["test_size"]), ("preprocess", ["raw"], ["lexicon", "interim"], []),
    ("build", ["interim"], ["vectorizer", "model"], ["max_features", "ngram_range", "params"]),
    ("evaluate", ["interim", "vectorizer", "model"], ["predictions", "runs", "pointer"], ["run_id"]), ("register", ["pointer"], ["models"], ["name"]),
]


@dataclass
class Training:
    spark: SparkSession
    root: str
    test_size: float = 0.2
    max_features: int = 1000
    ngram_range: tuple[int, int] = (1, 3)
    name: str = "sentiment"
    params: models.Params = None
    run_id: str = "run"
    error_file: str | None = None

    def __post_init__(self):
        self.params = self.params or models.Params()
        self.log = logger("spindrift.training", self.error_file)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def ingest(self, comments: DataFrame) -> None:
        held = cleaning.ingest_clean(comments, "clean_comment", ["clean_comment", "category"])
        keyed = held.withColumn("key", F.concat_ws("|", "category", "clean_comment"))
        train, test = sampling.train_test(keyed, "key", test_size=self.test_size)
        tables.write_split(train.drop("key"), test.drop("key"), self.at("raw"))

    def preprocess(self) -> None:
        """The lexicon comes from the training part; what is asked later is normalised with the same."""
        parts = {part: self.spark.read.parquet(f"{self.at('raw')}/{part}") for part in ("train", "test")}
        lemmas = Lemmatizer(self.spark, self.at("lexicon")).fit(parts["train"], "clean_comment")
        for part, df in parts.items():
            lemmas.normalise(df, "clean_comment", "clean_comment", fitted=part == "train").write.mode("overwrite").parquet(f"{self.at('interim')}/{part}")

    def build(self) -> None:
        train = self.spark.read.parquet(f"{self.at('interim')}/train")
        vec = features.Vectorizer(self.max_features, self.ngram_range).fit(train, "clean_comment")
        vec.save(self.at("vectorizer"))
        models.boosted(self.params).fit(models.labelled(vec.transform(train, "clean_comment"))).save(self.spark, self.at("model"))

    def evaluate(self) -> tuple[DataFrame, DataFrame]:
        test = self.spark.read.parquet(f"{self.at('interim')}/test")
        vec = features.Vectorizer().load(self.at("vectorizer"))
        scored = models.sentiment(boosting.load(self.spark, self.at("model")).transform(vec.transform(test, "clean_comment")))
        scored.select("category", "sentiment").write.mode("overwrite").parquet(self.at("predictions"))
        held = self.spark.read.parquet(self.at("predictions"))
        report, matrix = evaluate.evaluate(held, "category", "sentiment")
        metrics = {r["name"].replace(" ", "_"): r["value"] for r in evaluate.flat_report(report).collect()}
        runs = Runs(self.spark, self.at("runs"))
        kept = {"model": self.at("model"), "vectorizer": self.at("vectorizer"), "confusion_matrix_test": runs.log_table(self.run_id, "confusion_matrix_test", evaluate.confusion_artifact(held, "test", "category", "sentiment"))}
        given = {"test_size": self.test_size, "max_features": self.max_features, "ngram_range": self.ngram_range, **asdict(self.params)}
        tags = {"model_type": "boosted trees", "task": "sentiment analysis", "dataset": "comments"}
        runs.log(self.run_id, self.name, given, metrics, tags, kept, signature(test.select("clean_comment"), scored.select("sentiment")))
        tables.write_pointer(self.spark, self.run_id, self.at("model"), self.at("pointer"))
        return report, matrix

    def register(self) -> int:
        found = tables.read_pointer(self.spark, self.at("pointer")).first()
        return Models(self.spark, self.at("models")).register(self.name, found["run_id"], found["model_path"])

    def scorer(self, version: int | None = None, stage: str | None = None) -> models.Scorer:
        """The registered model with its vectorizer; it takes what the run's signature says."""
        path = Models(self.spark, self.at("models")).path_of(self.name, version, stage)
        return models.Scorer(Lemmatizer(self.spark, self.at("lexicon")), features.Vectorizer().load(self.at("vectorizer")), boosting.load(self.spark, path))

    def score(self, comments: DataFrame, version: int | None = None, stage: str | None = None) -> DataFrame:
        run_id = Models(self.spark, self.at("models")).row_of(self.name, version, stage)["run_id"]
        run = Runs(self.spark, self.at("runs")).table().where(F.col("run_id") == run_id).first()
        return self.scorer(version, stage).score(require(comments, run["signature"]), "clean_comment")

    # The graph -----------------------------------------------------------------------------------

    def _print(self, stage: str, inputs: list[str], parameters: list[str], prints: dict[str, str]) -> str:
        """What a stage depends on: its parameters, and what its inputs were made from."""
        given = {p: asdict(v) if p == "params" else v for p in parameters for v in [getattr(self, p)]}
        return hashlib.sha256(json.dumps([stage, given, [prints[i] for i in inputs]], default=str).encode()).hexdigest()

    def _state(self) -> dict[str, str]:
        path = self.at("state")
        return {r["stage"]: r["print"] for r in self.spark.read.schema("stage string, print string").json(path).collect()} if exists(self.spark, path) else {}

    def run(self, comments: DataFrame, run_id: str | None = None) -> list[str]:
        """The names of the stages that ran."""
        self.run_id = run_id or self.run_id
        mark = comments.select(F.xxhash64(*comments.columns).alias("h")).agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)"))).first()
        prints, state, ran = {"input": f"{mark[0]}:{mark[1]}"}, self._state(), []
        for stage, inputs, outputs, parameters in GRAPH:
            now = self._print(stage, inputs, parameters, prints)
            prints |= dict.fromkeys(outputs, now)
            missing = [i for i in inputs if i != "input" and not exists(self.spark, self.at(i))]
            if missing:
                self.log.error("%s: %s missing", stage, ", ".join(missing))
                raise FileNotFoundError(f"{stage} needs {', '.join(missing)}")
            if state.get(stage) == now and all(exists(self.spark, self.at(o)) for o in outputs):
                self.log.debug("%s: nothing has changed", stage)
                continue
            self.log.debug("%s: begins", stage)
            try:
                getattr(self, stage)(*([comments] if "input" in inputs else []))
            except Exception as error:
                self.log.error("%s: %s", stage, error)
                raise
            ran.append(stage)
            state[stage] = now
            self.spark.createDataFrame(sorted(state.items()), "stage string, print string").coalesce(1).write.mode("overwrite").json(self.at("state"))
        return ran
