"""The table of stored predictions, partitioned by what identifies a training run."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.session import folders, path_exists
from ballast.vocabulary import DATASETS, MODEL_TYPES, TECHNIQUES

RUN_KEYS = ["execution_id", "dataset", "model_type", "technique", "seed"]
SCHEMA = (
    "target int, prediction int, execution_id string, dataset string, model_type string, technique string, seed int"
)
RUN_SCHEMA = "execution_id string, dataset string, model_type string, technique string, seed int"
STORED_PATH = re.compile("/".join(f"{key}=([^/]+)" for key in RUN_KEYS) + "$")
# Fixed value: how a run is named where its keys are part of a file path, or of that of a folder Spark wrote.
LEGACY_PATH = r"predictions/([^/]+)/([^/]+)/([^/]+)/([^/]+)/seed_(\d+)\.parquet(?:/[^/]+)?$"


class ExecutionNotFound(Exception):
    """No predictions are stored under an execution id."""


def parse_path(path) -> dict:
    """Columns for the five run keys out of a legacy file path; NULL where it does not match."""
    parts = {}
    for i, key in enumerate(RUN_KEYS, start=1):
        text = F.regexp_extract(path, LEGACY_PATH, i)
        parts[key] = F.when(path.rlike(LEGACY_PATH), text.cast("int") if key == "seed" else text)
    return parts


class PredictionStore:
    """Predictions under ``<root>/predictions``, one Hive partition per training run."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/predictions"

    def exists(self) -> bool:
        return path_exists(self.spark, self.path)

    def read(self) -> DataFrame:
        """All stored predictions; filters on run keys prune directories."""
        if not self.exists():
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def save(self, predictions: DataFrame, **run) -> None:
        """Write the predictions of one run, or of many that carry their own keys.

        Only the partitions being written are replaced, so a run that is repeated
        after a failure leaves no duplicates. Where rows carry their own keys, each
        run is first brought together so that it becomes few files; a run too large
        for one task is split again by adaptive execution.
        """
        if not run:
            predictions = predictions.hint("rebalance", *RUN_KEYS)
        keyed = predictions.withColumns({k: F.lit(v) for k, v in run.items()})
        keyed.select("target", "prediction", *RUN_KEYS).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(*RUN_KEYS).parquet(self.path)

    def runs(self) -> DataFrame:
        """Keys of the stored runs with known codes, from the listing of folders: one for each run, files are not listed."""
        found = [STORED_PATH.search(path) for path in folders(self.spark, "/".join([self.path, *[f"{key}=*" for key in RUN_KEYS]]))]
        keys = {tuple(map(unquote, match.groups())) for match in found if match}
        rows = [(*key[:-1], int(key[-1])) for key in sorted(keys)]
        return valid_runs(self.spark.createDataFrame(rows, RUN_SCHEMA))

    def latest(self, dataset: str) -> DataFrame:
        """Predictions of the newest execution with the dataset; reads its partitions only."""
        newest = latest_execution_id(self.runs(), [dataset]).first()[0]
        return predictions_for_execution(self.read(), dataset, newest)

    def for_execution(self, dataset: str, execution_id: str) -> DataFrame:
        """Predictions of one execution on one dataset.

        Raises if the execution has stored nothing at all; a dataset it lacks gives
        no rows.
        """
        if not path_exists(self.spark, f"{self.path}/execution_id={execution_id}"):
            raise ExecutionNotFound(f"execution {execution_id!r} not found")
        return predictions_for_execution(self.read(), dataset, execution_id)

    def completed(self, execution_id: str) -> DataFrame:
        return self.runs().where(F.col("execution_id") == execution_id).drop("execution_id")


def valid_runs(runs: DataFrame) -> DataFrame:
    """Runs whose dataset, model and technique are known codes."""
    return runs.where(
        F.col("dataset").isin(DATASETS)
        & F.col("model_type").isin(MODEL_TYPES)
        & F.col("technique").isin(TECHNIQUES)
        & F.col("seed").isNotNull()
    )


def read_legacy(spark: SparkSession, root: str) -> DataFrame:
    """Predictions stored with their keys in the file path only."""
    files = spark.read.option("recursiveFileLookup", True).schema("target int, prediction int").parquet(root)
    keyed = files.withColumns(parse_path(F.input_file_name()))
    return valid_runs(keyed)


def predictions_for_execution(predictions: DataFrame, dataset: str, execution_id: str) -> DataFrame:
    return predictions.where((F.col("execution_id") == execution_id) & (F.col("dataset") == dataset))


def latest_execution_id(predictions: DataFrame, datasets: Sequence[str] | None = None) -> DataFrame:
    """The newest execution with any of the given datasets; ids sort by time."""
    if datasets is not None:
        predictions = predictions.where(F.col("dataset").isin(list(datasets)))
    return predictions.agg(F.max("execution_id").alias("execution_id"))


def latest_predictions(predictions: DataFrame, dataset: str) -> DataFrame:
    """All predictions of the newest execution that has the dataset.

    The newest id is one row, so it is broadcast and prunes partitions at run time.
    """
    of_dataset = predictions.where(F.col("dataset") == dataset)
    return of_dataset.join(F.broadcast(latest_execution_id(of_dataset)), "execution_id", "left_semi")
