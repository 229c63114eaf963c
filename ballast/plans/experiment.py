"""The experiment: every dataset, model, technique and seed, resumable at any point."""

from __future__ import annotations

import threading
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.models.classifiers import build_estimator, check_pair
from ballast.models.estimator import training_table
from ballast.models.tuning import TrainedModel, feature_columns, grid_search, predict, train_default
from ballast.operators.splitting import CV_FOLDS, stratified_split
from ballast.session import materialize
from ballast.sources.models import ModelStore, new_id
from ballast.sources.predictions import PredictionStore, latest_execution_id, valid_runs
from ballast.vocabulary import MODEL_TYPES, TECHNIQUES, is_valid_pair

COMBINATION = ["dataset", "model_type", "technique", "seed"]


def combination_grid(
    spark: SparkSession, datasets: Sequence[str], num_seeds: int, excluded_models: Sequence[str] = ()
) -> DataFrame:
    """Every valid combination; seeds count from 1."""
    models = [m for m in MODEL_TYPES if m not in excluded_models]
    grid = spark.range(1)
    for name, values in (("dataset", datasets), ("model_type", models), ("technique", TECHNIQUES)):
        grid = grid.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    grid = grid.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(num_seeds))))
    return grid.where(is_valid_pair("model_type", "technique")).select(*COMBINATION)


def completed_combinations(predictions: DataFrame, execution_id: str) -> DataFrame:
    """Combinations an execution has stored predictions for."""
    runs = predictions.where(F.col("execution_id") == execution_id).select(*COMBINATION).distinct()
    return valid_runs(runs)


def pending_combinations(grid: DataFrame, completed: DataFrame) -> DataFrame:
    return grid.join(completed, COMBINATION, "left_anti")


def execution_complete(grid: DataFrame, completed: DataFrame) -> bool:
    """Whether nothing of the grid is left to do."""
    return pending_combinations(grid, completed).isEmpty()


def executions_complete(grid: DataFrame, predictions: DataFrame) -> DataFrame:
    """``(execution_id, complete)`` for every stored execution, in one pass."""
    runs = predictions.select("execution_id", *COMBINATION).distinct()
    expected = grid.agg(F.count("*").alias("n")).scalar()
    done = runs.join(grid.withColumn("expected", F.lit(True)), COMBINATION, "left")
    return done.groupBy("execution_id").agg((F.count_if("expected")).alias("n")).select(
        "execution_id", (F.col("n") == expected).alias("complete")
    )


@dataclass(frozen=True)
class Resolution:
    """Which execution to work on, and why."""

    execution_id: str
    status: str
    completed: int = 0

    @property
    def finished(self) -> bool:
        return self.status == "already_complete"


def resume_execution(
    predictions: DataFrame,  # or only their run keys
    datasets: Sequence[str],
    num_seeds: int,
    excluded_models: Sequence[str] = (),
    execution_id: str | None = None,
    skip_resume: bool = False,
) -> Resolution:
    """Pick the execution: a named one, a new one, or the newest unfinished one."""
    if execution_id is not None and skip_resume:
        raise ValueError("an execution id cannot be combined with skip_resume")
    if execution_id is not None:
        done = completed_combinations(predictions, execution_id).count()
        return Resolution(execution_id, "explicit_id_continued" if done else "explicit_id_new", done)
    if skip_resume:
        return Resolution(new_id(), "skip_resume")
    newest = latest_execution_id(predictions, datasets).first()[0]
    if newest is None:
        return Resolution(new_id(), "new_execution")
    grid = combination_grid(predictions.sparkSession, datasets, num_seeds, excluded_models)
    completed = completed_combinations(predictions, newest)
    if execution_complete(grid, completed):
        return Resolution(newest, "already_complete")
    return Resolution(newest, "resumed_incomplete", completed.count())


Trainer = Callable[[DataFrame, str, str, int, Sequence[str]], TrainedModel]


def run_experiment(
    spark: SparkSession,
    data: Mapping[str, DataFrame],
    store: PredictionStore,
    num_seeds: int,
    excluded_models: Sequence[str] = (),
    execution_id: str | None = None,
    skip_resume: bool = False,
    trainer: Trainer | None = None,
    parallelism: int = 2,
    cv_folds: int = CV_FOLDS,
) -> Resolution:
    """Train what is pending and store its test predictions, run by run.

    Runs of one dataset and seed share their split and preparation, and the models of one
    technique share its rebalanced table; a ``trainer`` of one's own shares the split only. What is
    shared is freed after the last run that needs it. The driver only submits jobs, of
    ``parallelism`` runs at a time, so the cluster stays busy between the stages of one fit. A run
    counts as done when its partition is written, so an interrupted experiment continues where it
    stopped; after a failure no further run is started.
    """
    chosen = resume_execution(store.runs(), list(data), num_seeds, excluded_models, execution_id, skip_resume)
    if chosen.finished:
        return chosen
    grid = combination_grid(spark, list(data), num_seeds, excluded_models)
    pending = pending_combinations(grid, store.completed(chosen.execution_id))
    rows = pending.orderBy("dataset", "seed", "technique", "model_type").collect()
    uses = Counter(key for row in rows for key in ((row.dataset, row.seed), (row.dataset, row.seed, row.technique)))
    stop = threading.Event()

    def split_of(dataset: str, seed: int) -> tuple[DataFrame, Callable]:
        split = stratified_split(data[dataset], seed, cv_folds=cv_folds).persist()
        return split, split.unpersist

    def features_of(split: Lease, dataset: str, seed: int) -> tuple[tuple[DataFrame, DataFrame], Callable]:
        train, test = parts(split.value())
        stages, ready = build_estimator("svm", TECHNIQUES[0], feature_columns(data[dataset]), seed).prepare_features(train)
        # Written once: every run plans on these two, and a plan on held tables repeats all that made them.
        held = materialize(ready).persist(), materialize(PipelineModel(stages).transform(test).select("features", "target")).persist()
        return held, lambda: [table.unpersist() for table in held]

    def table_of(features: Lease, dataset: str, seed: int, technique: str) -> tuple[DataFrame, Callable]:
        columns = feature_columns(data[dataset])
        table = training_table(build_estimator("svm", technique, columns, seed).rebalance(features.value()[0]), len(columns))
        return table, table.unpersist

    splits = {key: Lease(partial(split_of, *key), n) for key, n in uses.items() if len(key) == 2}
    features = {key: Lease(partial(features_of, splits[key], *key), splits[key].uses) for key in splits}
    tables = {key: Lease(partial(table_of, features[key[:2]], *key), n) for key, n in uses.items() if len(key) == 3}

    def scored(row) -> DataFrame:
        columns = feature_columns(data[row.dataset])
        if trainer is not None:
            train, test = parts(splits[row.dataset, row.seed].value())
            return predict(trainer(train, row.model_type, row.technique, row.seed, columns).model, test)
        check_pair(row.model_type, row.technique)
        estimator = build_estimator(row.model_type, row.technique, columns, row.seed)
        model = estimator.fit_rows([], tables[row.dataset, row.seed, row.technique].value())
        return predict(model, features[row.dataset, row.seed].value()[1])

    def run(row) -> None:
        if stop.is_set():
            return
        try:
            store.save(scored(row), execution_id=chosen.execution_id, **{k: row[k] for k in COMBINATION})
        except BaseException:
            stop.set()
            raise
        finally:
            for lease in (tables[row.dataset, row.seed, row.technique], features[row.dataset, row.seed], splits[row.dataset, row.seed]):
                lease.release()

    try:
        with ThreadPool(max(1, min(parallelism, len(rows) or 1))) as pool:
            for _ in pool.imap_unordered(run, rows):
                pass
    finally:
        for lease in (*tables.values(), *features.values(), *splits.values()):
            lease.free()
    return chosen


def parts(split: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split.where("split = 'train'").drop("split"), split.where("split = 'test'").drop("split")


class Lease:
    """Something made at its first use and freed after the last of ``uses``; threads may share it."""

    def __init__(self, make: Callable[[], tuple[object, Callable]], uses: int):
        self.make, self.uses, self.held, self.lock = make, uses, None, threading.Lock()

    def value(self):
        with self.lock:
            if self.held is None:
                self.held = self.make()
            return self.held[0]

    def release(self) -> None:
        with self.lock:
            self.uses -= 1
        if self.uses == 0:
            self.free()

    def free(self) -> None:
        with self.lock:
            if self.held is not None:
                self.held[1]()
                self.held = None


def tuned(grid: list[dict] | None = None, **options) -> Trainer:
    """A trainer that searches a grid, for :func:`run_experiment`."""

    def train(rows: DataFrame, model_type: str, technique: str, seed: int, columns: Sequence[str]) -> TrainedModel:
        return grid_search(rows, model_type, technique, seed, columns, grid, **options)

    return train


def train_and_store(
    data: DataFrame,
    models: ModelStore,
    dataset: str,
    model_type: str,
    technique: str,
    seed: int,
    trainer: Trainer = train_default,
    cv_folds: int = CV_FOLDS,
) -> str:
    """Train on the training part of the split by ``seed`` and store the model; returns its id."""
    train, _ = parts(stratified_split(data, seed, cv_folds=cv_folds))
    trained = trainer(train, model_type, technique, seed, feature_columns(data))
    return models.save(trained, dataset, model_type, technique)


def score_test_set(data: DataFrame, models: ModelStore, dataset: str, model_id: str | None = None) -> DataFrame:
    """Predictions of a stored model (by default the newest) on its own test part.

    The split uses the seed the model was trained with, so no training row is scored.
    """
    trained = models.load(dataset, model_id) if model_id is not None else models.latest(dataset)
    split = stratified_split(data, trained.seed)
    return predict(trained.model, split.where("split = 'test'"))
