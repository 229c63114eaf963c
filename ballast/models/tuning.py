"""Training with default parameters, exhaustive search, and scoring."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Model, PipelineModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ballast.models.classifiers import build_estimator, check_pair, parameter_grid
from ballast.models.estimator import RebalancedClassifier, training_table
from ballast.operators.columns import split_xy
from ballast.operators.metrics import metrics_per_seed
from ballast.operators.sampling import COST_GRID, NEIGHBORS
from ballast.operators.splitting import CV_FOLDS, stratified_kfold
from ballast.vocabulary import METRICS


class ConfusionEvaluator(Evaluator):
    """Scores predictions by one of the confusion-matrix metrics."""

    def __init__(self, metric: str = "balanced_accuracy", target: str = "target"):
        super().__init__()
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}")
        self.metric, self.target = metric, target

    def _evaluate(self, dataset: DataFrame) -> float:
        scored = dataset.select(F.col(self.target).alias("target"), "prediction")
        return metrics_per_seed(scored, keys=[]).first()[self.metric]

    def isLargerBetter(self) -> bool:
        return True


@dataclass
class TrainedModel:
    """A fitted pipeline with the parameters and seed that made it."""

    model: PipelineModel
    params: dict
    seed: int
    scores: list[tuple[dict, float]] = field(default_factory=list)
    counted: list[dict] = field(default_factory=list)  # rows and positives each candidate was scored on
    fits: int = 1


def train_default(
    train: DataFrame, model_type: str, technique: str, seed: int, columns: Sequence[str] | None = None, k: int = NEIGHBORS
) -> TrainedModel:
    """Fit once with default parameters."""
    check_pair(model_type, technique)
    columns = list(columns or feature_columns(train))
    estimator = build_estimator(model_type, technique, columns, seed, k)
    return TrainedModel(estimator.fit(train), readable(chosen_params(estimator)), seed)


def grid_search(
    train: DataFrame,
    model_type: str,
    technique: str,
    seed: int,
    columns: Sequence[str] | None = None,
    grid: list[dict] | None = None,
    metric: str = "balanced_accuracy",
    cv_folds: int = CV_FOLDS,
    parallelism: int = 4,
    cost_grid: Sequence = COST_GRID,
    k: int = NEIGHBORS,
) -> TrainedModel:
    """Exhaustive search by stratified cross-validation, then a fit of the best on all rows.

    Imputation, scaling and rebalancing are learned again on the training part of
    every fold, once per fold and not once per candidate. Candidates that differ only in their
    bound of iterations are one fit where the shorter one ended before its bound, as the longer
    one would then stop at the same place; ``fits`` counts what was fitted. All models of a fold
    score its held-out part together. Equal scores go to the earlier candidate.
    """
    check_pair(model_type, technique)
    columns = list(columns or feature_columns(train))
    estimator = build_estimator(model_type, technique, columns, seed, k)
    grid = parameter_grid(estimator, model_type, cost_grid) if grid is None else grid_for(estimator, grid)
    totals, counted, fits = [0.0] * len(grid), [Counter() for _ in grid], 1
    folded = stratified_kfold(train, seed, cv_folds).persist()
    try:
        folds = folded.agg(F.max("fold")).first()[0] + 1
        for fold in range(folds):
            stages, models, n = fit_candidates(estimator, folded.where(F.col("fold") != fold), grid, parallelism)
            fits += n
            for i, row in score_candidates(stages, models, folded.where(F.col("fold") == fold)).items():
                totals[i] += row[metric] / folds
                counted[i].update(rows=row.TP + row.TN + row.FP + row.FN, positives=row.TP + row.FN)
    finally:
        folded.unpersist()
    best = max(range(len(grid)), key=lambda i: (totals[i], -i))
    model = estimator.fit(train, grid[best])
    scores = [(readable(candidate), total) for candidate, total in zip(grid, totals)]
    return TrainedModel(model, scores[best][0], seed, scores, [dict(c) for c in counted], fits)


def fit_candidates(
    estimator: RebalancedClassifier, train: DataFrame, grid: list[dict], parallelism: int
) -> tuple[list, list[Model], int]:
    """The stages learned on ``train``, the classifier of every candidate, and the number of fits."""
    stages, rows = estimator.prepare(train)
    table = training_table(rows, len(estimator.columns))
    chains: dict[str, list[int]] = {}
    for i, candidate in enumerate(grid):
        rest = {p.name: v for p, v in candidate.items() if p.name != "maxIter"}
        chains.setdefault(repr(sorted(rest.items(), key=repr)), []).append(i)
    models: list = [None] * len(grid)

    def bound(i: int):
        return next((v for p, v in grid[i].items() if p.name == "maxIter"), 0)

    def fit_chain(chain: list[int]) -> int:
        last, fits = None, 0
        for i in sorted(chain, key=bound):
            if last is None or not ended_before(models[last], bound(last)):
                models[i] = estimator.copy(grid[i]).fit_rows([], table).stages[-1]
                fits += 1
            else:
                models[i] = models[last]
            last = i
        return fits

    try:
        with ThreadPool(max(1, min(parallelism, len(chains)))) as pool:
            fits = sum(pool.imap_unordered(fit_chain, chains.values()))
    finally:
        table.unpersist()
    return stages, models, fits


def ended_before(model: Model, iterations: int) -> bool:
    """Whether an iterative fit converged before its bound."""
    return bool(getattr(model, "hasSummary", False)) and 0 < model.summary.totalIterations < iterations


def score_candidates(stages: list, models: list[Model], held_out: DataFrame, at_once: int = 16) -> dict[int, Row]:
    """Confusion counts and metrics of each candidate; equal models are scored once, many in one job."""
    ready = PipelineModel(stages).transform(held_out).select("features", "target").persist()
    first = {id(m): i for i, m in reversed(list(enumerate(models)))}
    distinct = sorted(first.values())
    found: dict[int, Row] = {}
    try:
        for start in range(0, len(distinct), at_once):
            tables = [
                models[i].transform(ready).select(F.lit(i).alias("candidate"), "target", "prediction") for i in distinct[start : start + at_once]
            ]
            rows = metrics_per_seed(reduce(DataFrame.unionByName, tables), keys=["candidate"]).collect()
            found.update({row["candidate"]: row for row in rows})
    finally:
        ready.unpersist()
    return {i: found[first[id(m)]] for i, m in enumerate(models)}


def grid_for(estimator, grid: list[dict]) -> list[dict]:
    """A grid given by parameter names, bound to this estimator."""
    out = []
    for candidate in grid:
        bound = {}
        for name, value in candidate.items():
            owner = estimator if estimator.hasParam(name) else estimator.classifier
            bound[owner.getParam(name)] = value
        out.append(bound)
    return out


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in split_xy(df)[0] if c not in ("split", "fold")]


def chosen_params(estimator) -> dict:
    chosen = dict(estimator.classifier._paramMap)
    if estimator.getOrDefault(estimator.classWeight) is not None:
        chosen[estimator.classWeight] = estimator.getOrDefault(estimator.classWeight)
    return chosen


def readable(params: dict) -> dict:
    return {param.name: value for param, value in params.items()}


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``(target, prediction)`` as integers, with the ``row_id`` of rows that have one."""
    scored = model.transform(rows)
    kept = [c for c in ("row_id",) if c in rows.columns]
    return scored.select(*kept, F.col("target").cast("int").alias("target"), F.col("prediction").cast("int").alias("prediction"))


def predict_proba(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``(row_id, p0, p1)``; a model that has seen one class only gets a 0 for the other."""
    p = vector_to_array("probability")
    scored = model.transform(rows).select("row_id", p.alias("p"))
    return scored.select(
        "row_id", F.col("p")[0].alias("p0"), F.coalesce(F.get("p", F.lit(1)), F.lit(0.0)).alias("p1")
    )
