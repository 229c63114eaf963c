"""The four classifiers, their default parameters and their tuning grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.tuning import ParamGridBuilder

from ballast.models.estimator import RebalancedClassifier
from ballast.models.perceptron import EarlyStoppedPerceptron
from ballast.models.trees import BoostedTrees, Forest
from ballast.operators.sampling import COST_GRID, NEIGHBORS
from ballast.vocabulary import COST_SENSITIVE, MODEL_TYPES, TECHNIQUES

# Share of the L1 penalty in the elastic net; depth that stands for "no limit".
ELASTIC_NET_SHARE = 0.15
DEEPEST_TREE = 30


def check_pair(model_type: str, technique: str) -> None:
    """Raise for unknown codes and for cost weights on anything but the linear model."""
    if model_type not in MODEL_TYPES:
        raise ValueError(f"unknown model type {model_type!r}")
    if technique not in TECHNIQUES:
        raise ValueError(f"unknown technique {technique!r}")
    if technique in COST_SENSITIVE and model_type != "svm":
        raise ValueError(f"{technique} is a technique of the svm model only")


def stops_early(model_type: str, technique: str) -> bool:
    """Whether training watches a hold-out: the perceptron's does, unless under-sampling leaves too few rows."""
    return model_type == "mlp" and technique != "random_under_sampling"


def build_classifier(
    model_type: str, n_features: int, seed: int, weighted: bool = False, early_stop: bool = True
) -> Estimator:
    """A classifier with its default parameters.

    ``svm`` is a linear model with logistic loss. The boosted trees have no leaf
    penalties, and the perceptron no choice of activation or penalty.
    """
    if model_type == "svm":
        linear = LogisticRegression(
            regParam=1e-4, elasticNetParam=0.0, maxIter=1000, tol=1e-3, standardization=False
        )
        return linear.setWeightCol("weight") if weighted else linear
    if model_type == "random_forest":
        return Forest(numTrees=100, maxDepth=DEEPEST_TREE, minInstancesPerNode=1, seed=seed)
    if model_type == "xgboost":
        return BoostedTrees(maxIter=100, stepSize=0.1, maxDepth=6, subsamplingRate=1.0, seed=seed)
    if model_type == "mlp":
        return EarlyStoppedPerceptron([n_features, 100, 2], 200, seed, early_stop)
    raise ValueError(f"unknown model type {model_type!r}")


def build_estimator(
    model_type: str, technique: str, columns: Sequence[str], seed: int, k: int = NEIGHBORS
) -> RebalancedClassifier:
    """Classifier and rebalancing together, with default parameters.

    A cost-sensitive fit uses the first weight rule of the cost grid that is one.
    """
    check_pair(model_type, technique)
    weighted = technique in COST_SENSITIVE
    classifier = build_classifier(model_type, len(columns), seed, weighted, stops_early(model_type, technique))
    estimator = RebalancedClassifier(classifier, columns, technique, seed, k)
    if weighted:
        estimator._set(classWeight=next((rule for rule in COST_GRID if rule is not None), "balanced"))
    return estimator


def parameter_grid(estimator: RebalancedClassifier, model_type: str, cost_grid: Sequence = COST_GRID) -> list[dict]:
    """All candidates of the exhaustive search over what Spark's estimators can vary."""
    model, grid = estimator.classifier, ParamGridBuilder()
    if model_type == "svm":
        grid.addGrid(model.regParam, [1e-4, 1e-3, 1e-2])
        grid.addGrid(model.elasticNetParam, [0.0, ELASTIC_NET_SHARE])
        grid.addGrid(model.maxIter, [1000, 2000])
        if estimator.technique in COST_SENSITIVE:
            grid.addGrid(estimator.classWeight, list(cost_grid))
    elif model_type == "random_forest":
        grid.addGrid(model.numTrees, [100, 200])
        grid.addGrid(model.maxDepth, [5, 10, 20])
        grid.addGrid(model.minInstancesPerNode, [1, 5])
    elif model_type == "xgboost":
        grid.addGrid(model.maxIter, [100, 200])
        grid.addGrid(model.stepSize, [0.01, 0.1])
        grid.addGrid(model.maxDepth, [3, 6, 10])
        grid.addGrid(model.subsamplingRate, [0.8, 1.0])
        grid.addGrid(model.featureSubsetStrategy, ["0.8", "all"])
    elif model_type == "mlp":
        inputs = len(estimator.columns)
        grid.addGrid(model.layers, [[inputs, 50, 2], [inputs, 100, 2], [inputs, 50, 50, 2]])
    return grid.build()
