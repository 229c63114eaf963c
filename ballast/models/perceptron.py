"""A perceptron trained in rounds, until rows held out no longer gain from more of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.param import Param, Params
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.functions.hashing import hash_order
from ballast.operators.splitting import count_classes, first_ranks, round_half_up

HOLD_OUT_SHARE = 0.1
ROUND = 20  # iterations between two looks at the hold-out
PATIENCE = 3  # rounds without a gain
GAIN = 1e-4  # of accuracy


@dataclass(frozen=True)
class Stopping:
    """How a fit came to its end."""

    active: bool
    held_out: int = 0
    rounds: int = 1
    iterations: int = 0


class EarlyStoppedPerceptron(Estimator):
    """A multilayer perceptron; with ``earlyStopping`` a tenth of each class, by hash of ``row_id``, is held out.

    Each round goes on from the weights of the last one. The weights of the best round are kept. The fitted
    model is Spark's own, with a ``stopping`` that tells what happened.
    """

    layers = Param(Params._dummy(), "layers", "sizes of all layers, the input and the classes included")
    maxIter = Param(Params._dummy(), "maxIter", "iterations over all rounds")
    seed = Param(Params._dummy(), "seed", "of the first weights and of the hold-out")
    earlyStopping = Param(Params._dummy(), "earlyStopping", "whether rows are held out to stop early")

    def __init__(self, layers: Sequence[int], max_iter: int, seed: int, early_stopping: bool):
        super().__init__()
        self._set(layers=list(layers), maxIter=max_iter, seed=seed, earlyStopping=early_stopping)

    def _network(self, iterations: int) -> MultilayerPerceptronClassifier:
        return MultilayerPerceptronClassifier(
            layers=self.getOrDefault(self.layers), maxIter=iterations, seed=self.getOrDefault(self.seed)
        )

    def _fit(self, dataset: DataFrame) -> MultilayerPerceptronClassificationModel:
        limit = self.getOrDefault(self.maxIter)
        if not self.getOrDefault(self.earlyStopping):
            return told(self._network(limit).fit(dataset), Stopping(False, iterations=limit))
        quotas = {g: round_half_up(HOLD_OUT_SHARE * n) for g, n in count_classes(dataset).items()}
        order = hash_order(f"{self.getOrDefault(self.seed)}:hold-out", F.col("row_id"))
        marked = dataset.withColumn("_held", first_ranks(dataset, quotas, order)).persist()
        try:
            return self._rounds(marked.where(~F.col("_held")), marked.where("_held"), sum(quotas.values()), limit)
        finally:
            marked.unpersist()

    def _rounds(self, train: DataFrame, held: DataFrame, size: int, limit: int) -> MultilayerPerceptronClassificationModel:
        best, best_score, waited, done, rounds, weights = None, -1.0, 0, 0, 0, None
        while done < limit and waited < PATIENCE:
            network = self._network(min(ROUND, limit - done))
            if weights is not None:
                network.setInitialWeights(weights)
            model = network.fit(train)
            weights, rounds, done = model.weights, rounds + 1, done + min(ROUND, limit - done)
            score = model.transform(held).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] if size else 0.0
            if score > best_score + GAIN:
                best, best_score, waited = model, score, 0
            else:
                waited += 1
        return told(best, Stopping(True, size, rounds, done))


def told(model, stopping: Stopping):
    model.stopping = stopping
    return model
