"""An estimator that imputes, scales and rebalances before it fits a classifier.

Rebalancing happens in ``fit`` only. What comes out is a plain ``PipelineModel`` of
stored preparation, vector assembly and fitted classifier, so scoring never
resamples and the model is saved and loaded by Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ballast.operators.prepare import fit_preparation
from ballast.operators.sampling import (
    NEIGHBORS,
    class_weights,
    random_under_sample,
    smote,
    smote_tomek,
)


TASK_BYTES = 4 << 20  # of a training table in one task
MAX_LEAVES: int | None = None  # of one tree of a forest; None: as many as its parameters give, whatever the rows


class RebalancedClassifier(Estimator):
    """Fits ``classifier`` on the prepared and rebalanced rows of a training table.

    The table holds ``row_id``, the feature columns and ``target``.
    """

    classWeight = Param(Params._dummy(), "classWeight", "weight rule of a cost-sensitive fit: None, 'balanced' or a map")

    def __init__(
        self, classifier: Estimator, columns: Sequence[str], technique: str, seed: int, k: int = NEIGHBORS
    ):
        super().__init__()
        self.classifier, self.columns, self.technique, self.seed, self.k = classifier, list(columns), technique, seed, k
        self._setDefault(classWeight=None)

    def copy(self, extra=None):
        that = super().copy(extra)
        that.classifier = self.classifier.copy(extra)
        return that

    def prepare(self, train: DataFrame) -> tuple[list, DataFrame]:
        """Learn the preparation on ``train`` and return its stages and the rebalanced rows."""
        stages, ready = self.prepare_features(train)
        return stages, self.rebalance(ready)

    def prepare_features(self, train: DataFrame) -> tuple[list, DataFrame]:
        """Learn the preparation, which no technique changes: its stages and ``(row_id, features, target)``."""
        preparation = fit_preparation(train, self.columns)
        stages = [
            SQLTransformer(statement=preparation.sql()),
            VectorAssembler(
                inputCols=[preparation.prepared_name(c) for c in self.columns], outputCol="features"
            ),
        ]
        return stages, PipelineModel(stages).transform(train).select("row_id", "features", "target")

    def rebalance(self, ready: DataFrame) -> DataFrame:
        if self.technique == "random_under_sampling":
            return random_under_sample(ready, self.seed)
        if self.technique in ("smote", "smote_tomek"):
            sampler = smote if self.technique == "smote" else smote_tomek
            points = ready.select("row_id", vector_to_array("features").alias("x"), "target")
            filled = sampler(points, self.seed, self.k)
            return filled.select("row_id", array_to_vector("x").alias("features"), "target")
        return ready

    def fit_rows(self, stages: list, rows: DataFrame) -> PipelineModel:
        """Fit the classifier on prepared and rebalanced rows, best those of :func:`training_table`."""
        return PipelineModel([*stages, bounded(self.classifier, rows).fit(self.labelled(rows))])

    def labelled(self, rows: DataFrame) -> DataFrame:
        """Prepared rows with the label and, in a cost-sensitive fit, the weight the classifier reads."""
        if self.technique == "cs_svm":
            rows = class_weights(rows, self.getOrDefault(self.classWeight))
        return rows.withColumn("label", F.col("target").cast("double"))

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        level = dataset.storageLevel  # a table the caller holds stays held: other fits may be reading it
        own = not (level.useMemory or level.useDisk)
        kept = dataset.persist(StorageLevel.MEMORY_AND_DISK) if own else dataset  # read by every pass of the preparation
        try:
            stages, rows = self.prepare(kept)
            rows = training_table(rows, len(self.columns))
        finally:
            if own:
                kept.unpersist()
        try:
            return self.fit_rows(stages, rows)
        finally:
            rows.unpersist()


def bounded(classifier: Estimator, rows: DataFrame) -> Estimator:
    """The classifier as it is, unless ``MAX_LEAVES`` is set: then a forest keeps at least one row in so many on
    each leaf, so that its trees, which the driver holds, do not grow with the table."""
    if MAX_LEAVES is None or not isinstance(classifier, RandomForestClassifier):
        return classifier
    least = -(-rows.count() // MAX_LEAVES)
    if least <= classifier.getMinInstancesPerNode():
        return classifier
    return classifier.copy({classifier.minInstancesPerNode: least})


def training_table(rows: DataFrame, width: int) -> DataFrame:
    """The rows persisted in partitions that follow from their number and ids alone.

    Iterative algorithms start a task per partition in every one of hundreds of rounds, so a partition
    holds ``TASK_BYTES``. What a row is drawn or binned with depends on its place; by hash and order of
    ``row_id`` the place is the same on every cluster, and so is the fitted model.
    """
    first = rows.persist(StorageLevel.MEMORY_AND_DISK)
    tasks = max(1, -(-first.count() * (width + 2) * 8 // TASK_BYTES))
    placed = first.repartition(tasks, "row_id").sortWithinPartitions("row_id").persist(StorageLevel.MEMORY_AND_DISK)
    placed.count()
    first.unpersist()
    return placed
