"""Confusion counts and the metrics built on them, for all keys in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.functions.numeric import ratio_or_zero
from ballast.vocabulary import METRICS

SEED_KEYS = ("dataset", "model_type", "technique", "seed")
PAIR_KEYS = ("dataset", "model_type", "technique")


def confusion_matrix(predictions: DataFrame, keys: Sequence[str] = SEED_KEYS) -> DataFrame:
    """TP, TN, FP and FN per key.

    The counts combine on the map side, so what is shuffled is one row per key
    and task, however unevenly the predictions fall on the keys.
    """
    target, prediction = F.col("target"), F.col("prediction")
    return predictions.groupBy(*keys).agg(
        F.count_if((target == 1) & (prediction == 1)).alias("TP"),
        F.count_if((target == 0) & (prediction == 0)).alias("TN"),
        F.count_if((target == 0) & (prediction == 1)).alias("FP"),
        F.count_if((target == 1) & (prediction == 0)).alias("FN"),
    )


def classification_metrics(confusion: DataFrame) -> DataFrame:
    """Add the six metrics to confusion counts; a 0/0 share is 0."""
    tp, tn, fp, fn = (F.col(c) for c in ("TP", "TN", "FP", "FN"))
    return confusion.withColumns(
        {
            "sensitivity": ratio_or_zero(tp, tp + fn),
            "specificity": ratio_or_zero(tn, tn + fp),
            "precision": ratio_or_zero(tp, tp + fp),
        }
    ).withColumns(
        {
            "f1_score": ratio_or_zero(
                2 * F.col("precision") * F.col("sensitivity"), F.col("precision") + F.col("sensitivity")
            ),
            "g_mean": F.sqrt(F.col("sensitivity") * F.col("specificity")),
            "balanced_accuracy": (F.col("sensitivity") + F.col("specificity")) / 2,
        }
    )


def metrics_per_seed(predictions: DataFrame, keys: Sequence[str] = SEED_KEYS) -> DataFrame:
    """One row of counts and metrics per training run."""
    return classification_metrics(confusion_matrix(predictions, keys))


def metrics_mean_std(per_seed: DataFrame, keys: Sequence[str] = PAIR_KEYS) -> DataFrame:
    """Mean and sample standard deviation over seeds; one seed has no deviation."""
    columns = [
        aggregate
        for metric in METRICS
        for aggregate in (
            F.avg(metric).alias(f"{metric}_mean"),
            F.stddev_samp(metric).alias(f"{metric}_std"),
        )
    ]
    return per_seed.groupBy(*keys).agg(*columns)


def g_mean_score(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Geometric mean of sensitivity and specificity, 0 where a class is absent."""
    return metrics_per_seed(predictions, keys).select(*keys, "g_mean")
