"""End-user analyses.

Each takes the metrics tables of :mod:`ballast.operators.metrics`. These hold one
row per training run or per (dataset, model, technique), not per prediction, so
everything here works on a handful of rows per dataset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.functions.text import concat_label, format_mean_std, format_plus_minus
from ballast.operators.columns import map_labels
from ballast.operators.metrics import metrics_mean_std, metrics_per_seed
from ballast.session import materialize
from ballast.vocabulary import (
    COST_SENSITIVE,
    METRIC_LABELS,
    METRICS,
    REAL_DATASETS,
    RESAMPLING,
    ordinal,
)


def top_one(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(window)).where("_place = 1").drop("_place")


def sort_summary(metrics: DataFrame) -> DataFrame:
    """Best balanced accuracy first; ties by model and technique name."""
    return metrics.orderBy(F.desc("balanced_accuracy_mean"), "dataset", "model_type", "technique")


def sort_stability(per_seed: DataFrame) -> DataFrame:
    """Rows by model, technique (both in their defined order) and seed."""
    return per_seed.orderBy(
        "dataset", ordinal("model_type", "model_type"), ordinal("technique", "technique"), "seed"
    )


def summary_table(metrics: DataFrame, technique: str | None = None) -> DataFrame:
    """Ranked rows with every metric as ``mean (std)`` text."""
    if technique is not None:
        metrics = metrics.where(F.col("technique") == technique)
    cells = [format_mean_std(F.col(f"{m}_mean"), F.col(f"{m}_std")).alias(m) for m in METRICS]
    ranking = Window.partitionBy("dataset").orderBy(
        F.desc("balanced_accuracy_mean"), "model_type", "technique"
    )
    return metrics.select(
        "dataset", F.row_number().over(ranking).alias("position"), "model_type", "technique", *cells
    )


def tradeoff_points(metrics: DataFrame) -> DataFrame:
    """Mean precision against mean sensitivity, labelled for a chart."""
    return with_labels(metrics).select(
        "dataset", "technique_label", "model_type_label", "precision_mean", "sensitivity_mean"
    )


def with_labels(df: DataFrame) -> DataFrame:
    """Display names beside the technique and model codes."""
    return map_labels(map_labels(df, "technique"), "model_type")


def stability_boxplot(per_seed: DataFrame, metric: str = "balanced_accuracy") -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and outlier count of one metric over seeds."""
    keys = ["dataset", "technique", "model_type"]
    boxes = per_seed.groupBy(*keys).agg(
        F.count(metric).alias("n"), F.percentile(metric, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q")
    )
    boxes = boxes.select(
        *keys,
        "n",
        F.col("q")[0].alias("q1"),
        F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q3"),
    ).withColumns(
        {
            "low_fence": F.expr("q1 - 1.5 * (q3 - q1)"),
            "high_fence": F.expr("q3 + 1.5 * (q3 - q1)"),
        }
    )
    inside = F.col(metric).between(F.col("low_fence"), F.col("high_fence"))
    return (
        per_seed.select(*keys, metric)
        .join(boxes, keys)
        .groupBy(*keys, "n", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(metric))).alias("whisker_low"),
            F.max(F.when(inside, F.col(metric))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def best_technique(metrics: DataFrame) -> DataFrame:
    """The treatment with the highest mean G-mean for each dataset and model."""
    treated = metrics.where(F.col("technique") != "baseline")
    best = top_one(treated, ["dataset", "model_type"], F.desc("g_mean_mean"), F.asc("technique"))
    return best.select(
        "dataset",
        "model_type",
        F.col("technique").alias("best_technique"),
        F.col("g_mean_mean").alias("best_g_mean"),
        F.col("balanced_accuracy_mean").alias("best_balanced_acc"),
    )


def baseline_vs_best(metrics: DataFrame) -> DataFrame:
    """Each model's untreated row beside its best treatment, if it has one.

    Both sides come out of one aggregation per model, so the predictions beneath are
    not scanned once for each side.
    """
    untreated = F.col("technique") == "baseline"
    row = F.struct(
        F.col("technique").alias("best_technique"),
        F.col("g_mean_mean").alias("best_g_mean"),
        F.col("balanced_accuracy_mean").alias("best_balanced_acc"),
    )
    place = F.when(~untreated, F.struct(-F.col("g_mean_mean"), "technique"))
    sides = metrics.groupBy("dataset", "model_type").agg(
        F.count_if(untreated).alias("_untreated"),
        F.max(F.when(untreated, F.col("g_mean_mean"))).alias("baseline_g_mean"),
        F.max(F.when(untreated, F.col("balanced_accuracy_mean"))).alias("baseline_balanced_acc"),
        F.min_by(row, place).alias("best"),
    )
    return sides.where("_untreated > 0").select(
        "dataset", "model_type", "baseline_g_mean", "baseline_balanced_acc", "best.*"
    )


def imbalance_impact(metrics: DataFrame) -> DataFrame:
    """Gain of the best treatment over no treatment, largest first."""
    return (
        baseline_vs_best(metrics)
        .withColumns(
            {
                "g_mean_improvement": F.col("best_g_mean") - F.col("baseline_g_mean"),
                "balanced_acc_improvement": F.col("best_balanced_acc") - F.col("baseline_balanced_acc"),
            }
        )
        .orderBy(F.desc("g_mean_improvement"), "dataset", "model_type")
    )


def imbalance_points(metrics: DataFrame, ratios: DataFrame, metric: str = "balanced_accuracy") -> DataFrame:
    """Mean of a metric against the imbalance ratio of its dataset.

    ``ratios`` is ``(dataset, imbalance_ratio)``; a dataset it lacks counts as 1.
    """
    points = with_labels(metrics).join(ratios.select("dataset", "imbalance_ratio"), "dataset", "left")
    return points.select(
        "dataset",
        "technique_label",
        "model_type_label",
        F.coalesce("imbalance_ratio", F.lit(1.0)).alias("imbalance_ratio"),
        F.col(f"{metric}_mean"),
    )


def best_per_approach(per_seed: DataFrame) -> DataFrame:
    """The best technique of each approach (cost weights, resampling) per model."""
    averaged = per_seed.groupBy("dataset", "model_type", "technique").agg(
        F.avg("g_mean").alias("g_mean"),
        F.avg("f1_score").alias("f1_score"),
        F.avg("balanced_accuracy").alias("balanced_accuracy"),
    )
    approach = F.when(F.col("technique").isin(COST_SENSITIVE), "Cost-Sensitive").otherwise("Resampling")
    compared = averaged.where(F.col("technique").isin(COST_SENSITIVE + RESAMPLING)).withColumn(
        "approach", approach
    )
    return top_one(compared, ["dataset", "model_type", "approach"], F.desc("g_mean"), F.asc("technique"))


def cs_vs_resampling(per_seed: DataFrame) -> DataFrame:
    """:func:`best_per_approach` in reading order."""
    return best_per_approach(per_seed).orderBy("dataset", ordinal("model_type", "model_type"), "approach")


def cs_vs_resampling_bars(per_seed: DataFrame) -> DataFrame:
    """Mean balanced accuracy with its deviation, untreated rows included."""
    shown = per_seed.where(F.col("technique").isin(["baseline", *COST_SENSITIVE, *RESAMPLING]))
    bars = shown.groupBy("dataset", "technique", "model_type").agg(
        F.avg("balanced_accuracy").alias("bar"), F.stddev_samp("balanced_accuracy").alias("sd")
    )
    return with_labels(bars).select(
        "dataset",
        "technique_label",
        "model_type_label",
        "bar",
        (F.col("bar") - F.coalesce("sd", F.lit(0.0))).alias("bar_low"),
        (F.col("bar") + F.coalesce("sd", F.lit(0.0))).alias("bar_high"),
    )


def heatmap_matrix(metrics: DataFrame) -> DataFrame:
    """One row per technique and model, one column per metric mean, code order."""
    columns = [F.col(f"{m}_mean").alias(m) for m in sorted(METRICS, key=lambda m: METRIC_LABELS[m])]
    return metrics.select(
        "dataset", concat_label(F.col("technique"), F.col("model_type")).alias("technique_model"), *columns
    ).orderBy("dataset", "technique_model")


def metrics_heatmap(metrics: DataFrame) -> DataFrame:
    """The heat map with display names."""
    columns = [F.col(f"{m}_mean").alias(m) for m in sorted(METRICS, key=lambda m: METRIC_LABELS[m])]
    labelled = with_labels(metrics)
    return labelled.select(
        "dataset",
        concat_label(F.col("technique_label"), F.col("model_type_label")).alias("technique_model"),
        *columns,
    ).orderBy("dataset", "technique_model")


def pivot_dataset(metrics: DataFrame, technique: str | None = None) -> DataFrame:
    """Models by datasets, each cell ``mean ± std`` of balanced accuracy."""
    if technique is not None:
        metrics = metrics.where(F.col("technique") == technique)
    cell = format_plus_minus(F.col("balanced_accuracy_mean"), F.col("balanced_accuracy_std"))
    return (
        metrics.where(F.col("dataset").isin(REAL_DATASETS))
        .groupBy("technique", "model_type")
        .pivot("dataset", REAL_DATASETS)
        .agg(F.first(cell))
    )


def cross_dataset(metrics: DataFrame, technique: str | None = None) -> DataFrame:
    """The dataset pivot with model names, one block of rows per technique."""
    table = map_labels(pivot_dataset(metrics, technique), "model_type", strict=True)
    return table.select(
        "technique", F.col("model_type_label").alias("model"), *REAL_DATASETS
    ).orderBy("technique", "model")


def imbalance_ratios(per_seed: DataFrame) -> DataFrame:
    """Majority over minority of each dataset, from the confusion counts of its runs."""
    classes = per_seed.groupBy("dataset").agg(
        F.sum(F.col("TP") + F.col("FN")).alias("positive"), F.sum(F.col("TN") + F.col("FP")).alias("negative")
    )
    larger, smaller = F.greatest("positive", "negative"), F.least("positive", "negative")
    return classes.select("dataset", (larger / F.when(smaller > 0, smaller).otherwise(larger)).alias("imbalance_ratio"))


def of_execution(predictions: DataFrame, execution_id: str | None = None) -> DataFrame:
    """Predictions of one execution; without an id, of the newest execution of each dataset.

    Seeds repeat between executions, so metrics of several must not be pooled.
    """
    if execution_id is not None:
        return predictions.where(F.col("execution_id") == execution_id)
    newest = predictions.groupBy("dataset").agg(F.max("execution_id").alias("execution_id"))
    return predictions.join(newest, ["dataset", "execution_id"], "left_semi")


def run_all(predictions: DataFrame, dataset: str | None = None, execution_id: str | None = None) -> dict[str, DataFrame]:
    """Every analysis of one execution over one shared metrics table.

    Of all datasets or one; of the named execution, else of the newest of each dataset.
    What is stored has a row per training run.
    """
    if dataset is not None:
        predictions = predictions.where(F.col("dataset") == dataset)
    per_seed = materialize(metrics_per_seed(of_execution(predictions, execution_id)))
    metrics = metrics_mean_std(per_seed)
    return {
        "summary_table": summary_table(metrics),
        "tradeoff_points": tradeoff_points(metrics),
        "stability_boxplot": stability_boxplot(per_seed),
        "imbalance_impact": imbalance_impact(metrics),
        "imbalance_points": imbalance_points(metrics, imbalance_ratios(per_seed)),
        "cs_vs_resampling": cs_vs_resampling(per_seed),
        "cs_vs_resampling_bars": cs_vs_resampling_bars(per_seed),
        "metrics_heatmap": metrics_heatmap(metrics),
        "cross_dataset": cross_dataset(metrics),
    }
