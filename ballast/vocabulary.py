"""Names, codes and display labels of the domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Codes that appear in stored tables, in their defined order.
DATASETS = ["corporate_credit_rating", "lending_club", "taiwan_credit", "test"]
REAL_DATASETS = ["lending_club", "taiwan_credit", "corporate_credit_rating"]
MODEL_TYPES = ["random_forest", "svm", "xgboost", "mlp"]
TECHNIQUES = ["baseline", "smote", "random_under_sampling", "smote_tomek", "cs_svm"]
METRICS = ["balanced_accuracy", "g_mean", "f1_score", "precision", "sensitivity", "specificity"]
COST_SENSITIVE = ["cs_svm"]
RESAMPLING = ["smote", "random_under_sampling", "smote_tomek"]

# Display labels.
DATASET_LABELS = {
    "corporate_credit_rating": "Corporate Credit Rating",
    "lending_club": "Lending Club",
    "taiwan_credit": "Taiwan Credit",
}
METRIC_LABELS = {
    "balanced_accuracy": "Balanced Accuracy",
    "g_mean": "G-Mean",
    "f1_score": "F1 Score",
    "precision": "Precision",
    "sensitivity": "Sensitivity",
    "specificity": "Specificity",
}
MODEL_LABELS = {
    "random_forest": "Random Forest",
    "svm": "SVM",
    "xgboost": "XGBoost",
    "mlp": "MLP",
}
TECHNIQUE_LABELS = {
    "baseline": "Baseline",
    "smote": "SMOTE",
    "random_under_sampling": "RUS",
    "smote_tomek": "SMOTE-Tomek",
    "cs_svm": "CS-SVM",
    "meta_cost": "Meta Cost",
}

LABELS = {
    "dataset": DATASET_LABELS,
    "metric": METRIC_LABELS,
    "model_type": MODEL_LABELS,
    "technique": TECHNIQUE_LABELS,
}
ORDERED = {
    "dataset": DATASETS,
    "metric": METRICS,
    "model_type": MODEL_TYPES,
    "technique": TECHNIQUES,
}


def ordinal(column: str | Column, kind: str) -> Column:
    """Position of a code in its defined order; unknown codes sort last."""
    codes = ORDERED[kind]
    position = F.array_position(F.array(*map(F.lit, codes)), F.col(column) if isinstance(column, str) else column)
    return F.when(position > 0, position).otherwise(len(codes) + 1).cast("int")


def label_table(spark: SparkSession, kind: str) -> DataFrame:
    """The label dimension of one kind of code: ``(code, label, ord)``."""
    ranks = {code: i + 1 for i, code in enumerate(ORDERED[kind])}
    rows = ", ".join(
        f"('{code}', '{label}', {ranks.get(code, len(ranks) + 1)})" for code, label in LABELS[kind].items()
    )
    return spark.sql(f"select * from values {rows} as labels(code, label, ord)")


def is_valid_pair(model_type: str | Column, technique: str | Column) -> Column:
    """The cost-sensitive technique exists for the linear model only."""
    model = F.col(model_type) if isinstance(model_type, str) else model_type
    tech = F.col(technique) if isinstance(technique, str) else technique
    return ~tech.isin(COST_SENSITIVE) | (model == "svm")
