"""Class-wise splits by the order of a seeded hash of the row id.

A split is a filter on thresholds found beforehand, so the table itself is never
shuffled for it and the result does not depend on how it was partitioned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions.hashing import hash_order
from ballast.operators.columns import quoted
from ballast.operators.order_stats import hash_thresholds
from ballast.operators.profile import class_counts

TEST_SHARE = 0.30
CV_FOLDS = 5


def count_classes(df: DataFrame, target: str = "target") -> dict[object, int]:
    """Rows per class on the driver: one number for each class."""
    rows = class_counts(df, target).collect()
    if any(row[target] is None for row in rows):
        raise ValueError(f"{target} is missing in some rows")
    return {row[target]: row["n"] for row in rows}


def round_half_up(x: float) -> int:
    return math.floor(x + 0.5)


def first_ranks(
    df: DataFrame, quotas: dict[object, int], digest: Column, group: str = "target"
) -> Column:
    """Whether a row is among the first ``quotas[class]`` of its class in digest order."""
    thresholds = hash_thresholds(df, group, digest, {g: [q] for g, q in quotas.items() if q > 0})
    chosen = F.lit(False)
    for g, q in quotas.items():
        if q > 0:
            chosen = chosen | ((quoted(group) == F.lit(g)) & (digest <= thresholds[g][q]))
    return chosen


def stratified_split(
    df: DataFrame,
    seed: int,
    test_share: float = TEST_SHARE,
    cv_folds: int = CV_FOLDS,
    row_id: str = "row_id",
    target: str = "target",
) -> DataFrame:
    """Add ``split``: ``test`` for the given share of each class, else ``train``.

    Raises if a class has fewer than two rows, or if a class keeps fewer training
    rows than cross-validation has folds. Where a class is smaller than the number
    of folds the split ignores classes, as a stratified one would be meaningless.
    """
    counts = count_classes(df, target)
    if min(counts.values(), default=0) < 2:
        raise ValueError("each class needs at least 2 rows to be split")
    digest = hash_order(seed, quoted(row_id))
    if min(counts.values()) >= cv_folds:
        quotas = {g: round_half_up(test_share * n) for g, n in counts.items()}
        in_test = first_ranks(df, quotas, digest, target)
    else:
        quota = math.ceil(test_share * sum(counts.values()))
        everything = df.withColumn("_all", F.lit(1))
        threshold = hash_thresholds(everything, "_all", digest, {1: [quota]})[1][quota]
        in_test = digest <= threshold
    split = df.withColumn("split", F.when(in_test, "test").otherwise("train"))
    if min(counts.values()) >= cv_folds:
        train = {g: n - quotas[g] for g, n in counts.items()}
    else:
        train = count_classes(split.where("split = 'train'"), target)
    if len(train) < 2:
        raise ValueError("the training part needs at least 2 classes")
    if min(train.values()) < cv_folds:
        raise ValueError("a class has fewer training rows than there are folds")
    return split


def fold_count(counts: dict[object, int], cv_folds: int = CV_FOLDS) -> int:
    return max(2, min(cv_folds, min(counts.values())))


def stratified_kfold(
    df: DataFrame, seed: int, cv_folds: int = CV_FOLDS, row_id: str = "row_id", target: str = "target"
) -> DataFrame:
    """Add ``fold`` (from 0): each class cut into even pieces of its hash order."""
    counts = count_classes(df, target)
    folds = fold_count(counts, cv_folds)
    digest = hash_order(seed, quoted(row_id))
    ends: dict[object, list[int]] = {}
    for g, n in counts.items():
        sizes = [n // folds + (i < n % folds) for i in range(folds)]
        ends[g] = [sum(sizes[: i + 1]) for i in range(folds - 1)]
    thresholds = hash_thresholds(df, target, digest, ends)
    fold = F.lit(None).cast("int")
    for g, ranks in ends.items():
        within = F.lit(0)
        for rank in ranks:
            within = within + (digest > thresholds[g][rank]).cast("int") if rank else within + F.lit(1)
        fold = F.when(quoted(target) == F.lit(g), within).otherwise(fold)
    return df.withColumn("fold", fold.cast("int"))
