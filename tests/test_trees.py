import re

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ballast.models import trees as T


@pytest.fixture(scope="module")
def rows(spark):
    """600 rows of four features, one with few values and one almost constant."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    x[:, 2], x[:, 3] = rng.integers(0, 5, 600), np.arange(600) % 100 == 0
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=600) > 0.5).astype(float)
    made = spark.createDataFrame([(i, [float(v) for v in a], float(t)) for i, (a, t) in enumerate(zip(x, y))], "row_id long, x array<double>, label double")
    return made.select("row_id", array_to_vector("x").alias("features"), "label").repartition(3).persist()


def text(model) -> str:
    return model.toDebugString.split("\n", 1)[1]


@pytest.mark.parametrize(("kind", "options"), [("Forest", {"numTrees": 3, "maxDepth": 5}), ("BoostedTrees", {"maxIter": 4, "maxDepth": 3, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"})])
def test_trees_grown_in_a_task_and_by_jobs_are_the_same(rows, monkeypatch, kind, options):
    estimator = getattr(T, kind)(seed=3, **options)
    here = estimator.fit(rows)
    monkeypatch.setattr(T, "TASK_BYTES", 0)
    monkeypatch.setattr(T, "NODES_AT_ONCE", 5)
    spread = estimator.fit(rows.repartition(2, "label", "row_id"))
    assert text(here) == text(spread) and here.totalNumNodes > 30
    other = estimator.copy({estimator.seed: 4}).fit(rows)
    assert text(other) != text(here)


def test_boosted_trees_are_those_of_spark(rows):
    options = {"maxIter": 15, "maxDepth": 3, "stepSize": 0.1, "seed": 1}
    own, theirs = T.BoostedTrees(**options).fit(rows), GBTClassifier(**options).fit(rows)
    p = [m.transform(rows).select("row_id", F.col("probability").cast("string").alias("p")).orderBy("row_id").collect() for m in (own, theirs)]
    a, b = (np.array([float(re.findall(r"[\d.E-]+", r.p)[1]) for r in q]) for q in p)
    assert np.abs(a - b).max() < 1e-6 and own.treeWeights == theirs.treeWeights and own.totalNumNodes == theirs.totalNumNodes


def test_a_fit_starts_few_jobs(spark, rows):
    """Spark's own start one for each level of each tree."""
    context = spark.sparkContext
    context.setJobGroup("boosted", "boosted")
    try:
        T.BoostedTrees(maxIter=20, maxDepth=3, seed=1).fit(rows)
        assert len(context.statusTracker().getJobIdsForGroup("boosted")) < 20
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_query_classifiers_are_grown_here(spark):
    from ballast.models.classifiers import build_classifier

    assert isinstance(build_classifier("xgboost", 4, 1), T.BoostedTrees) and isinstance(build_classifier("random_forest", 4, 1), T.Forest)


def test_cuts_lie_between_equal_shares():
    rng = np.random.default_rng(2)
    x = np.stack([rng.normal(size=5000), rng.integers(0, 3, 5000), np.zeros(5000), np.where(np.arange(5000) < 9, -1e300, rng.normal(size=5000))], axis=1)
    x[4000:, 1] = -0.0
    blocks = [x[:1700], x[1700:1701], x[1701:]]
    cuts = T.answered(T.find_cuts(5000, 4, 8), list(blocks))
    same = T.answered(T.find_cuts(5000, 4, 8, np.sort(x, axis=0)), [x])
    assert all(np.array_equal(a, b) for a, b in zip(cuts, same))
    assert [len(c) for c in cuts] == [7, 2, 0, 7] and list(cuts[1]) == [0.5, 1.5]
    for j in (0, 3):
        assert np.abs(np.bincount(np.searchsorted(cuts[j], x[:, j])) - 625).max() <= 1


def test_every_row_of_a_forest_without_bootstrap_is_told(rows):
    forest = T.Forest(numTrees=3, maxDepth=30, seed=1, bootstrap=False, maxBins=256, featureSubsetStrategy="all").fit(rows)
    wrong = forest.transform(rows).where("prediction <> label").count()
    assert wrong <= 6 and all(tree.depth > 5 for tree in forest.trees)


def test_odd_tables_raise(spark, rows):
    for bad in (rows.limit(0), rows.withColumn("label", F.lit(2.0)), rows.withColumn("label", F.lit(None).cast("double"))):
        with pytest.raises(ValueError):
            T.BoostedTrees(maxIter=2).fit(bad)
