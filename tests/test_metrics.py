import math

import pytest
from pyspark.sql import functions as F

from ballast.operators import metrics as M
from ballast.plans import analysis as A
from ballast.vocabulary import METRICS


def metrics_of(spark, *counts):
    df = spark.createDataFrame([counts], "TP int, TN int, FP int, FN int")
    return M.classification_metrics(df).first()


def runs(spark, rows):
    """(technique, model, seed, TP, TN, FP, FN) as predictions of one dataset."""
    out = []
    for technique, model, seed, tp, tn, fp, fn in rows:
        for n, target, prediction in ((tp, 1, 1), (tn, 0, 0), (fp, 0, 1), (fn, 1, 0)):
            out += [("lending_club", model, technique, seed, target, prediction)] * n
    return spark.createDataFrame(
        out, "dataset string, model_type string, technique string, seed int, target int, prediction int"
    )


def test_perfect_and_mixed(spark):
    perfect = metrics_of(spark, 2, 2, 0, 0)
    assert all(perfect[m] == 1.0 for m in METRICS)
    mixed = metrics_of(spark, 1, 1, 1, 1)
    assert all(mixed[m] == 0.5 for m in METRICS)


def test_zero_denominators_are_zero(spark):
    row = metrics_of(spark, 0, 2, 0, 2)
    assert (row.precision, row.sensitivity, row.f1_score, row.g_mean, row.specificity) == (0, 0, 0, 0, 1)
    assert row.balanced_accuracy == 0.5
    assert all(metrics_of(spark, 0, 0, 0, 0)[m] == 0 for m in METRICS)


def test_all_wrong(spark):
    assert all(metrics_of(spark, 0, 0, 2, 2)[m] == 0 for m in METRICS)


def test_counts_per_run(spark):
    got = M.confusion_matrix(runs(spark, [("smote", "svm", 1, 3, 4, 1, 2), ("smote", "svm", 2, 1, 0, 0, 0)]))
    assert {(r.seed, r.TP, r.TN, r.FP, r.FN) for r in got.collect()} == {(1, 3, 4, 1, 2), (2, 1, 0, 0, 0)}


def test_no_predictions_give_no_rows(spark):
    empty = runs(spark, [("smote", "svm", 1, 1, 1, 0, 0)]).where("seed = 9")
    assert M.metrics_mean_std(M.metrics_per_seed(empty)).count() == 0


def test_single_seed_has_no_deviation(spark):
    metrics = M.metrics_mean_std(M.metrics_per_seed(runs(spark, [("baseline", "svm", 1, 1, 1, 1, 1)])))
    assert metrics.first().g_mean_std is None
    assert A.summary_table(metrics).first().g_mean == "0.5000 (n/a)"
    assert A.cross_dataset(metrics).first().lending_club == "0.5 ± n/a"


def test_ties_go_to_the_first_technique_by_name(spark):
    rows = [("baseline", "svm", 1, 1, 2, 2, 1), ("smote_tomek", "svm", 1, 2, 2, 0, 0), ("smote", "svm", 1, 2, 2, 0, 0)]
    metrics = M.metrics_mean_std(M.metrics_per_seed(runs(spark, rows)))
    row = A.imbalance_impact(metrics).first()
    assert row.best_technique == "smote" and row.g_mean_improvement == pytest.approx(0.5)


def test_a_model_without_treatment_is_kept(spark):
    metrics = M.metrics_mean_std(M.metrics_per_seed(runs(spark, [("baseline", "mlp", 1, 1, 1, 0, 0)])))
    row = A.imbalance_impact(metrics).first()
    assert row.model_type == "mlp" and row.best_technique is None and row.g_mean_improvement is None


def test_stability_follows_defined_order(spark):
    rows = [(t, m, s, 1, 1, 0, 0) for t in ("smote", "baseline") for m in ("mlp", "random_forest") for s in (2, 1)]
    got = A.sort_stability(M.metrics_per_seed(runs(spark, rows))).collect()
    assert [(r.model_type, r.technique, r.seed) for r in got][:3] == [
        ("random_forest", "baseline", 1), ("random_forest", "baseline", 2), ("random_forest", "smote", 1),
    ]


def test_number_texts(spark):
    from ballast.functions.text import fixed4, format_plus_minus, round_to_string, title_case

    df = spark.createDataFrame([(0.0003, 0.0), (0.5, 1.0), (0.28125, 0.00004)], "a double, b double")
    got = df.select(round_to_string(F.col("a")).alias("a"), format_plus_minus(F.col("a"), F.col("b")).alias("c"), fixed4(F.col("a")).alias("f")).collect()
    assert [tuple(r) for r in got] == [
        ("0.0003", "0.0003 ± 0.0", "0.0003"), ("0.5", "0.5 ± 1.0", "0.5000"), ("0.2812", "0.2812 ± 0.0", "0.2812"),
    ]
    assert spark.range(1).select(title_case(F.lit("near_miss"))).first()[0] == "Near Miss"


def test_labels(spark):
    from ballast.operators.columns import map_labels

    df = spark.createDataFrame([("cs_svm",), ("new_thing",)], "technique string")
    assert {r.technique_label for r in map_labels(df, "technique").collect()} == {"CS-SVM", "New Thing"}
    with pytest.raises(Exception, match="no label"):
        map_labels(df, "technique", strict=True).collect()


def test_boxplot_whiskers_and_outliers(spark):
    values = [0.50, 0.51, 0.52, 0.53, 0.54, 0.99]
    df = spark.createDataFrame(
        [("lending_club", "smote", "svm", v) for v in values],
        "dataset string, technique string, model_type string, balanced_accuracy double",
    )
    row = A.stability_boxplot(df).first()
    assert (row.whisker_low, row.whisker_high, row.outliers, row.n) == (0.50, 0.54, 1, 6)
    assert row.median == pytest.approx(0.525) and math.isclose(row.q1, 0.5125)


def test_summary_filter_and_position(spark):
    rows = [("baseline", "svm", 1, 1, 1, 1, 1), ("smote", "svm", 1, 2, 2, 0, 0), ("smote", "mlp", 1, 2, 2, 1, 1)]
    metrics = M.metrics_mean_std(M.metrics_per_seed(runs(spark, rows)))
    got = A.summary_table(metrics, "smote").orderBy("position").collect()
    assert [(r.position, r.model_type) for r in got] == [(1, "svm"), (2, "mlp")]


def test_executions_are_not_pooled(spark):
    from ballast.plans.analysis import of_execution, run_all

    keys = ("lending_club", "svm", "baseline", 1)
    rows = [("a", *keys, t, t) for t in (0, 1)] * 2 + [("b", *keys, t, 1 - t) for t in (0, 1)] * 2
    schema = "execution_id string, dataset string, model_type string, technique string, seed int, target int, prediction int"
    stored = spark.createDataFrame(rows, schema)
    assert of_execution(stored).select("execution_id").distinct().collect() == [("b",)]
    assert run_all(stored, execution_id="a")["tradeoff_points"].first()["precision_mean"] == 1.0
    assert run_all(stored, "lending_club")["tradeoff_points"].first()["precision_mean"] == 0.0
