import inspect
import re
import threading
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballast.catalog import QUERIES, learning
from ballast.models import tuning as M
from ballast.models.classifiers import build_estimator, parameter_grid
from ballast.operators.metrics import metrics_per_seed
from ballast.operators.splitting import stratified_split
from ballast.plans import experiment as E
from ballast.sources.models import ModelNotFound, ModelStore
from ballast.sources.predictions import PredictionStore


@pytest.fixture(scope="module")
def credit(spark):
    """200 rows, one in five positive, ten features of which two carry signal."""
    rng = np.random.default_rng(0)
    y = (np.arange(200) % 5 == 0).astype(int)
    x = rng.normal(size=(200, 10))
    x[:, :2] += 2.5 * y[:, None]
    rows = [(i, *[None if (i + j) % 37 == 0 else float(v) for j, v in enumerate(a)], int(t)) for i, (a, t) in enumerate(zip(x, y))]
    schema = "row_id long, " + ", ".join(f"feature_{j} double" for j in range(10)) + ", target int"
    return spark.createDataFrame(rows, schema).coalesce(1).persist()


@pytest.fixture(scope="module")
def halves(credit):
    split = stratified_split(credit, 1).persist()
    return split.where("split = 'train'").drop("split"), split.where("split = 'test'").drop("split")


@pytest.mark.parametrize("technique", ["baseline", "smote", "random_under_sampling", "smote_tomek", "cs_svm"])
def test_linear_learns_with_every_technique(halves, technique):
    train, test = halves
    model = M.train_default(train, "svm", technique, 1).model
    scores = metrics_per_seed(M.predict(model, test), keys=[]).first()
    assert scores.balanced_accuracy > 0.75
    assert scores.TP + scores.TN + scores.FP + scores.FN == test.count()


def test_a_fit_leaves_the_table_of_its_caller_in_memory(halves):
    train = halves[0].withColumn("feature_0", F.col("feature_0") * 2).persist()
    M.train_default(train, "svm", "baseline", 1)
    assert train.storageLevel.useMemory
    train.unpersist()
    M.train_default(train, "svm", "baseline", 1)
    assert not train.storageLevel.useMemory


def test_the_fits_of_technique_adjust_run_side_by_side(spark, halves, monkeypatch):
    meeting, shared = threading.Barrier(3), halves[0].withColumn("feature_1", F.col("feature_1") * 2)

    def fitted(train, model_type, technique, seed):
        meeting.wait(60)  # raises unless three fits are under way
        assert train.storageLevel.useMemory
        stopping = SimpleNamespace(active=technique != "random_under_sampling", held_out=len(technique))
        return SimpleNamespace(model=SimpleNamespace(stages=[SimpleNamespace(stopping=stopping)]))

    monkeypatch.setattr(learning, "parts", lambda *_: (shared, None))
    monkeypatch.setattr(learning, "train_default", fitted)
    rows = {tuple(r) for r in QUERIES["technique_adjust"](spark, "").collect()}
    assert rows == {("baseline", True, 8), ("smote", True, 5), ("random_under_sampling", False, 21)}
    assert not shared.storageLevel.useMemory


@pytest.mark.parametrize("model_type", ["random_forest", "xgboost", "mlp"])
def test_other_classifiers_learn(halves, model_type):
    train, test = halves
    estimator = build_estimator(model_type, "random_under_sampling", M.feature_columns(train), 1)
    small = {"random_forest": {"numTrees": 10, "maxDepth": 5}, "xgboost": {"maxIter": 5, "maxDepth": 3}, "mlp": {"maxIter": 30}}
    model = estimator.fit(train, M.grid_for(estimator, [small[model_type]])[0])
    assert metrics_per_seed(M.predict(model, test), keys=[]).first().balanced_accuracy > 0.6


def test_grid_sizes(halves):
    columns = M.feature_columns(halves[0])
    sizes = {m: len(parameter_grid(build_estimator(m, "baseline", columns, 1), m)) for m in ("svm", "random_forest", "xgboost", "mlp")}
    assert sizes == {"svm": 12, "random_forest": 12, "xgboost": 48, "mlp": 3}
    assert len(parameter_grid(build_estimator("svm", "cs_svm", columns, 1), "svm")) == 48


def test_invalid_pairs(halves):
    for pair in (("mlp", "cs_svm"), ("tree", "baseline"), ("svm", "magic")):
        with pytest.raises(ValueError):
            M.train_default(halves[0], *pair, 1)


def test_grid_search_prepares_once_per_fold(halves, monkeypatch):
    from ballast.models.estimator import RebalancedClassifier

    calls = []
    plain = RebalancedClassifier.prepare
    monkeypatch.setattr(RebalancedClassifier, "prepare", lambda self, t: (calls.append(1), plain(self, t))[1])
    grid = [{"classWeight": {0: 1, 1: 1e-6}}, {"classWeight": "balanced"}, {"classWeight": {0: 1e-6, 1: 1}}]
    found = M.grid_search(halves[0], "svm", "cs_svm", 3, grid=grid, cv_folds=3)
    assert len(calls) == 3 + 1 and len(found.scores) == 3
    assert found.params == {"classWeight": "balanced"} and found.seed == 3
    assert [s > 0.75 for _, s in found.scores] == [False, True, False]


def test_preparation_comes_from_training_rows_only(halves):
    train, test = halves
    statement = M.train_default(train, "svm", "baseline", 1).model.stages[0].getStatement()
    moved = M.train_default(train, "svm", "baseline", 1).model.stages[0].getStatement()
    assert statement == moved and repr(train.agg(F.percentile("feature_0", 0.5)).first()[0]) in statement


def test_probabilities_have_two_columns(spark, halves):
    train, test = halves
    model = M.train_default(train, "svm", "baseline", 1).model
    rows = M.predict_proba(model, test).collect()
    assert all(abs(r.p0 + r.p1 - 1) < 1e-9 for r in rows) and len(rows) == test.count()
    estimator = build_estimator("random_forest", "baseline", M.feature_columns(train), 1)
    one_class = estimator.fit(train.where("target = 0"), M.grid_for(estimator, [{"numTrees": 2, "maxDepth": 2}])[0])
    assert {(r.p0, r.p1) for r in M.predict_proba(one_class, test).collect()} == {(1.0, 0.0)}


def test_model_store(spark, halves, credit, tmp_path):
    models = ModelStore(spark, str(tmp_path))
    first = models.save(M.train_default(halves[0], "svm", "baseline", 1), "test", "svm", "baseline")
    second = models.save(M.train_default(halves[0], "svm", "cs_svm", 1), "test", "svm", "cs_svm")
    assert models.versions("test").count() == 2 and models.versions("test", technique="cs_svm").first().id == second
    assert models.latest("test").params["classWeight"] == "balanced"
    assert models.latest("test", technique="baseline").seed == 1
    again = M.predict(models.load("test", first).model, halves[1]).collect()
    assert len(again) == halves[1].count()
    with pytest.raises(ModelNotFound):
        models.load("test", "unknown")
    with pytest.raises(ModelNotFound):
        models.latest("lending_club")
    assert E.score_test_set(credit, models, "test", first).count() == halves[1].count()


def test_experiment_runs_resumes_and_finishes(spark, credit, tmp_path):
    store = PredictionStore(spark, str(tmp_path))
    excluded, trained = ["random_forest", "xgboost", "mlp"], []

    def trainer(rows, model_type, technique, seed, columns):
        trained.append((technique, seed))
        if len(trained) == 4:
            raise RuntimeError("interrupted")
        return M.train_default(rows, model_type, "baseline", seed, columns)

    with pytest.raises(RuntimeError, match="interrupted"):
        E.run_experiment(spark, {"test": credit}, store, 1, excluded, trainer=trainer, parallelism=1)
    stored = {r.technique for r in store.runs().collect()}
    resolution = E.resume_execution(store.read(), ["test"], 1, excluded)
    assert resolution.status == "resumed_incomplete" and resolution.completed == len(stored) == 3
    done = E.run_experiment(spark, {"test": credit}, store, 1, excluded, trainer=trainer, parallelism=1)
    assert done.execution_id == resolution.execution_id and len(trained) == 4 + 2
    assert E.run_experiment(spark, {"test": credit}, store, 1, excluded, trainer=trainer).finished
    assert len(trained) == 6 and store.runs().count() == 5
    assert metrics_per_seed(store.read()).count() == 5


def test_resolution(spark):
    empty = spark.createDataFrame([], "execution_id string, dataset string, model_type string, technique string, seed int")
    assert E.resume_execution(empty, ["test"], 1).status == "new_execution"
    assert E.resume_execution(empty, ["test"], 1, execution_id="x").status == "explicit_id_new"
    assert E.resume_execution(empty, ["test"], 1, skip_resume=True).status == "skip_resume"
    one = spark.createDataFrame([("x", "test", "svm", "smote", 1)], empty.schema)
    assert E.resume_execution(one, ["test"], 1, execution_id="x").status == "explicit_id_continued"
    assert E.resume_execution(one, ["lending_club"], 1).status == "new_execution"
    with pytest.raises(ValueError):
        E.resume_execution(one, ["test"], 1, execution_id="x", skip_resume=True)
    assert E.combination_grid(spark, ["test", "lending_club"], 5).count() == 17 * 5 * 2


@pytest.mark.parametrize(("name", "operator"), [("grid_search", M.grid_search), ("run_experiment", E.run_experiment)])
def test_queries_ask_for_the_whole_job(spark, credit, monkeypatch, name, operator):
    class Asked(Exception):
        pass

    def ask(*args, **options):
        bound = inspect.signature(operator).bind(*args, **options)
        bound.apply_defaults()
        raise Asked(bound.arguments)

    monkeypatch.setattr(learning, "vectors", lambda spark, sf_dir: credit)
    monkeypatch.setattr(learning, name, ask)
    with pytest.raises(Asked) as caught:
        QUERIES[name](spark, "unused")
    asked = caught.value.args[0]
    if name == "grid_search":
        assert asked["grid"] is None and asked["cv_folds"] == 5
    else:
        assert E.combination_grid(spark, list(asked["data"]), asked["num_seeds"], asked["excluded_models"]).count() == 17 * 5


def test_candidates_that_differ_in_a_bound_not_reached_are_one_fit(halves):
    grid = [{"regParam": r, "maxIter": n} for r in (1e-3, 1e-2) for n in (2000, 1, 1000)]
    found = M.grid_search(halves[0], "svm", "baseline", 3, grid=grid, cv_folds=2)
    assert found.fits == 2 * 2 * 2 + 1  # one of a single round and one that ends by itself, per penalty and fold, and the best
    scores = [s for _, s in found.scores]
    assert scores[0] == scores[2] and scores[3] == scores[5]
    rows = halves[0].count()
    assert [c["rows"] for c in found.counted] == [rows] * 6 and [p for p, _ in found.scores] == grid


def test_perceptron_stops_early_and_not_under_sampled(halves):
    train, _ = halves
    columns = M.feature_columns(train)
    fitted = build_estimator("mlp", "baseline", columns, 1).fit(train).stages[-1]
    assert fitted.stopping.active and fitted.stopping.held_out == 14  # a tenth of 112 and of 28
    assert 1 <= fitted.stopping.rounds <= 10 and fitted.stopping.iterations == min(200, 20 * fitted.stopping.rounds)
    small = build_estimator("mlp", "random_under_sampling", columns, 1)
    assert not small.fit(train, M.grid_for(small, [{"maxIter": 5}])[0]).stages[-1].stopping.active


def test_slope_vanishes_only_at_the_optimum(halves):
    from ballast.models.estimator import training_table
    from ballast.models.optimality import steepest_slope

    for technique in ("baseline", "cs_svm"):
        estimator = build_estimator("svm", technique, M.feature_columns(halves[0]), 1)
        stages, rows = estimator.prepare(halves[0])
        table = training_table(rows, 10)
        slopes = [
            steepest_slope(estimator.copy(M.grid_for(estimator, [{"maxIter": n, "tol": 1e-9}])[0]).fit_rows([], table).stages[-1], estimator.labelled(table))
            for n in (1, 1000)
        ]
        assert slopes[0] > 0.01 and slopes[1] < 1e-5


def test_trees_do_not_depend_on_partitions(halves):
    train, test = halves
    estimator = build_estimator("random_forest", "baseline", M.feature_columns(train), 1)
    small = M.grid_for(estimator, [{"numTrees": 5, "maxDepth": 4}])[0]
    texts = [estimator.fit(train.repartition(n), small).stages[-1].toDebugString.split("\n", 1)[1] for n in (1, 9)]
    made = [re.sub(r"-?\d+\.\d+(E-?\d+)?", lambda m: f"{float(m[0]):.9g}", t) for t in texts]  # means differ in the last digit
    assert made[0] == made[1]


def test_experiment_prepares_once_a_seed_and_rebalances_once_a_technique(spark, credit, tmp_path, monkeypatch):
    from ballast.models.estimator import RebalancedClassifier

    calls = {"prepare_features": [], "rebalance": []}
    for name in calls:
        plain = getattr(RebalancedClassifier, name)
        monkeypatch.setattr(RebalancedClassifier, name, lambda self, t, plain=plain, name=name: (calls[name].append(self.technique), plain(self, t))[1])
    store = PredictionStore(spark, str(tmp_path))
    E.run_experiment(spark, {"test": credit}, store, 2, ["xgboost", "mlp"], parallelism=3)
    assert len(calls["prepare_features"]) == 2
    assert sorted(calls["rebalance"]) == sorted(["baseline", "smote", "random_under_sampling", "smote_tomek", "cs_svm"] * 2)
    assert store.runs().count() == (2 * 4 + 1) * 2


def test_lease_frees_after_the_last_use():
    freed = []
    lease = E.Lease(lambda: ("made", lambda: freed.append(1)), 2)
    assert lease.value() == lease.value() == "made"
    lease.release()
    assert not freed
    lease.release()
    assert freed == [1]
    lease.free()
    assert freed == [1]


def test_leaves_of_a_forest_are_bounded(halves, monkeypatch):
    from ballast.models import estimator as models

    monkeypatch.setattr(models, "MAX_LEAVES", 4)
    train, _ = halves
    forest = build_estimator("random_forest", "baseline", M.feature_columns(train), 1)
    fitted = forest.fit(train, M.grid_for(forest, [{"numTrees": 5}])[0]).stages[-1]
    assert all(tree.numNodes <= 2 * 4 - 1 for tree in fitted.trees)


def test_a_forest_has_its_own_parameters_whatever_the_rows(spark):
    rows = spark.range(6_000).selectExpr("id as row_id", "id % 97 * 1.0 as a", "id % 11 * 1.0 as b", "int(id % 3 = 0) as target")
    forest = build_estimator("random_forest", "baseline", ["a", "b"], 1)
    fitted = forest.fit(rows, M.grid_for(forest, [{"numTrees": 2, "maxDepth": 2}])[0]).stages[-1]
    assert fitted.getOrDefault("minInstancesPerNode") == 1
