"""Model training, tuning, scoring and the experiment, on the given embeddings.

Fitted models differ from engine to engine, so the classes they predict have no SQL; the
tests hold them to bounds instead. What has SQL is which rows were scored, and what follows
from any fit: linear models lie where their objective is flat, probabilities sum to one.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.catalog.bindings import SQL_EMBEDDINGS, embeddings
from ballast.catalog.registry import query
from ballast.catalog.sampling import SEED, order_sql
from ballast.models.classifiers import build_estimator
from ballast.models.estimator import training_table
from ballast.models.optimality import steepest_slope
from ballast.models.tuning import feature_columns, grid_search, predict, predict_proba, train_default
from ballast.operators.splitting import stratified_split
from ballast.plans.experiment import run_experiment, score_test_set, train_and_store
from ballast.session import scratch_path
from ballast.sources.models import ModelStore
from ballast.sources.predictions import PredictionStore

DIMENSIONS = 64
FLAT = 0.01  # the slope left at the solver's tolerance, of features with deviation 1
NUM_SEEDS = 5  # as in the reference's results: 17 pairs of model and technique with 5 seeds


def vectors(spark, sf_dir) -> DataFrame:
    """All embeddings as ``(row_id, f1..f64, target)``."""
    columns = [F.col("x")[i].alias(f"f{i + 1}") for i in range(DIMENSIONS)]
    return embeddings(spark, sf_dir).select("row_id", *columns, "target")


def parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    split = stratified_split(vectors(spark, sf_dir), SEED)
    return split.where("split = 'train'").drop("split"), split.where("split = 'test'").drop("split")


TEST = (
    f"with raw as ({SQL_EMBEDDINGS}), ranked as (select *, row_number() over (partition by target order by {order_sql()}) as rn,"
    " count(*) over (partition by target) as n from raw) select row_id, target{} from ranked where rn <= floor(0.3 * n + 0.5)"
)
BINARY = TEST.replace("{}", ", true as binary")


def scored(model, test) -> DataFrame:
    """The test rows as the model scored them; the classes it predicts differ from engine to engine."""
    return predict(model, test).select("row_id", "target", F.col("prediction").isin(0, 1).alias("binary"))


def trained(spark, sf_dir, model_type, technique) -> DataFrame:
    train, test = parts(spark, sf_dir)
    return scored(train_default(train, model_type, technique, SEED).model, test)


def optimal(spark, sf_dir, technique) -> DataFrame:
    """The scored test rows, and whether the objective has no slope at the coefficients found."""
    train, test = parts(spark, sf_dir)
    estimator = build_estimator("svm", technique, feature_columns(train), SEED)
    stages, rows = estimator.prepare(train)
    table = training_table(rows, DIMENSIONS)
    model = estimator.fit_rows(stages, table)
    slope = steepest_slope(model.stages[-1], estimator.labelled(table))
    table.unpersist()
    return scored(model, test).withColumn("optimal", F.lit(slope < FLAT))


@query("train_linear", TEST.replace("{}", ", true as binary, true as optimal"))
def _(spark, sf_dir):
    return optimal(spark, sf_dir, "baseline")


@query("train_cost_sensitive", TEST.replace("{}", ", true as binary, true as optimal"))
def _(spark, sf_dir):
    return optimal(spark, sf_dir, "cs_svm")


@query("train_forest", BINARY)
def _(spark, sf_dir):
    return trained(spark, sf_dir, "random_forest", "random_under_sampling")


@query("train_boosted", BINARY)
def _(spark, sf_dir):
    return trained(spark, sf_dir, "xgboost", "random_under_sampling")


@query("train_mlp", BINARY)
def _(spark, sf_dir):
    return trained(spark, sf_dir, "mlp", "smote")


@query("train_default", BINARY)
def _(spark, sf_dir):
    return trained(spark, sf_dir, "svm", "smote_tomek")


RANKED_TRAIN = (
    f"with raw as ({SQL_EMBEDDINGS}), ranked as (select *, row_number() over (partition by target order by {order_sql()}) as rn,"
    " count(*) over (partition by target) as n from raw), train as (select target, count(*) as n from ranked"
    " where rn > floor(0.3 * n + 0.5) group by target)"
)
CANDIDATES = RANKED_TRAIN + """ select r as "regParam", e as "elasticNetParam", i as "maxIter", w as "classWeight",
    sum(n)::bigint as rows, coalesce(sum(n) filter (where target = 1), 0)::bigint as positives, true as scored
from train, (values (0.0001::double), (0.001::double), (0.01::double)) a(r), (values (0.0::double), (0.15::double)) b(e), (values (1000), (2000)) c(i),
    (values ('none'), ('balanced'), ('1:5'), ('1:10')) d(w) group by all"""


def weight_name(rule) -> str:
    return f"{rule[0]}:{rule[1]}" if isinstance(rule, dict) else str(rule).lower()


# Every candidate with the rows it was scored on over all folds; the scores differ from engine to engine.
@query("grid_search", CANDIDATES)
def _(spark, sf_dir):
    train, _ = parts(spark, sf_dir)
    found = grid_search(train, "svm", "cs_svm", SEED, parallelism=8)
    rows = [
        (c["regParam"], c["elasticNetParam"], c["maxIter"], weight_name(c["classWeight"]), n["rows"], n["positives"], 0 <= score <= 1)
        for (c, score), n in zip(found.scores, found.counted)
    ]
    schema = "regParam double, elasticNetParam double, maxIter int, classWeight string, rows bigint, positives bigint, scored boolean"
    return spark.createDataFrame(rows, schema)


ADJUSTED = RANKED_TRAIN + """, sizes as (select t.technique, n, target, min(n) over (partition by t.technique) as least, max(n) over (partition by t.technique) as most
    from train, (values ('baseline'), ('smote'), ('random_under_sampling')) t(technique)),
filled as (select technique, case technique when 'smote' then most when 'random_under_sampling' then least else n end as n from sizes)
select technique, technique <> 'random_under_sampling' as active,
    case when technique = 'random_under_sampling' then 0 else sum(floor(0.1 * n + 0.5)) end::bigint as held_out from filled group by technique"""


# From fitted perceptrons: whether each watched a hold-out, and of how many rows. The fits run side by side, as
# each waits for the driver between its passes.
@query("technique_adjust", ADJUSTED)
def _(spark, sf_dir):
    train, techniques = parts(spark, sf_dir)[0].persist(), ("baseline", "smote", "random_under_sampling")

    def adjusted(technique: str) -> tuple:
        stopping = train_default(train, "mlp", technique, SEED).model.stages[-1].stopping
        return technique, stopping.active, stopping.held_out

    try:
        with ThreadPool(len(techniques)) as pool:
            rows = pool.map(adjusted, techniques, chunksize=1)
    finally:
        train.unpersist()
    return spark.createDataFrame(rows, "technique string, active boolean, held_out bigint")


@query("predict", BINARY)
def _(spark, sf_dir):
    return trained(spark, sf_dir, "svm", "random_under_sampling")


@query("predict_proba", TEST.replace(", target{}", ", true as sums_to_one, true as agrees"))
def _(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    model = train_default(train, "svm", "baseline", SEED).model
    both = predict_proba(model, test).join(predict(model, test), "row_id")
    return both.select(
        "row_id",
        (F.abs(F.col("p0") + F.col("p1") - 1) < 1e-9).alias("sums_to_one"),
        ((F.col("p1") > 0.5).cast("int") == F.col("prediction")).alias("agrees"),
    )


def stored_models(spark, sf_dir) -> ModelStore:
    train, _ = parts(spark, sf_dir)
    models = ModelStore(spark, scratch_path(spark, "models"))
    for technique in ("baseline", "cs_svm"):
        models.save(train_default(train, "svm", technique, SEED), "test", "svm", technique)
    return models


STORED = "select 'test' as dataset, 'svm' as model_type, technique, 7 as seed{} from (values ('baseline'), ('cs_svm')) t(technique)"


@query("save_model", STORED.format(", 1 as count"))
def _(spark, sf_dir):
    return stored_models(spark, sf_dir).registry().groupBy("dataset", "model_type", "technique", "seed").count()


@query("model_versions", STORED.format("") + " where technique = 'cs_svm'")
def _(spark, sf_dir):
    return stored_models(spark, sf_dir).versions("test", "svm", "cs_svm").select("dataset", "model_type", "technique", "seed")


@query("latest_model", TEST.replace("{}", ", true as binary, 'balanced' as rule"))
def _(spark, sf_dir):
    _, test = parts(spark, sf_dir)
    newest = stored_models(spark, sf_dir).latest("test")
    return scored(newest.model, test).withColumn("rule", F.lit(newest.params.get("classWeight")))


@query("score_test_set", BINARY)
def _(spark, sf_dir):
    found = score_test_set(vectors(spark, sf_dir), stored_models(spark, sf_dir), "test")
    return found.select("row_id", "target", F.col("prediction").isin(0, 1).alias("binary"))


@query("train_and_store", TEST.replace("{}", ", true as binary, 'random_under_sampling' as technique"))
def _(spark, sf_dir):
    models = ModelStore(spark, scratch_path(spark, "models"))
    data = vectors(spark, sf_dir)
    model_id = train_and_store(data, models, "test", "svm", "random_under_sampling", SEED)
    technique = models.versions("test").where(F.col("id") == model_id).first()["technique"]
    found = score_test_set(data, models, "test", model_id)
    return found.select("row_id", "target", F.col("prediction").isin(0, 1).alias("binary"), F.lit(technique).alias("technique"))


RUNS = f"""with raw as ({SQL_EMBEDDINGS}), ranked as (select r.*, s.seed, row_number() over (partition by s.seed, target
    order by md5(concat(cast(s.seed as varchar), ':', cast(row_id as string)))) as rn, count(*) over (partition by s.seed, target) as n
    from raw r, (select unnest(range(1, {NUM_SEEDS + 1})) as seed) s),
held as (select seed, count(*) as rows, count(*) filter (where target = 1) as positives from ranked where rn <= floor(0.3 * n + 0.5) group by seed),
pairs as (select m.model_type, t.technique from (values ('random_forest'), ('svm'), ('xgboost'), ('mlp')) m(model_type),
    (values ('baseline'), ('smote'), ('random_under_sampling'), ('smote_tomek'), ('cs_svm')) t(technique)
    where t.technique <> 'cs_svm' or m.model_type = 'svm')
select 'test' as dataset, model_type, technique, seed, rows, positives, true as binary from pairs, held"""


# One row a run: the rows and positives of its test part; what the models predict differs from engine to engine.
@query("run_experiment", RUNS)
def _(spark, sf_dir):
    store = PredictionStore(spark, scratch_path(spark, "experiment"))
    run_experiment(spark, {"test": vectors(spark, sf_dir)}, store, NUM_SEEDS, parallelism=16)
    rows = store.read().groupBy("dataset", "model_type", "technique", "seed")
    return rows.agg(
        F.count("*").alias("rows"), F.count_if(F.col("target") == 1).alias("positives"), F.every(F.col("prediction").isin(0, 1)).alias("binary")
    )
