"""Sources, sinks and the catalogue of stored predictions.

Files are written from the given tables to a fresh path in the shared folder and
read back.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballast.catalog.bindings import (
    SQL_EVENTS,
    SQL_LENDING,
    SQL_PREDICTIONS,
    events,
    lending_raw,
    predictions,
    table,
)
from ballast.catalog.columns import over
from ballast.catalog.features import LENDING_SQL
from ballast.catalog.registry import query, rounded
from ballast.operators.profile import class_counts
from ballast.plans.experiment import (
    combination_grid,
    completed_combinations,
    executions_complete,
    pending_combinations,
    resume_execution,
)
from ballast.plans.features import FEATURE_JOBS
from ballast.session import scratch_path
from ballast.sources import predictions as P
from ballast.sources import tables as S

RUNS = "execution_id, dataset, model_type, technique, seed"


def as_csv(df, name):
    path = scratch_path(df.sparkSession, name)
    df.write.csv(path, header=True)
    return path


@query("scan_csv", "select * from orders")
def _(spark, sf_dir):
    source = table(spark, sf_dir, "orders")
    return S.scan_csv(spark, as_csv(source, "orders"), source.schema)


@query("read_csv", "select * from part")
def _(spark, sf_dir):
    source = table(spark, sf_dir, "part")
    return S.scan_csv(spark, as_csv(source, "part"), source.schema)


@query("csv_schema_override", "select lpad(cast(c_custkey as string), 8, '0') as id, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def _(spark, sf_dir):
    source = table(spark, sf_dir, "customer").select(
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("id"), "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"
    )
    return S.csv_with_overrides(spark, as_csv(source, "customer"), {"id": "string"})


TOTAL_LINE = "Total amount funded"


TOLERANT = """select c_custkey, c_name, case when c_nationkey = 5 then null else c_nationkey end as c_nationkey,
    case when c_nationkey in (1, 2) then null else c_acctbal end as c_acctbal, case when c_nationkey = 3 then null else c_mktsegment end as c_mktsegment,
    case c_nationkey when 2 then 'unparsable' when 3 then 'short' when 4 then 'long' end as problem from customer"""


def flawed_csv(spark, sf_dir):
    """All customers as CSV lines: one nation's balances hold a token for NULL, those of another do not parse,
    a third has too few fields, a fourth too many, a fifth no nation."""
    nation = F.col("c_nationkey")
    balance = F.when(nation == 1, F.lit(TOTAL_LINE)).when(nation == 2, F.lit('"12,5 x"')).otherwise(F.col("c_acctbal").cast("string"))
    first = [F.col("c_custkey").cast("string"), F.col("c_name"), F.when(nation == 5, F.lit("")).otherwise(nation.cast("string")), balance]
    last = F.when(nation == 3, F.lit("")).when(nation == 4, F.concat(F.lit(","), "c_mktsegment", F.lit(",more"))).otherwise(F.concat(F.lit(","), "c_mktsegment"))
    path = scratch_path(spark, "flawed")
    table(spark, sf_dir, "customer").select(F.concat(F.concat_ws(",", *first), last)).write.text(path)
    return path, T.StructType.fromDDL("c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@query("csv_tolerant", TOLERANT)
def _(spark, sf_dir):
    path, schema = flawed_csv(spark, sf_dir)
    return S.csv_tolerant(spark, path, schema, TOTAL_LINE, "problem", header=False)


@query("csv_quarantine", f"select coalesce(problem, 'good') as problem, count(*) as n from ({TOLERANT}) group by 1")
def _(spark, sf_dir):
    path, schema = flawed_csv(spark, sf_dir)
    return S.csv_quarantine(spark, path, schema, TOTAL_LINE, header=False)[2]


@query("scan_parquet", "select l_orderkey, l_extendedprice from lineitem where l_returnflag = 'R'")
def _(spark, sf_dir):
    scanned = S.scan_parquet(spark, f"{sf_dir}/lineitem.parquet")
    return scanned.where("l_returnflag = 'R'").select("l_orderkey", "l_extendedprice")


@query("read_parquet", "select * from orders")
def _(spark, sf_dir):
    return S.scan_parquet(spark, f"{sf_dir}/orders.parquet")


@query("write_parquet", "select * from customer")
def _(spark, sf_dir):
    path = scratch_path(spark, "customer")
    S.write_parquet(table(spark, sf_dir, "customer"), path)
    return S.scan_parquet(spark, path)


@query("sink_parquet", "select * from events")
def _(spark, sf_dir):
    path = scratch_path(spark, "events")
    S.write_parquet(table(spark, sf_dir, "events"), path)
    return S.scan_parquet(spark, path)


@query("save_interim", LENDING_SQL)
def _(spark, sf_dir):
    repository = S.DataRepository(spark, scratch_path(spark, "repository"))
    repository.save_interim("lending_club", FEATURE_JOBS["lending_club"](lending_raw(spark, sf_dir)))
    return rounded(repository.interim("lending_club"), 3)


@query("save_final_features", over(SQL_EVENTS, "select row_id, user_id, value, target from raw"))
def _(spark, sf_dir):
    repository = S.DataRepository(spark, scratch_path(spark, "repository"))
    repository.save_final("test", events(spark, sf_dir))
    return S.scan_parquet(spark, repository.final_path("test"))


@query("object_store", over(SQL_EVENTS, "select row_id, value, target from raw"))
def _(spark, sf_dir):
    # Any filesystem Hadoop has a connector for is named by its URI alone.
    root = scratch_path(spark, "objects")
    repository = S.DataRepository(spark, root if "://" in root else f"file://{root}")
    repository.save_interim("test", events(spark, sf_dir).select("row_id", "value", "target"))
    return repository.interim("test")


@query("training_data_cache", over(SQL_EVENTS, "select target, count(*) as n, 1 as read from raw group by target union all select target, count(*), 2 from raw group by target"))
def _(spark, sf_dir):
    repository = S.DataRepository(spark, scratch_path(spark, "repository"))
    repository.save_final("test", events(spark, sf_dir))
    reads = [class_counts(repository.training_data("test")).withColumn("read", F.lit(i)) for i in (1, 2)]
    return reads[0].unionByName(reads[1])


@query("is_processed", "select 'lending_club' as dataset, false as processed, count(*) as n from events union all select 'test', true, count(*) from events")
def _(spark, sf_dir):
    repository = S.DataRepository(spark, scratch_path(spark, "repository"))
    repository.save_final("test", events(spark, sf_dir))
    flags = F.array(
        *[
            F.struct(F.lit(d).alias("dataset"), F.lit(repository.is_processed(d)).alias("processed"))
            for d in ("lending_club", "test")
        ]
    )
    counted = S.scan_parquet(spark, repository.final_path("test")).agg(F.count("*").alias("n"))
    return counted.select(F.inline(flags), "n")


@query(
    "dataset_size",
    "select cast(sum(strlen(concat_ws(',', cast(o_orderkey as string), cast(o_custkey as string), o_orderstatus, o_orderpriority)) + 1) as bigint) as bytes from orders",
)
def _(spark, sf_dir):
    repository = S.DataRepository(spark, scratch_path(spark, "repository"))
    source = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    source.write.csv(repository.raw_path("test"))
    return repository.size_in_bytes("test")


LOGARITHMS = ["annual_inc", "income_to_payment_ratio", "revol_to_income_ratio"]
FINITE = ", ".join(f"case when isinf({c}) then 'nan'::double else {c} end as {c}" for c in LOGARITHMS)


@query("process_datasets", f"select * replace ({FINITE}) from ({LENDING_SQL})")
def _(spark, sf_dir):
    repository = S.DataRepository(spark, scratch_path(spark, "repository"))
    raw = lending_raw(spark, sf_dir)
    raw.write.csv(repository.raw_path("lending_club"), header=True)
    failures = S.process_datasets(repository, ["lending_club"], {"lending_club": raw.schema})
    for _, error in failures:
        raise error
    return rounded(S.scan_parquet(spark, repository.final_path("lending_club")), 3)


@query("export_predictions_csv", over(SQL_PREDICTIONS, "select prediction from raw"))
def _(spark, sf_dir):
    path = scratch_path(spark, "export")
    S.export_predictions_csv(predictions(spark, sf_dir), path)
    return S.scan_csv(spark, path, "prediction int")


def stored_predictions(spark, sf_dir):
    """All predictions of the view in a store of their own."""
    store = P.PredictionStore(spark, scratch_path(spark, "store"))
    store.save(predictions(spark, sf_dir))
    return store


@query("save_predictions", over(SQL_PREDICTIONS, f"select {RUNS}, target, prediction, count(*) as n from raw group by all"))
def _(spark, sf_dir):
    stored = stored_predictions(spark, sf_dir).read()
    return stored.groupBy(*P.RUN_KEYS, "target", "prediction").agg(F.count("*").alias("n"))


@query("list_partitions", over(SQL_PREDICTIONS, f"select distinct {RUNS} from raw"))
def _(spark, sf_dir):
    return stored_predictions(spark, sf_dir).runs()


NEWEST = "0190" + "1997" + "-0000-7000-8000-000000000000"
OLDER = "0190" + "1995" + "-0000-7000-8000-000000000000"


@query(
    "predictions_for_execution",
    over(SQL_PREDICTIONS, f"select model_type, technique, seed, target, prediction from raw where execution_id = '{OLDER}' and dataset = 'taiwan_credit'"),
)
def _(spark, sf_dir):
    found = P.predictions_for_execution(predictions(spark, sf_dir), "taiwan_credit", OLDER)
    return found.select("model_type", "technique", "seed", "target", "prediction")


@query(
    "latest_predictions",
    over(
        SQL_PREDICTIONS,
        f"select {RUNS}, target, prediction from raw where dataset = 'lending_club'"
        " and execution_id = (select max(execution_id) from raw where dataset = 'lending_club')",
    ),
)
def _(spark, sf_dir):
    return P.latest_predictions(predictions(spark, sf_dir), "lending_club").select(*P.RUN_KEYS, "target", "prediction")


@query(
    "store_for_execution",
    over(SQL_PREDICTIONS, f"select {RUNS}, target, prediction, '0190-none' as missing from raw where execution_id = '{OLDER}' and dataset = 'taiwan_credit'"),
)
def _(spark, sf_dir):
    # From the partitions of one execution; an execution without any raises.
    store = stored_predictions(spark, sf_dir)
    try:
        store.for_execution("taiwan_credit", "0190-none")
        missing = None
    except P.ExecutionNotFound:
        missing = "0190-none"
    return store.for_execution("taiwan_credit", OLDER).withColumn("missing", F.lit(missing))


@query(
    "store_latest",
    over(
        SQL_PREDICTIONS,
        f"select {RUNS}, target, prediction from raw where dataset = 'lending_club'"
        " and execution_id = (select max(execution_id) from raw where dataset = 'lending_club')",
    ),
)
def _(spark, sf_dir):
    return stored_predictions(spark, sf_dir).latest("lending_club").select(*P.RUN_KEYS, "target", "prediction")


@query("read_legacy", over(SQL_PREDICTIONS, f"select {RUNS}, target, prediction, count(*) as n from raw where dataset = 'taiwan_credit' group by all"))
def _(spark, sf_dir):
    # One file a run, with the keys in its path and nowhere else.
    root = scratch_path(spark, "legacy")
    found = predictions(spark, sf_dir).where("dataset = 'taiwan_credit'").persist()

    def write(row):
        run = found.where(" and ".join(f"{k} = '{row[k]}'" for k in P.RUN_KEYS)).select("target", "prediction")
        path = f"{root}/predictions/{row.execution_id}/{row.dataset}/{row.model_type}/{row.technique}/seed_{row.seed}.parquet"
        run.coalesce(1).write.parquet(path)

    with ThreadPool(8) as pool:
        pool.map(write, found.select(*P.RUN_KEYS).distinct().collect())
    found.unpersist()
    stored = P.read_legacy(spark, root)
    return stored.groupBy(*P.RUN_KEYS, "target", "prediction").agg(F.count("*").alias("n"))


@query(
    "latest_execution_id",
    over(SQL_PREDICTIONS, "select max(execution_id) as execution_id from raw where dataset in ('taiwan_credit', 'test')"),
)
def _(spark, sf_dir):
    return P.latest_execution_id(predictions(spark, sf_dir), ["taiwan_credit", "test"])


GRID_SQL = """grid as (select * from (values ('lending_club'), ('taiwan_credit'), ('corporate_credit_rating')) d(dataset),
    (values ('random_forest'), ('svm'), ('xgboost'), ('mlp')) m(model_type),
    (values ('baseline'), ('smote'), ('random_under_sampling'), ('smote_tomek'), ('cs_svm')) t(technique),
    (select cast(unnest(range(1, 8)) as int) as seed)
    where technique <> 'cs_svm' or model_type = 'svm')"""
SOURCES = ["lending_club", "taiwan_credit", "corporate_credit_rating"]


@query(
    "combination_grid",
    over(SQL_PREDICTIONS, f", {GRID_SQL}, done as (select dataset, model_type, technique, seed, count(*) as n from raw group by all)"
    " select dataset, model_type, technique, seed, coalesce(n, 0) as n from grid left join done using (dataset, model_type, technique, seed)"),
)
def _(spark, sf_dir):
    keys = ["dataset", "model_type", "technique", "seed"]
    counts = predictions(spark, sf_dir).groupBy(*keys).agg(F.count("*").alias("n"))
    grid = combination_grid(spark, SOURCES, 7)
    return grid.join(counts, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "pending_combinations",
    over(SQL_PREDICTIONS, f", {GRID_SQL} select * from grid except select dataset, model_type, technique, seed from raw where execution_id = '{NEWEST}'"),
)
def _(spark, sf_dir):
    completed = completed_combinations(predictions(spark, sf_dir), NEWEST)
    return pending_combinations(combination_grid(spark, SOURCES, 7), completed)


@query(
    "execution_complete",
    over(
        SQL_PREDICTIONS,
        f", {GRID_SQL} select execution_id, not exists (select * from grid except select r.dataset, r.model_type, r.technique, r.seed"
        " from raw r where r.execution_id = e.execution_id) as complete from (select distinct execution_id from raw) e",
    ),
)
def _(spark, sf_dir):
    return executions_complete(combination_grid(spark, SOURCES, 7), predictions(spark, sf_dir))


@query(
    "resume_execution",
    over(
        SQL_PREDICTIONS,
        f", newest as (select max(execution_id) as execution_id from raw where dataset = 'lending_club')"
        " select execution_id, 'resumed_incomplete' as status, (select count(*) from (select distinct dataset, model_type, technique, seed"
        " from raw r where r.execution_id = newest.execution_id)) as completed from newest",
    ),
)
def _(spark, sf_dir):
    chosen = resume_execution(predictions(spark, sf_dir), ["lending_club"], 7)
    return spark.range(1).select(
        F.lit(chosen.execution_id).alias("execution_id"),
        F.lit(chosen.status).alias("status"),
        F.lit(chosen.completed).cast("bigint").alias("completed"),
    )
