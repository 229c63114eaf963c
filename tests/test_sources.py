import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballast.sources import predictions as P
from ballast.sources import tables as S
from ballast.sources.models import ModelStore, ModelNotFound, latest_model, new_id

RUN = dict(execution_id="e1", dataset="taiwan_credit", model_type="svm", technique="smote", seed=1)


def some(spark, n=4):
    return spark.range(n).select((F.col("id") % 2).cast("int").alias("target"), F.lit(1).alias("prediction"))


def test_store_and_catalogue(spark, tmp_path):
    store = P.PredictionStore(spark, str(tmp_path))
    assert store.read().count() == 0 and store.runs().count() == 0
    store.save(some(spark), **RUN)
    store.save(some(spark, 6), **{**RUN, "seed": 2})
    store.save(some(spark, 3), **{**RUN, "execution_id": "e2", "dataset": "lending_club"})
    store.save(some(spark), **RUN)  # a repeated run replaces itself
    store.save(some(spark), **{**RUN, "technique": "unheard_of"})
    assert store.read().count() == 17
    assert {(r.execution_id, r.dataset, r.seed) for r in store.runs().collect()} == {
        ("e1", "taiwan_credit", 1), ("e1", "taiwan_credit", 2), ("e2", "lending_club", 1),
    }
    assert store.completed("e1").count() == 2
    assert store.for_execution("taiwan_credit", "e1").where("technique = 'smote'").count() == 10
    assert store.for_execution("lending_club", "e1").count() == 0
    with pytest.raises(P.ExecutionNotFound):
        store.for_execution("lending_club", "e9")
    assert P.latest_execution_id(store.read()).first()[0] == "e2"
    assert P.latest_execution_id(store.read(), ["taiwan_credit"]).first()[0] == "e1"
    assert P.latest_execution_id(store.read(), ["test"]).first()[0] is None
    assert P.latest_predictions(store.read(), "lending_club").count() == store.latest("lending_club").count() == 3
    assert store.latest("taiwan_credit").count() == 14 and store.latest("test").count() == 0


def test_execution_filter_prunes_partitions(spark, tmp_path):
    store = P.PredictionStore(spark, str(tmp_path))
    store.save(some(spark), **RUN)
    plan = store.for_execution("taiwan_credit", "e1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "execution_id" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_legacy_paths(spark, tmp_path):
    root = tmp_path / "predictions" / "e1" / "lending_club" / "mlp" / "baseline"
    some(spark).coalesce(1).write.parquet(str(root / "seed_12.parquet"))
    paths = spark.createDataFrame(
        [("file:/a/predictions/e1/lending_club/mlp/baseline/seed_12.parquet",), ("file:/a/predictions/e1/x.parquet",)], "p string"
    )
    got = paths.select(*[c.alias(k) for k, c in P.parse_path(F.col("p")).items()]).collect()
    assert tuple(got[0]) == ("e1", "lending_club", "mlp", "baseline", 12) and set(got[1]) == {None}


def test_csv_overrides_keep_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,n,v\n007,1,1.5\n008,2,2.5\n")
    df = S.csv_with_overrides(spark, str(tmp_path / "a.csv"), {"id": "string"})
    assert [f.dataType for f in df.schema] == [T.StringType(), T.IntegerType(), T.DoubleType()]
    assert [r.id for r in df.orderBy("id").collect()] == ["007", "008"]


def test_tolerant_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\nTotal,1\n2,zz\n3,4.5\n")
    df = S.csv_tolerant(spark, str(tmp_path / "a.csv"), T.StructType.fromDDL("id string, v double"), "Total")
    assert [tuple(r) for r in df.collect()] == [(None, 1.0), ("2", None), ("3", 4.5)]


def test_lines_with_problems_are_told_apart(spark, tmp_path):
    lines = ["a,b,c", "1,2.5,x", "2,zz,y", "3", '4,"1,5",q', "5,1.0,x,more", '6,2.0,"a,b"', ",,"]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    schema = T.StructType.fromDDL("a int, b double, c string")
    good, bad, counts = S.csv_quarantine(spark, str(tmp_path / "a.csv"), schema, "none")
    assert sorted((r.a or 0, r.c or "") for r in good.collect()) == [(0, ""), (1, "x"), (6, "a,b")]
    assert {r.a: r.problem for r in bad.collect()} == {2: "unparsable", 3: "short", 4: "unparsable", 5: "long"}
    assert {r.problem: r.n for r in counts.collect()} == {"good": 3, "unparsable": 2, "short": 1, "long": 1}


def test_final_tables_have_unique_ids(spark, tmp_path):
    repository = S.DataRepository(spark, str(tmp_path))
    fine = spark.createDataFrame([(1, 0.5, 0), (2, 1.5, 1)], "row_id long, v double, target int")
    repository.save_final("test", fine)
    with pytest.raises(ValueError, match="occurs 2 times"):
        repository.save_final("test", fine.unionByName(fine))
    assert repository.is_processed("test") and S.scan_parquet(spark, repository.final_path("test")).count() == 2
    repository.save_final("test", fine.limit(1))
    assert S.scan_parquet(spark, repository.final_path("test")).count() == 1


def test_processing_skips_what_is_done_and_reports_failures(spark, tmp_path):
    repository = S.DataRepository(spark, str(tmp_path))
    header = "ID,LIMIT_BAL,SEX,EDUCATION,MARRIAGE,AGE,PAY_0,BILL_AMT1,PAY_AMT1,default.payment.next.month"
    lines = [f"{i},1e+05,{1 + i % 2},{1 + i % 4},{1 + i % 3},30,{i % 5 - 2},5,6,{i % 2}" for i in range(20)]
    raw = tmp_path / "data" / "raw"
    raw.mkdir(parents=True)
    (raw / "test.csv").write_text("\n".join([header, *lines]))
    failures = S.process_datasets(repository, ["test", "lending_club", "nonsense"])
    assert [d for d, _ in failures] == ["lending_club", "nonsense"]
    assert repository.is_processed("test") and not repository.is_processed("lending_club")
    assert repository.training_data("test") is repository.training_data("test")
    assert repository.training_data("test").count() == 20
    repository.release()
    assert repository.size_in_bytes("test").first()[0] == (raw / "test.csv").stat().st_size
    (raw / "test.csv").unlink()
    assert S.process_datasets(repository, ["test"]) == []
    assert [d for d, _ in S.process_datasets(repository, ["test"], overwrite=True)] == ["test"]
    with pytest.raises(ValueError, match="no training data"):
        repository.training_data("lending_club")


def test_ids_sort_by_time():
    ids = []
    for _ in range(3):
        ids.append(new_id())
        __import__("time").sleep(0.002)
    assert ids == sorted(ids) and all(i[14] == "7" and i[19] in "89ab" for i in ids)


def test_latest_is_by_creation(spark, tmp_path):
    rows = [("b", "2024-01-02"), ("a", "2024-01-03"), ("c", "2024-01-01")]
    df = spark.createDataFrame(rows, "id string, t string").select("id", F.to_timestamp("t").alias("created_at"))
    assert latest_model(df).first().id == "a"
    with pytest.raises(ModelNotFound):
        ModelStore(spark, str(tmp_path)).latest("test")


def test_parameters_keep_the_types_of_their_keys():
    from ballast.sources.models import read_params, write_params

    params = {"weight": {0: 1, 1: 5}, "depths": [1, None, {"a": {2: 3}}], "name": "svm"}
    assert read_params(write_params(params)) == params


def test_weights_of_unknown_classes_raise(spark):
    import pytest

    from ballast.operators.sampling import weight_expression

    for rule in ({"0": 1, "1": 5}, {0: 1, 2: 5}):
        with pytest.raises(ValueError, match="classes"):
            weight_expression({0: 10, 1: 2}, rule)
