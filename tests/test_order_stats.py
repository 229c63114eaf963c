import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballast.operators import order_stats as O
from ballast.operators.prepare import fit_preparation, median_impute, standard_scale
from ballast.operators.splitting import stratified_kfold, stratified_split


def order(seed, i):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        hot = 5.0 if i % 3 == 0 else rng.gauss(0, 1)  # one value in a third of the rows
        wide = rng.choice([-1, 1]) * 10 ** rng.uniform(-12, 12)
        gap = None if i % 7 == 0 else (float("nan") if i % 11 == 0 else float(rng.randrange(50)))
        rows.append((i, hot, wide, gap, None))
    df = spark.createDataFrame(rows, "row_id long, hot double, wide double, gap double, empty double").repartition(6)
    return df.persist(), rows


def test_quantiles_match_numpy(numbers):
    df, rows = numbers
    got = O.order_statistics(df, ["hot", "wide", "gap", "empty"], [0.1, 0.5, 0.77])
    for j, c in enumerate(["hot", "wide", "gap"], start=1):
        values = np.array([r[j] for r in rows if r[j] is not None and not math.isnan(r[j])])
        assert got[c] == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.77])), rel=1e-12), c
    assert got["empty"] == [None, None, None]


def test_nearest_rank(numbers):
    df, rows = numbers
    values = sorted(r[2] for r in rows)
    got = O.order_statistics(df, ["wide"], [0.25, 0.75], interpolation="nearest")["wide"]
    assert got == [values[math.floor(0.25 * 2999 + 0.5)], values[math.floor(0.75 * 2999 + 0.5)]]


def test_extreme_ends(spark):
    df = spark.createDataFrame([(-1.7e308,), (1.7e308,), (0.0,), (5e-324,)], "v double")
    assert O.order_statistics(df, ["v"], [0.0, 1.0])["v"] == [-1.7e308, 1.7e308]
    assert O.order_statistics(df, ["v"], [1 / 3], interpolation="nearest")["v"] == [0.0]


def test_infinities_stay_out_of_the_search(spark):
    inf = float("inf")
    rows = [(float(i),) for i in range(200)] + [(-inf,)] * 3 + [(inf,)] * 2 + [(float("nan"),), (None,)]
    df = spark.createDataFrame(rows, "v double")
    got = O.order_statistics(df, ["v"], [0.0, 0.01, 0.5, 1.0], interpolation="nearest")["v"]
    assert got == [-inf, -inf, 99.0, inf]
    assert O.order_statistics(df.where("v = double('inf')"), ["v"], [0.5])["v"] == [inf]


@pytest.mark.parametrize("copies", [20_000, 700])
def test_repeated_ids_raise(spark, copies):
    df = spark.range(2 * copies).select((F.col("id") % 2).alias("row_id"), F.lit(1).alias("g"))
    digest = F.md5(F.concat(F.lit("9:"), F.col("row_id").cast("string")))
    with pytest.raises(ValueError, match="unique"):
        O.hash_thresholds(df, "g", digest, {1: [copies // 2]})


def test_many_classes_are_split(spark):
    df = spark.range(150 * 10).select(F.col("id").alias("row_id"), (F.col("id") % 150).alias("target"))
    assert stratified_split(df, 3).where("split = 'test'").count() == 150 * 3


@pytest.mark.parametrize("fetch", [4096, 1])
def test_hash_thresholds(spark, monkeypatch, fetch):
    monkeypatch.setattr(O, "FETCH", fetch)
    monkeypatch.setattr(O, "PREFIX", 1)
    df = spark.range(1200).select(F.col("id"), (F.col("id") % 3).alias("g"))
    digest = F.md5(F.concat(F.lit("9:"), F.col("id").cast("string")))
    want = {g: [1, 7, 200, 400] for g in range(3)}
    got = O.hash_thresholds(df, "g", digest, want)
    for g in range(3):
        digests = sorted(order(9, i) for i in range(1200) if i % 3 == g)
        assert got[g] == {r: digests[r - 1] for r in want[g]}
    with pytest.raises(ValueError):
        O.hash_thresholds(df, "g", digest, {0: [401]})


def labelled(spark, minority, majority):
    return spark.range(minority + majority).select(
        F.col("id").alias("row_id"), (F.col("id") < minority).cast("int").alias("target")
    )


def test_split_sizes_and_reproducibility(spark):
    df = labelled(spark, 41, 160)
    first = stratified_split(df, 5)
    sizes = {(r.target, r.split): r["count"] for r in first.groupBy("target", "split").count().collect()}
    assert sizes == {(1, "test"): 12, (1, "train"): 29, (0, "test"): 48, (0, "train"): 112}
    again = {(r.row_id, r.split) for r in stratified_split(df.repartition(13), 5).select("row_id", "split").collect()}
    assert again == {(r.row_id, r.split) for r in first.select("row_id", "split").collect()}
    other = {(r.row_id, r.split) for r in stratified_split(df, 6).select("row_id", "split").collect()}
    assert other != again


def test_split_errors(spark):
    with pytest.raises(ValueError, match="at least 2 rows"):
        stratified_split(labelled(spark, 1, 30), 1)
    with pytest.raises(ValueError, match="folds|2 classes"):
        stratified_split(labelled(spark, 3, 30), 1)
    with pytest.raises(ValueError, match="folds"):
        stratified_split(labelled(spark, 6, 30), 1)


def test_missing_targets_raise(spark):
    df = labelled(spark, 10, 30).withColumn("target", F.when(F.col("row_id") != 3, F.col("target")))
    with pytest.raises(ValueError, match="missing"):
        stratified_split(df, 1)


def test_kfold_is_even_and_disjoint(spark):
    df = stratified_kfold(labelled(spark, 23, 104), 2)
    for target, n in ((1, 23), (0, 104)):
        sizes = sorted(r["count"] for r in df.where(F.col("target") == target).groupBy("fold").count().collect())
        assert sum(sizes) == n and len(sizes) == 5 and sizes[-1] - sizes[0] <= 1
    assert stratified_kfold(labelled(spark, 3, 40), 2).agg(F.max("fold")).first()[0] == 2


def test_preparation(numbers):
    df, rows = numbers
    got = fit_preparation(df, ["hot", "gap", "empty"])
    gap = np.array([np.nan if r[3] is None else r[3] for r in rows])
    middle = np.nanmedian(gap)
    filled = np.where(np.isnan(gap), middle, gap)
    assert got.medians[1:] == (middle, 0.0)
    assert got.means[1] == pytest.approx(filled.mean()) and got.deviations[1] == pytest.approx(filled.std())
    scaled = got.scale(got.impute(df)).agg(F.avg("gap"), F.stddev_pop("gap"), F.max(F.abs("empty"))).first()
    assert scaled[0] == pytest.approx(0, abs=1e-9) and scaled[1] == pytest.approx(1) and scaled[2] == 0
    by_sql = df.sparkSession.sql(got.sql().replace("__THIS__", "{t}"), t=df)
    assert by_sql.agg(F.stddev_pop("gap__prepared")).first()[0] == pytest.approx(1)


def test_impute_middle_of_two(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,), (float("nan"),)], "v double")
    assert sorted(r.v for r in median_impute(df, ["v"]).collect()) == [1.0, 2.0, 2.0, 3.0]
    scaled = standard_scale(df, ["v"]).where("v is not null and not isnan(v)").collect()
    assert sorted(r.v for r in scaled) == [-1.0, 1.0]
