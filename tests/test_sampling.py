import numpy as np
import pytest
from pyspark.sql import functions as F

from ballast.operators import sampling as S
from ballast.operators import skew as K
from ballast.operators.knn import Layout, knn_join, ranked


def points(spark, minority, majority, dims=3, seed=0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 1, (minority, dims)), rng.normal(1, 1, (majority, dims))])
    rows = [(i, a.tolist(), int(i < minority)) for i, a in enumerate(x)]
    return spark.createDataFrame(rows, "row_id long, x array<double>, target int").persist(), x


def test_weights(spark):
    df, _ = points(spark, 10, 30)
    got = S.class_weights(df, "balanced").groupBy("target").agg(F.min("weight"), F.max("weight")).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {1: (2.0, 2.0), 0: (40 / 60, 40 / 60)}
    got = S.class_weights(df, {0: 1, 1: 5}).groupBy("target").agg(F.max("weight")).collect()
    assert {r[0]: r[1] for r in got} == {1: 5.0, 0: 1.0}
    assert S.class_weights(df, None).agg(F.sum("weight")).first()[0] == 40


def test_under_sampling(spark):
    df, _ = points(spark, 12, 50)
    got = S.random_under_sample(df, 3)
    assert {r.target: r["count"] for r in got.groupBy("target").count().collect()} == {0: 12, 1: 12}
    ids = {r.row_id for r in got.collect()}
    assert ids == {r.row_id for r in S.random_under_sample(df.repartition(7), 3).collect()}
    assert set(range(12)) <= ids and ids != {r.row_id for r in S.random_under_sample(df, 4).collect()}


def test_synthetic_rows_lie_on_segments_to_neighbours(spark):
    df, x = points(spark, 14, 90)
    filled = S.smote(df, 5, k=3)
    assert {r.target: r["count"] for r in filled.groupBy("target").count().collect()} == {0: 90, 1: 90}
    near = {}
    for r in knn_join(df.where("target = 1"), 3).collect():
        near.setdefault(r.row_id, set()).add(r.neighbor_id)
    made = S.smote_samples(df.where("target = 1"), 76, 5, 3).collect()
    per_base = {}
    for r in made:
        per_base[r.base_id] = per_base.get(r.base_id, 0) + 1
        assert r.neighbor_id in near[r.base_id] and 0 <= r.fraction < 1
        assert np.allclose(r.x, x[r.base_id] + r.fraction * (x[r.neighbor_id] - x[r.base_id]))
    assert len(made) == 76 and set(per_base.values()) == {5, 6} and len(per_base) == 14
    again = S.smote_samples(df.where("target = 1").repartition(9), 76, 5, 3).collect()
    assert sorted((r.base_id, r.copy, r.neighbor_id, r.fraction) for r in again) == sorted(
        (r.base_id, r.copy, r.neighbor_id, r.fraction) for r in made
    )


def test_many_copies_are_made_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 10)
    df, _ = points(spark, 5, 0)
    made = S.smote_samples(df, 5 * 37 + 2, 1, 3)
    counts = {r.base_id: r["count"] for r in made.groupBy("base_id").count().collect()}
    assert sorted(counts.values()) == [37, 37, 37, 38, 38]
    assert made.select("base_id", "copy").distinct().count() == 5 * 37 + 2


def test_few_new_points_need_no_base_from_every_row(spark):
    df, _ = points(spark, 9, 0)
    assert S.smote_samples(df, 4, 1, 2).count() == 4


def test_too_few_rows_raise(spark):
    df, _ = points(spark, 3, 20)
    with pytest.raises(ValueError, match="more than 3 rows"):
        S.smote(df, 1, k=3)


@pytest.mark.parametrize("remove", ["both", "majority"])
def test_link_cleaning(spark, remove):
    rows = [(1, [0.0], 1), (2, [0.1], 0), (3, [5.0], 0), (4, [5.1], 0), (5, [9.0], 1), (6, [9.3], 1), (7, [20.0], 0), (8, [20.1], 0)]
    df = spark.createDataFrame(rows, "row_id long, x array<double>, target int")
    left = {r.row_id for r in S.clean_tomek(df, remove).collect()}
    assert left == ({3, 4, 5, 6, 7, 8} if remove == "both" else {1, 3, 4, 5, 6, 7, 8})


def test_smote_tomek_removes_pairs(spark):
    df, _ = points(spark, 20, 60, dims=2, seed=8)
    filled, cleaned = S.smote(df, 2), S.smote_tomek(df, 2)
    removed = filled.join(cleaned, "row_id", "left_anti").groupBy("target").count().collect()
    counts = {r.target: r["count"] for r in removed}
    assert counts[0] == counts[1] > 0


CASES = {"two classes": (25, 160, 0), "three classes": (20, 110, 35), "two largest classes": (20, 90, 90), "balanced": (60, 60, 0)}


@pytest.mark.parametrize(
    "case, copies, block_rows",
    [("two classes", True, 32), ("three classes", False, 64), ("three classes", True, 4096), ("two largest classes", True, 4096), ("balanced", False, 4096)],
)
def test_smote_tomek_equals_a_search_of_all_rows(spark, case, copies, block_rows):
    rng = np.random.default_rng(3)
    labels = np.repeat([1, 0, 2], CASES[case])
    x = rng.normal(labels[:, None] * 0.4, 1, (len(labels), 2))
    if copies:
        x = np.round(x * 2) / 2  # equal vectors within and across classes, equal distances
    rows = [(i, a.tolist(), int(y)) for i, (a, y) in enumerate(zip(x, labels))]
    df = spark.createDataFrame(rows, "row_id long, x array<double>, target int").persist()
    filled = S.smote(df, 4)
    everything = {r.row_id for r in S.clean_tomek(filled).collect()}
    got = S.smote_tomek(df, 4, block_rows=block_rows).collect()
    assert {r.row_id for r in got} == everything and len(got) == len(everything) < filled.count()
    assert got[0].asDict().keys() == {"row_id", "x", "target", "synthetic"}


def test_only_rows_of_filled_classes_and_those_they_name_search(spark, monkeypatch):
    asked = []
    nearest_within = Layout.nearest_within
    monkeypatch.setattr(Layout, "nearest_within", lambda self, rows: asked.append(rows.count()) or nearest_within(self, rows))
    df, _ = points(spark, 40, 400, dims=2, seed=1)
    searches = []
    monkeypatch.setattr(S, "knn_join", lambda p, *a, **k: searches.append(p.count()) or knn_join(p, *a, **k))
    monkeypatch.setattr(S, "tomek_links", None)
    S.smote_tomek(df, 2, block_rows=32).count()
    assert searches == [40] and asked[0] == 400 and 0 < asked[1] < 200


@pytest.mark.parametrize("max_pivots", [3, 2048])
def test_bounded_search_equals_the_full_one(spark, max_pivots):
    df, _ = points(spark, 200, 500, seed=6)
    full = {(r.row_id, r["rank"]): (r.neighbor_id, r.distance) for r in knn_join(df, 2, block_rows=20).collect()}
    reach = [(i, full[i, 2][1] * (1 + 0.1 * (i % 3))) for i in range(0, 700, 3)] + [(1, None), (2, float("nan"))]
    layout = Layout(df, 2, "row_id", "x", 20, max_pivots)
    got = ranked(layout.nearest_within(spark.createDataFrame(reach, "row_id long, reach double")), 2).collect()
    assert {(r.row_id, r["rank"]): (r.neighbor_id, r.distance) for r in got} == {(i, k): full[i, k] for i, _ in reach for k in (1, 2)}
    assert len(got) == 2 * len(reach)


@pytest.mark.parametrize("floor", [0, 10**9])
def test_join_of_a_hot_key(spark, monkeypatch, floor):
    monkeypatch.setattr(K, "HOT_FLOOR", floor)
    left = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    right = spark.range(901).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = K.join_unique(left, right, "k")
    assert got.count() == 900 and got.where("v <> k * 2").count() == 0
