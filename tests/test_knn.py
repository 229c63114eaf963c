import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballast.operators import knn as K
from ballast.operators.knn import knn_join, tomek_links


def brute_force(ids, x, k):
    out = {}
    for i, a in enumerate(x):
        d = np.sqrt(((x - a) ** 2).sum(axis=1))
        order = sorted((d[j], ids[j]) for j in range(len(x)) if j != i)[:k]
        out[ids[i]] = order
    return out


def check(spark, ids, x, k, block_rows, **options):
    table = spark.createDataFrame([(i, [float(v) for v in a]) for i, a in zip(ids, x)], ["row_id", "x"])
    got = {}
    for r in knn_join(table, k, block_rows=block_rows, **options).orderBy("row_id", "rank").collect():
        got.setdefault(r.row_id, []).append((r.distance, r.neighbor_id))
    want = brute_force(ids, x, k)
    assert set(got) == set(want)
    for i in want:
        assert [n for _, n in got[i]] == [n for _, n in want[i]], i
        assert np.allclose([d for d, _ in got[i]], [d for d, _ in want[i]], atol=1e-9)


@pytest.mark.parametrize("block_rows", [10_000, 40])
def test_matches_brute_force(spark, block_rows):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, (60, 4)) for c in (0.0, 3.0, 9.0)] + [rng.uniform(-5, 12, (40, 4))])
    check(spark, [int(i) * 3 + 1 for i in rng.permutation(len(x))], x, 3, block_rows)


@pytest.mark.parametrize("block_rows", [10_000, 25])
def test_copies_and_ties(spark, block_rows):
    rng = np.random.default_rng(2)
    grid = rng.integers(0, 4, (120, 3)).astype(float)  # many equal distances
    copies = np.tile([[1.0, 2.0, 3.0]], (90, 1))  # one vector in two fifths of the rows
    x = np.concatenate([grid, copies])
    check(spark, [int(i) for i in rng.permutation(len(x))], x, 4, block_rows)


@pytest.mark.parametrize("shape", ["clusters", "no structure", "ties"])
def test_two_levels_of_pivots(spark, shape):
    rng = np.random.default_rng(9)
    if shape == "clusters":
        x = np.concatenate([rng.normal(c, 0.2, (70, 3)) for c in (0.0, 4.0, 9.0)] + [rng.uniform(-2, 11, (30, 3))])
    elif shape == "no structure":
        x = rng.normal(size=(200, 64))
    else:
        x = np.concatenate([rng.integers(0, 4, (150, 3)).astype(float), np.tile([[1.0, 2.0, 3.0]], (60, 1))])
    check(spark, [int(i) for i in rng.permutation(len(x))], x, 3, 8, max_pivots=3)


@pytest.mark.parametrize("max_pivots", [2048, 4])
def test_trips_do_not_grow_with_the_number_of_blocks(spark, max_pivots):
    """Without structure every block may hold a neighbour, but a row is sent once to each shelf."""
    import ballast.operators.knn as knn

    x = np.random.default_rng(10).normal(size=(600, 64))
    table = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "row_id long, x array<double>")
    cells = knn.Layout(table, 3, "row_id", "x", 8, max_pivots).cells
    assert cells.groups >= 75
    askers = cells.vectors.select("rep", "x", "cell", "fine", "block", F.lit(np.inf).alias("reach"))
    trips = knn.with_trips(askers, cells).agg(F.sum(F.size("shelves"))).first()[0]
    assert 600 <= trips <= 600 * 8


@pytest.mark.parametrize("shape", ["many shelves", "copies"])
def test_rows_on_many_shelves(spark, monkeypatch, shape):
    import ballast.operators.knn as knn

    monkeypatch.setattr(knn, "SHELF_ROWS", 25)
    monkeypatch.setattr(knn, "LEAF_ROWS", 6)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(220, 3))
    if shape == "copies":
        x = np.concatenate([rng.integers(0, 4, (160, 3)).astype(float), np.tile([[1.0, 2.0, 3.0]], (60, 1))])
    for max_pivots in (2048, 3):
        check(spark, [int(i) for i in rng.permutation(len(x))], x, 3, 8, max_pivots=max_pivots)


def test_far_from_the_origin(spark):
    rng = np.random.default_rng(3)
    check(spark, list(range(150)), 1e6 + rng.normal(0, 1e-3, (150, 5)), 2, 30)


def test_fewer_rows_than_k(spark):
    table = spark.createDataFrame([(1, [0.0]), (2, [1.0])], ["row_id", "x"])
    assert sorted(map(tuple, knn_join(table, 3).collect())) == [(1, 1, 2, 1.0), (2, 1, 1, 1.0)]


def test_missing_values_raise(spark):
    rows = [(i, [float(i), None if i == 7 else 1.0]) for i in range(30)]
    with pytest.raises(Exception, match="missing or infinite"):
        knn_join(spark.createDataFrame(rows, "row_id long, x array<double>"), 2).collect()


def test_text_ids(spark):
    rng = np.random.default_rng(4)
    check(spark, [f"r{i:03d}" for i in range(80)], rng.normal(size=(80, 2)), 2, 20)


def test_hot_copies_are_broadcast(spark, monkeypatch):
    import ballast.operators.knn as knn

    monkeypatch.setattr(knn, "HOT_FLOOR", 0)
    x = np.concatenate([np.zeros((50, 2)), np.random.default_rng(5).normal(size=(60, 2))])
    check(spark, list(range(110)), x, 3, 1000)


@pytest.mark.parametrize("block_rows", [1000, 20])
def test_tomek_links(spark, block_rows):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 2))
    y = (rng.random(120) < 0.4).astype(int)
    near = {i: n[0][1] for i, n in brute_force(list(range(120)), x, 1).items()}
    want = {(i, j) for i, j in near.items() if i < j and near[j] == i and y[i] != y[j]}
    table = spark.createDataFrame(
        [(i, x[i].tolist(), int(y[i])) for i in range(120)], "row_id long, x array<double>, target int"
    )
    got = {(r.low_id, r.high_id) for r in tomek_links(table, block_rows=block_rows).collect()}
    assert got == want and want


def test_tasks_need_no_package_on_executors(tmp_path):
    """From another working directory the workers cannot import this package."""
    script = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import functions as F
from ballast.operators.knn import knn_join
from ballast.session import build_session
spark = build_session("apart", "local[2]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"})
points = spark.range(60).select(F.col("id").alias("row_id"), F.array((F.col("id") * F.col("id")).cast("double")).alias("x"))
assert knn_join(points, 2, block_rows=15).count() == 120
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", script, root], cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]


def test_cells_are_looked_at_in_small_matrices_and_none_within_reach_is_lost():
    import pyarrow as pa

    from ballast.operators import knn

    batch = pa.RecordBatch.from_pydict({"v": list(range(2000))})
    parts = list(knn.pieces([batch], 2048))
    assert sum(p.num_rows for p in parts) == 2000
    assert max(p.num_rows for p in parts) * 2048 <= 1 << 18  # 2 MB of distances, not 8
    rng = np.random.default_rng(3)
    for width in (2, 24):
        x = rng.normal(size=(900, width)) * 5
        pivots = x[:60]
        apart = np.sqrt(((x[:, None] - pivots[None]) ** 2).sum(axis=2))
        cell = knn.nearest_of(x, pivots)
        assert (cell == apart.argmin(axis=1)).all()
        own = apart[np.arange(len(x)), cell]
        rows = np.bincount(cell, minlength=60)
        low, high = (np.array([f(own[cell == c]) for c in range(60)]) for f in (np.min, np.max))
        between = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        reach = np.sort(between, axis=1)[:, 4]
        reach[:3] = np.inf, 0.0, reach[2]
        found = knn.Geometry(pivots, rows, low, high).reached(x, reach, cell)
        needed = np.zeros_like(found)
        asker, host = np.nonzero(between <= reach[:, None])
        needed[asker, cell[host]] = True
        assert not (needed & ~found).any()
        assert found[0].all()
        if width == 2:
            assert found[1:].mean() < 0.5


@pytest.mark.parametrize("sent", [0, 100])
def test_only_repeated_vectors_are_shuffled_to_be_collapsed(spark, monkeypatch, sent):
    monkeypatch.setattr(K, "SENT_KEYS", sent)
    x = [[float(i), 1.0] for i in range(20)] + [[3.0, 1.0]] * 3 + [None, None]
    rows = spark.createDataFrame(list(enumerate(x)), "id int, x array<double>").withColumn("h", F.xxhash64("x"))
    got = {tuple(r.x or ()): r.ids for r in K.collapsed(rows, 2).collect()}
    assert got == {(float(i), 1.0): [i] for i in range(20) if i != 3} | {(3.0, 1.0): [3, 20], (): [23, 24]}
    unique = K.collapsed(rows.where("id < 20"), 2)
    assert sorted(r.ids for r in unique.collect()) == [[i] for i in range(20)]
    assert "Window" not in unique._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("sent", [0, 1000])
def test_rows_asked_are_sent_to_the_vectors(spark, monkeypatch, sent):
    monkeypatch.setattr(K, "SENT_KEYS", sent)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(150, 3)), np.tile([[1.0, 2.0, 3.0]], (5, 1))])
    points = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "row_id int, x array<double>")
    asked = spark.createDataFrame([(i, None if i % 2 else 50.0) for i in range(0, 155, 5)], "row_id int, reach double")
    found = K.ranked(K.Layout(points, 1, "row_id", "x", 20).nearest_within(asked), 1)
    want = brute_force(list(range(len(x))), x, 1)
    assert {r.row_id: r.neighbor_id for r in found.collect()} == {i: want[i][0][1] for i in range(0, 155, 5)}
