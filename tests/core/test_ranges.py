"""Keyframes, quantiles and nearest neighbours by ranges, against plain versions."""

from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geoframe.operators import keyframes, matching, neighbors, pivots, ranges, selection, spatial
from geoframe.operators.frames import pick_keyframes

FRAMES = "video string, f long, sharpness double, displacement_to_next double"


def scan(rows, least, window):
    """Picks of each video, frame by frame, in whole units of motion."""
    by, out = defaultdict(list), set()
    for v, f, s, d in rows:
        by[v].append((f, s, d))
    for v, r in by.items():
        r.sort(key=lambda x: x[0])
        moved = np.round(np.array([x[2] for x in r]) * keyframes.UNIT)
        out |= {(v, r[p][0], i) for i, p in enumerate(pick_keyframes(np.array([x[1] for x in r]), moved, round(least * keyframes.UNIT), window))}
    return out


@pytest.mark.parametrize(
    ("sizes", "least", "window", "rows", "still"),
    [([1500], 3.0, 5, 100, 0), ([700, 3, 1, 900, 2], 2.5, 5, 64, 0.5), ([40] * 12, 1.0, 9, 7, 0.3), ([300], 0.0, 3, 50, 0), ([900], 50.0, 5, 90, 0.9), ([400], 1e9, 5, 90, 0.2)],
    ids=["one long", "mixed", "ranges shorter than the window", "no least motion", "still", "one pick"],
)
def test_keyframes_equal_the_scan(spark, sizes, least, window, rows, still):
    dice = np.random.default_rng(len(sizes) + window)
    table = [(f"v{i}" if i else None, j, float(dice.integers(0, 6)), float(round(dice.random(), 3)) * (dice.random() > still)) for i, n in enumerate(sizes) for j in range(n)]
    got = keyframes.select_keyframes(spark.createDataFrame(table, FRAMES).repartition(5), "video", "f", least, window, rows).collect()
    assert {tuple(r) for r in got} == scan(table, least, window) and len({tuple(r) for r in got}) == len(got)


def test_keyframes_of_nulls_and_of_nothing(spark):
    assert keyframes.select_keyframes(spark.createDataFrame([], FRAMES), "video", "f", 1.0).collect() == []
    table = spark.createDataFrame([("a", 0, None, 1.0), ("a", 1, float("nan"), None), ("a", 2, 5.0, 1.0), ("a", 3, None, 1.0)], FRAMES)
    assert [tuple(r) for r in keyframes.select_keyframes(table, "video", "f", 1.0, 2).orderBy("pick").collect()] == [("a", 1, 0), ("a", 3, 1)]


def test_ranks_don_t_need_one_task(spark):
    df = spark.range(50_000).select(((F.col("id") * 7919) % 50_000).alias("v"))
    ranged = ranges.in_ranges(df, ["v"], 3000)
    assert ranged.select("_range").distinct().count() > 10
    assert ranges.with_ranks(df, ["v"]).filter("_rank <> v").isEmpty()


@pytest.mark.parametrize("keys", [["g"], []])
def test_quantiles_of_large_groups_equal_the_built_in(spark, keys):
    dice = np.random.default_rng(0)
    rows = [(None if g == 2 else g, float(v)) for g, n in ((0, 5000), (1, 3), (2, 4000)) for v in np.r_[dice.normal(size=n // 2) * 10.0 ** dice.integers(-300, 300, n // 2), np.full(n - n // 2, -0.0)]]
    rows += [(0, None), (9, None), (0, float("inf")), (0, float("-inf")), (2, float("nan"))]
    df = spark.createDataFrame(rows, "g int, v double").repartition(4)
    of = lambda large: {tuple(r[k] for k in keys): (r.q, r.c) for r in selection.quantiles(df, keys, F.col("v"), [0.01, 0.5, 0.99, 1.0], [F.count("*").alias("c")], large).collect()}
    want = of(10**6)
    for large in (2000, 1):
        got = of(large)
        assert got.keys() == want.keys()
        for k in want:
            assert got[k][1] == want[k][1] and (want[k][0] is None) == (got[k][0] is None)
            assert want[k][0] is None or np.allclose(np.array(got[k][0], float), np.array(want[k][0], float), rtol=1e-12, equal_nan=True)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "g int, v double")
    assert selection.quantiles(empty, ["g"], F.col("v"), [0.5]).collect() == []
    assert [r.m for r in selection.medians(empty, [], F.col("v"), "m").collect()] == [None]


def frame(spark, p):
    return spark.createDataFrame(pd.DataFrame({"_row": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "c": np.arange(len(p)) * 10}))


@pytest.mark.parametrize(("k", "radius", "itself"), [(1, np.inf, False), (1, 0.2, False), (4, np.inf, True), (4, 0.05, True)])
def test_nearest_neighbours_equal_all_pairs(spark, monkeypatch, k, radius, itself):
    monkeypatch.setattr(neighbors, "BLOCK", 500)
    dice = np.random.default_rng(0)
    ref = np.r_[dice.normal(size=(3000, 3)), dice.normal(size=(2000, 3)) * 1e-6, np.repeat(dice.normal(size=(20, 3)), 10, 0)]
    query = ref if itself else np.r_[dice.normal(size=(800, 3)), ref[2900:3100] + 1e-7, dice.normal(size=(5, 3)) * 50]
    got = {r._row: r for r in neighbors.k_nearest(frame(spark, query), frame(spark, ref), k, radius, ["c"], itself).collect()}
    d = np.sqrt(((query[:, None] - ref[None]) ** 2).sum(2))
    if itself:
        np.fill_diagonal(d, np.inf)
    d[d > radius] = np.inf
    want = np.sort(d, 1)[:, :k]
    assert len(got) == len(query)
    for i, r in got.items():
        assert np.allclose(r.ds, want[i][np.isfinite(want[i])], rtol=1e-12)
        assert np.allclose([d[i, c // 10] for c in r.c], r.ds, rtol=1e-12) and len(set(r.c)) == len(r.c)


def test_a_dense_cell_and_equal_points_stay_small(spark, monkeypatch):
    """A cloud of 40,000 points within one radius, a quarter of them equal: no rows but the queries' own."""
    monkeypatch.setattr(neighbors, "BLOCK", 4000)
    dice = np.random.default_rng(2)
    p = np.r_[dice.random((30_000, 3)) * 0.01, np.full((10_000, 3), 0.005)]
    cloud = frame(spark, p)
    got = neighbors.k_nearest(cloud, cloud, 2, 1.0, itself=True).select("_row", F.get("ds", F.lit(0)).alias("d"), F.size("ds").alias("n")).collect()
    assert len(got) == len(p) and all(r.n == 2 for r in got) and all(r.d == 0 for r in got if r._row >= 30_000)


def test_nearest_of_empty_clouds(spark):
    some, none = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double"), spark.createDataFrame([], "x double, y double, z double")
    assert [r.d for r in spatial.nearest(some, none, 2.0).collect()] == [2.0] and spatial.nearest(none, some, 2.0).collect() == []


def vectors(spark, v):
    return spark.createDataFrame(pd.DataFrame({"idx": np.arange(len(v)), "vec": v.tolist()}))


def test_the_nearest_rows_equal_all_pairs_and_fewer_are_compared(spark, monkeypatch):
    """Forty clusters in 16 dimensions, with equal rows and ties."""
    monkeypatch.setattr(pivots, "BLOCK", 100)
    monkeypatch.setattr(pivots, "QUERIES", 300)
    dice = np.random.default_rng(1)
    centers = dice.normal(size=(40, 16)) * 10
    a, b = (np.round(centers[dice.integers(0, 40, n)] + dice.normal(size=(n, 16)) * 0.3, 2) for n in (900, 2000))
    b[500:520], a[:3] = b[7], b[7]
    got = {r.own: r for r in pivots.k_nearest(vectors(spark, a), vectors(spark, b), 2).collect()}
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    assert len(got) == len(a)
    for i, r in got.items():
        order = np.lexsort((np.arange(len(b)), d[i]))[:2]
        assert [x.near for x in r.best] == order.tolist() and np.allclose([x.d for x in r.best], d[i][order], rtol=1e-12)
    assert sum(r.compared for r in got.values()) < 0.4 * d.size


def test_vectors_without_structure_and_small_tables(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 50)
    dice = np.random.default_rng(2)
    a, b = dice.normal(size=(60, 32)), dice.normal(size=(300, 32))
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    got = {r.own: [x.near for x in r.best] for r in pivots.k_nearest(vectors(spark, a), vectors(spark, b), 3).collect()}
    assert got == {i: np.argsort(row)[:3].tolist() for i, row in enumerate(d)}
    one = pivots.k_nearest(vectors(spark, a), vectors(spark, b[:1]), 2).collect()
    assert len(one) == 60 and all(len(r.best) == 1 for r in one)
    assert matching.match_sets(vectors(spark, a), vectors(spark, b[:1])).collect() == []
    assert pivots.k_nearest(vectors(spark, a), vectors(spark, b).limit(0), 2).collect() == []


def test_every_pair_once(spark):
    left = spark.range(70).withColumnRenamed("id", "a")
    got = ranges.every_pair(left, left.withColumnRenamed("a", "b"), 9)
    assert got.count() == 4900 == got.distinct().count()
