"""Whitening against plain eigenvectors, and its defined results."""

import numpy as np
import pytest

from geoframe.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(vectors, k=4):
    """whitened (up to the sign of a component), explained, n and deviation of rows of float32."""
    x = np.floor(256 * vectors.astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    return (x - s / n) @ q[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum(), n, ((n * x - s) ** 2).sum(1)


def matrix(rows, k):
    by = {(r.vec_id, r.component): r for r in rows}
    ids = sorted({i for i, _ in by})
    return np.array([[by[i, c + 1].whitened for c in range(k)] for i in ids]), by


def test_equals_plain_eigenvectors(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    vectors = np.array([r.embedding for r in table.orderBy("vec_id").collect()], np.float32)
    got = whitening.whiten(table.unionByName(table.filter("vec_id < 50").withColumn("vec_id", table.vec_id + 1_000_000))).collect()
    w, by = matrix([r for r in got if r.vec_id < 1_000_000], 4)
    want, explained, n, deviation = plain(vectors)
    assert np.allclose(w * np.sign((w * want).sum(0)), want, atol=1e-9)
    assert [by[0, c].explained for c in (1, 2, 3, 4)] == pytest.approx(explained.tolist(), rel=1e-9)
    assert {r.n for r in got} == {n} and [by[i, 1].deviation for i in range(len(vectors))] == deviation.tolist()
    assert max(r.identity_error for r in got) < 1e-12 and len({r.identity_error for r in got}) == 1
    assert all(by[r.vec_id - 1_000_000, r.component].whitened == pytest.approx(r.whitened, abs=1e-12) for r in got if r.vec_id >= 1_000_000)


@pytest.mark.parametrize("d", [1, 2, 5, 16, 33])
def test_jacobi_equals_svd(d):
    dice = np.random.default_rng(d)
    a = dice.normal(size=(40, d)) @ dice.normal(size=(d, d))
    length, axes = whitening.jacobi(np.linalg.qr(a, mode="r"))
    assert np.allclose(length, np.linalg.svd(a, compute_uv=False), rtol=1e-12)
    assert np.allclose(axes.T @ axes, np.eye(d), atol=1e-13)
    assert np.allclose(np.linalg.norm(a @ axes, axis=0), length, rtol=1e-10)


def test_small_deviations_keep_their_digits():
    """Columns of very different scale: squares would lose the small ones below 1e-8 of the largest."""
    scales = 10.0 ** -np.arange(12)
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(50, 12)))
    length, _ = whitening.jacobi(np.linalg.qr(q * scales, mode="r"))
    assert np.allclose(length, scales, rtol=1e-10)


def test_rows_that_are_left_out_and_other_defined_results(spark):
    dice = np.random.default_rng(3)
    good = dice.normal(size=(60, 3)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(good)]
    odd = [(100, None, 1), (101, [1.0, None, 2.0], 1), (102, [1.0, float("nan"), 2.0], 1), (103, [1.0, float("inf"), 2.0], 1), (104, [], 1), (105, [1.0], 1)]
    frame = spark.createDataFrame(rows + odd + [(None, good[0].tolist(), None)], SCHEMA).withColumn("X", whitening.F.lit(1)).repartition(7)
    got = whitening.whiten(frame).collect()
    assert len(got) == 61 * 3 and {r.vec_id for r in got} == {*range(60), None}
    want, explained, n, _ = plain(good, 3)
    w, _ = matrix([r for r in got if r.vec_id is not None], 3)
    assert n == 60 and np.allclose(w * np.sign((w * want).sum(0)), want, atol=1e-9)


def test_directions_without_deviation_give_no_rows(spark):
    flat = [(i, [float(i), float(2 * i), 5.0, 0.0], 0) for i in range(10)]
    assert {r.component for r in whitening.whiten(spark.createDataFrame(flat, SCHEMA)).collect()} == {1}
    for rows in ([], [(1, [1.0, 2.0], 0)], [(i, [1.0, 2.0], 0) for i in range(5)], [(1, None, 0)], [(1, [], 0)]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_triangles_of_many_tasks_fold_to_one(spark):
    x = np.random.default_rng(4).integers(-500, 500, size=(300, 6))
    fit = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>").repartition(40)
    n, sums = whitening.exact_sums(fit, 6)
    assert (n, sums) == (300, x.sum(0).tolist())
    mean = x.mean(0)
    r = whitening.triangle(fit, mean)
    assert r.shape == (6, 6) and np.allclose(r.T @ r, (x - mean).T @ (x - mean))


def test_deviations_beyond_a_long():
    x = np.array([[2**40, 0], [3, 4]])
    assert whitening._deviations(x, 5, [0, 0]) == [None, 625]
    assert whitening._deviations(x[1:], 5, [1, 1]) == [14**2 + 19**2]
