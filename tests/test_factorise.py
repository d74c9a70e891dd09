"""The factorisation over tiles beside numpy's eigenvalues."""

import os

import numpy as np

from tidewater.operators import factorise


def matrix(k, a, names=None):
    n = len(a)
    names = names or list(range(n))
    return [(k, names[i], names[j], float(a[i, j])) for i in range(n) for j in range(n)]


def checked(spark, cells, side, kind="int"):
    df = spark.createDataFrame(cells, f"k int, i {kind}, j {kind}, v double")
    return {r.k: (r.n_assets, r.symmetric, r.psd) for r in factorise.psd_by_tiles(df, "k", side=side).collect()}


def test_agrees_with_eigenvalues(spark):
    rng = np.random.default_rng(11)
    cells, want = [], {}
    for k, n in enumerate((1, 2, 3, 4, 7, 9, 10, 12)):
        x = rng.normal(size=(max(1, n // 2) if k % 2 else 3 * n, n))  # every second one has half its rank
        a = x.T @ x
        for m, shift in enumerate((0.5, 0.0, -0.1)):
            b = a + shift * np.eye(n)
            low = np.linalg.eigvalsh(b)[0]
            cells += matrix(10 * k + m, b)
            want[10 * k + m] = (n, True, bool(low >= -1e-12 * max(1.0, np.abs(np.diag(b)).max())))
            if shift == 0.0:
                want[10 * k + m] = (n, True, True)  # a Gram matrix; its zero eigenvalues are rounding
    assert {v[2] for v in want.values()} == {True, False}
    assert checked(spark, cells, 3) == want
    left = [f for f in os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")) if f.startswith("tidewater-")]
    for f in left:  # one table a run stays: the last step
        assert len(os.listdir(os.path.join(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"), f))) <= 8


def test_tolerance(spark):
    cells = []
    for k, low in enumerate((-5e-13, -5e-12, 0.0)):
        cells += matrix(k, np.diag([1.0, low, 0.5]))
    cells += matrix(3, np.diag([1e6, -5e-7, 0.5])) + matrix(4, np.diag([1e6, -5e-6, 0.5]))
    assert checked(spark, cells, 2) == {0: (3, True, True), 1: (3, True, False), 2: (3, True, True), 3: (3, True, True), 4: (3, True, False)}


def test_what_is_no_symmetric_matrix(spark):
    a = np.eye(3)
    odd = a.copy()
    odd[0, 1] = 1e-9
    nan = a.copy()
    nan[1, 1] = np.nan
    inf = a.copy()
    inf[2, 2] = np.inf
    cells = matrix(0, odd) + matrix(1, nan) + matrix(2, inf) + matrix(3, a)[:-1] + matrix(4, a) + matrix(4, a)[:1] + [(5, 0, 0, None)] + matrix(6, a)
    got = checked(spark, cells, 2)
    assert {k: v[1:] for k, v in got.items()} == {k: (k == 6, k == 6) for k in range(7)}


def test_names_and_nothing(spark):
    a = np.array([[2.0, 1.0, 0.0], [1.0, 2.0, 3.0], [0.0, 3.0, 2.0]])
    assert checked(spark, matrix(1, a, ["é", "a", "zz"]), 2, "string") == {1: (3, True, False)}
    assert checked(spark, [], 2) == {}
