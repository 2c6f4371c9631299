"""Randomised components against numpy: 20,000 columns, dense and sparse rows, centred and not."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from renewal.operators import wide


def _angle(a, b):
    """Sine of the largest angle between the spaces of two orthonormal bases."""
    return float(np.linalg.norm(a - b @ (b.T @ a), 2))


def _sparse(rng, n, p, k, noise):
    """Rows of few values near a low rank: a row is a multiple of its group's profile of 40 columns, and noise."""
    profile, rows = rng.uniform(1, 2, (k, 40)), []
    for _ in range(n):
        g = int(rng.integers(0, k))
        other = rng.choice(np.arange(40 * k, p), 4, replace=False)
        at = np.r_[g * 40 + np.arange(40), np.sort(other)]
        rows.append((at, np.r_[(k - g) * rng.uniform(1, 3) * profile[g], rng.normal(0, noise, 4)]))
    return rows


@pytest.mark.parametrize("center", [False, True])
def test_twenty_thousand_sparse_columns(spark, center):
    rng = np.random.default_rng(7)
    n, p, k = 1500, 20_000, 5
    data = _sparse(rng, n, p, k, 0.02)
    x = np.zeros((n, p))
    for i, (at, v) in enumerate(data):
        x[i, at] = v
    df = spark.createDataFrame([(i, at.tolist(), v.tolist()) for i, (at, v) in enumerate(data)], "row_id long, at array<long>, v array<double>").repartition(5)
    rows = df.select("row_id", *wide.sparse("at", F.col("v")))
    got = wide.wide_components(rows, p, k, center)
    y = x - x.mean(0) if center else x
    w, u = np.linalg.eigh(y @ y.T)
    u, s = u[:, ::-1][:, :k], np.sqrt(w[::-1][:k])
    v = y.T @ u / s
    assert _angle(got.vectors, v) < 1e-6 and got.singular == pytest.approx(s, rel=1e-9)
    scores = {r.row_id: [r[f"sv{i}"] for i in range(k)] for r in got.scores(rows, ["row_id"]).collect()}
    signs = np.sign((got.vectors * v).sum(0))
    assert np.abs(np.array([scores[i] for i in range(n)]) - (u * s) * signs).max() < 1e-5


def test_dense_columns_as_the_narrow_way(spark):
    from renewal.operators import reduce

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 30)) @ np.diag(0.6 ** np.arange(30)) + 1.0
    cols = [f"c{j}" for j in range(30)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, " + ", ".join(f"{c} double" for c in cols)).repartition(3)
    rows = df.select("row_id", *wide.dense(cols))
    for center, narrow, prefix in ((True, reduce.pca, "pc"), (False, reduce.truncated_svd, "sv")):
        got = wide.wide_components(rows, 30, 3, center, power=4).scores(rows, ["row_id"], prefix)
        want = narrow(df, cols, 3, keep=["row_id"])
        a, b = (np.array([list(r)[1:] for r in f.orderBy("row_id").collect()]) for f in (got, want))
        assert np.abs(a - b).max() < 1e-6


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(wide, "VALUES", 3)
    monkeypatch.setattr(wide, "COLUMNS", 2)
    rows = [(0, [1, 3], [2.0, None]), (1, [], []), (2, None, None), (3, None, [1.0, 0.0, 0.0, 4.0, 0.0]), (4, [4, 0], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "row_id long, indices array<long>, values array<double>").coalesce(1)
    x = np.zeros((5, 5))
    x[0, 1], x[3, 0], x[3, 3], x[4, 4], x[4, 0] = 2, 1, 4, 1, 1
    got = wide.wide_components(df, 5, 2)
    assert got.singular == pytest.approx(np.linalg.svd(x)[1][:2]) and got.scores(df, ["row_id"]).count() == 5
    none = wide.wide_components(df.limit(0), 5, 2)
    assert none.singular.tolist() == [0, 0] and none.scores(df.limit(0), ["row_id"]).collect() == []


def test_blocks_of_columns_as_numpy(spark, monkeypatch):
    """Random numbers by blocks are those of one draw; many blocks, chunks and ranks below k give numpy's components."""
    for name, most in (("COLUMNS", 7), ("VALUES", 50), ("DRAWN", 14), ("COMMON", 3)):
        monkeypatch.setattr(wide, name, most)
    drawn = wide._random(spark, 60, 4, 10).collect()
    got = np.concatenate([np.frombuffer(r["part"], "<f8").reshape(7, 4) for r in sorted(drawn, key=lambda r: r["block"])])
    assert np.array_equal(got[:60], np.random.default_rng(10).normal(size=(60, 4))) and not got[60:].any()
    rng = np.random.default_rng(1)
    x = np.zeros((200, 60))
    for i in range(200):
        x[i, rng.choice(60, 4, replace=False)] = rng.integers(1, 5, 4)
    x[:, 3] += 4
    df = spark.createDataFrame([(i, np.flatnonzero(r).tolist(), r[r != 0].tolist()) for i, r in enumerate(x)], "row_id long, at array<long>, v array<double>").repartition(4)
    rows = df.select("row_id", *wide.sparse("at", F.col("v")))
    for center in (False, True):
        y = x - x.mean(0) if center else x
        got = wide.wide_components(rows, 60, 4, center, power=8)
        assert got.singular == pytest.approx(np.linalg.svd(y)[1][:4], rel=1e-3)
        scores = np.array([list(r)[1:] for r in got.scores(rows, ["row_id"]).orderBy("row_id").collect()])
        assert np.abs(scores - y @ got.vectors).max() < 1e-9
    low = wide.wide_components(rows.where("row_id < 2"), 60, 4)
    assert (low.singular[:2] > 0).all() and not low.singular[2:].any() and low.vectors.shape == (60, 4)


def test_driver_holds_no_table_of_all_columns(spark):
    """A million columns times 12 directions are 96 MB; the driver keeps some columns' at a time."""
    import tracemalloc

    p = 1_000_000
    rows = spark.createDataFrame([(i, [i * 1000, 999_999 - i], [3.0 ** (10 - i), 1.0]) for i in range(40)], "row_id long, at array<long>, v array<double>").select("row_id", *wide.sparse("at", F.col("v")))
    tracemalloc.start()
    got = wide.wide_components(rows, p, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.singular == pytest.approx([np.sqrt(9.0**10 + 1), np.sqrt(9.0**9 + 1)], rel=1e-6)
    assert peak < 40e6
