"""The neighbour graph: recall on all 64 coordinates, bounded lists, copies, odd tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from renewal.operators import graph
from renewal.sources import frames


def _frame(spark, x):
    cols = [f"x{j}" for j in range(x.shape[1])]
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, " + ", ".join(f"{c} double" for c in cols)), cols


def _exact(x, k):
    d2 = np.square(x[:, None] - x[None]).sum(2)
    np.fill_diagonal(d2, np.inf)
    return np.sqrt(np.sort(d2, 1)[:, :k])


def test_recall_on_all_coordinates(spark):
    """The embeddings of the test tables, every point asked for."""
    df = frames.embed(spark, "/root/testdata/sf0.1")
    found = graph.knn_graph(df, frames.EMBED_FEATURES, 10).checkpoint()
    row = graph.recall(found, df, frames.EMBED_FEATURES, df.select("row_id"), 10).collect()[0]
    assert row.points >= 1900 and row.neighbours == 10 * row.points and row.recall >= 0.9


def test_recall_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(graph, "CELL_ROWS", 600)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 6000)] + rng.normal(0, 0.6, (6000, 16))  # overlapping clusters
    df, cols = _frame(spark, x)
    got = graph.knn_graph(df, cols, 8).checkpoint()
    ask = df.filter("row_id % 20 = 0").select("row_id")
    assert graph.recall(got, df, cols, ask, 8).collect()[0].recall >= 0.9
    lists = got.groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("neighbor_key").alias("d"), F.max("nn_rank").alias("r"))
    assert lists.filter("n <> 8 or d <> 8 or r <> 8").isEmpty() and lists.count() == 6000
    assert got.filter("row_id = neighbor_key").isEmpty()
    near = {(r.row_id, r.neighbor_key): r.dist for r in got.filter("row_id < 50").collect()}
    assert all(d == pytest.approx(float(np.linalg.norm(x[i] - x[j]))) for (i, j), d in near.items())


def test_rounds_mend_a_poor_first_graph(spark):
    x = np.random.default_rng(2).normal(size=(1500, 12))
    df, cols = _frame(spark, x)
    exact = _exact(x, 6)
    shares = []
    for rounds in (0, 2):
        got = graph.knn_graph(df, cols, 6, trees=2, rounds=rounds).collect()
        shares.append(np.mean([r.dist <= exact[r.row_id, -1] * (1 + 1e-12) for r in got]))
    assert shares[1] > shares[0] + 0.15


def test_hubs_are_sampled(spark):
    """One point that all others name: its list stays about 2 k long."""
    k, n = 5, 3000
    g = spark.range(1, n).select(F.col("id").alias("_k"), F.array(F.struct(F.lit(1.0).alias("d2"), F.lit(0).cast("long").alias("nb"))).alias("nbs"))
    edges = graph._edges(g)
    assert edges.count() == n - 1
    points = spark.range(n).select(F.col("id").alias("_k"), F.lit(np.zeros(2).tobytes()).alias("x"))
    plan = graph._joined(points, g, n, k, 10)
    assert plan.filter("size(nbs) > 5").isEmpty() and plan.count() >= n - 1


def test_copies_and_odd_tables(spark):
    rows = [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 1.0, 0.0), (4, 5.0, None), (None, 9.0, 9.0), (5, 3.0, float("nan")), (6, 4.0, 0.0)]
    df = spark.createDataFrame(rows, "row_id long, x double, y double")
    got = sorted(tuple(r) for r in graph.knn_graph(df, ["x", "y"], 3).collect())
    assert got == sorted([(1, 3, 1, 1.0), (1, 6, 2, 4.0), (3, 1, 1, 1.0), (3, 6, 2, 3.0), (6, 3, 1, 3.0), (6, 1, 2, 4.0)])
    assert graph.knn_graph(df.limit(0), ["x", "y"]).collect() == [] and graph.knn_graph(df.limit(1), ["x", "y"]).collect() == []
    same = spark.createDataFrame([(i, 1.0 * (i // 400), 0.0) for i in range(900)], "row_id long, x double, y double")
    assert {(r.row_id, r.neighbor_key) for r in graph.knn_graph(same, ["x", "y"], 1).collect()} >= {(0, 400)}
