"""Exact search over leaves: equal to all pairs, and every query is sent a bounded number of times."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from renewal.operators import leaves

RNG = np.random.default_rng(3)
CLUSTERS = np.repeat(RNG.normal(size=(12, 6)) * 100, 50, 0) + RNG.normal(size=(600, 6)) * 0.01 + 1e6
GRID = np.unique(RNG.integers(0, 5, size=(900, 4)).astype(float), axis=0)
HUGE = RNG.normal(size=(300, 3))
HUGE[0], HUGE[1, 0], HUGE[2] = 1e200, np.inf, 1e25


def _frame(spark, x, first):
    return spark.createDataFrame(pd.DataFrame({"_k": np.arange(len(x)) * 3 + first} | {f"x{i}": c for i, c in enumerate(x.T)}))


def _all_pairs(q, qk, b, bk, k, metric, own):
    out = []
    with np.errstate(all="ignore"):
        for x, key in zip(q, qk):
            d = leaves.distances(x[None], b, metric)[0]
            if own:
                d[bk == key] = np.inf
            out += [(key, bk[j], d[j]) for j in np.lexsort((bk, d))[:k] if np.isfinite(d[j])]
    return sorted(out)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("base, own", [(CLUSTERS, True), (GRID, True), (HUGE, True), (RNG.normal(size=(700, 9)), False)], ids=["clusters", "ties", "huge", "asked"])
def test_leaf_knn_equals_all_pairs(spark, monkeypatch, metric, base, own):
    monkeypatch.setattr(leaves, "LEAF_ROWS", 16)
    monkeypatch.setattr(leaves, "BLOCK_ROWS", 40)
    q = base if own else RNG.normal(size=(150, base.shape[1]))
    names = [f"x{i}" for i in range(base.shape[1])]
    found = leaves.leaf_knn(None if own else _frame(spark, q, 1), _frame(spark, base, 0), names, 4, metric)
    got = sorted((r["_k"], r["neighbor_key"], r["d2"]) for r in found.collect())
    assert got == _all_pairs(q, np.arange(len(q)) * 3 + (not own), base, np.arange(len(base)) * 3, 4, metric, own)


def test_leaf_knn_sends_a_query_a_few_times_however_many_leaves_it_looks_into(spark, monkeypatch):
    monkeypatch.setattr(leaves, "LEAF_ROWS", 4)
    monkeypatch.setattr(leaves, "BLOCK_ROWS", 64)
    x, sent, frame = RNG.normal(size=(800, 64)), spark.sparkContext.accumulator(0), type(spark.range(0))

    def counted(self, function, schema, *more, step=frame.mapInPandas):
        def steps(frames):
            for f in function(frames):
                if "x" in f:
                    sent.add(int(f["x"].map(len).sum()))
                yield f

        return step(self, steps, schema, *more)

    monkeypatch.setattr(frame, "mapInPandas", counted)
    assert leaves.leaf_knn(None, _frame(spark, x, 0), [f"x{i}" for i in range(64)], 20).count() == 800 * 20
    assert 0 < sent.value < 6 * x.nbytes
