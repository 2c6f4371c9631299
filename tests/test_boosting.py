"""Second-order boosting against a plain numpy version, its null routing, patience and storage."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from renewal.operators import boosting
from renewal.operators.boosting import BoostParams, best_prefix, newton_trees

SF001 = "/root/testdata/sf0.001"


def _weight(g, h, p):
    w = -math.copysign(max(abs(g) - p.reg_alpha, 0), g) / (h + p.reg_lambda) if h + p.reg_lambda > 0 else 0.0
    return max(-p.max_delta_step, min(p.max_delta_step, w)) if p.max_delta_step else w


def _fall(g, h, p):
    w = _weight(g, h, p)
    return -2 * (g * w + (h + p.reg_lambda) * w * w / 2 + p.reg_alpha * abs(w))


def _grow(x, g, h, edges, p, depth, rows):
    """A node as (feature, threshold, nulls left, left, right) or its value, by trying every split."""
    total = _fall(g[rows].sum(), h[rows].sum(), p)
    best = None
    for f in range(x.shape[1]):
        v = x[rows, f]
        null = np.isnan(v)
        for cut in [*edges[f], math.inf]:
            for nulls_left in (False, True):
                left = np.where(null, nulls_left, v < cut)
                if min(left.sum(), (~left).sum()) < max(1, p.min_child_samples) or min(h[rows][left].sum(), h[rows][~left].sum()) < p.min_child_weight:
                    continue
                gain = _fall(g[rows][left].sum(), h[rows][left].sum(), p) + _fall(g[rows][~left].sum(), h[rows][~left].sum(), p) - total
                if gain > 1e-6 and gain >= p.gamma and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, cut, nulls_left, left)
    if depth == 0 or best is None:
        return p.eta * _weight(g[rows].sum(), h[rows].sum(), p)
    _, f, cut, nulls_left, left = best
    return (f, cut, nulls_left, _grow(x, g, h, edges, p, depth - 1, rows[left]), _grow(x, g, h, edges, p, depth - 1, rows[~left]))


def _value(node, row):
    while isinstance(node, tuple):
        f, cut, nulls_left, left, right = node
        node = left if (nulls_left if math.isnan(row[f]) else row[f] < cut) else right
    return node


def _as_node(tree, i=0):
    if tree.feature[i] < 0:
        return tree.value[i]
    return (tree.feature[i], tree.threshold[i], bool(tree.null_left[i]), _as_node(tree, tree.left[i]), _as_node(tree, tree.right[i]))


def _same(a, b):
    if isinstance(a, tuple) != isinstance(b, tuple):
        return False
    return a[:3] == b[:3] and _same(a[3], b[3]) and _same(a[4], b[4]) if isinstance(a, tuple) else a == pytest.approx(b, abs=1e-7)


def _frame(spark, n=600, seed=0, nulls=0.25):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(2)
    x[:, 3] = rng.integers(0, 5, n)
    y = (x[:, 0] + 0.7 * x[:, 1] * (x[:, 3] > 2) + rng.normal(0, 0.5, n) > 0.4).astype(int)
    x[rng.random((n, 4)) < nulls] = np.nan
    x[(y == 1) & (rng.random(n) < 0.3), 2] = np.nan  # nulls that tell something
    rows = [(i, *[None if math.isnan(v) else float(v) for v in r], int(t), 3.0 if t else 1.0) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, d double, label int, weight double").repartition(4), x, y


FEATS = ["a", "b", "c", "d"]


@pytest.mark.parametrize(
    "params",
    [
        BoostParams(rounds=4, max_depth=3, max_bins=16),
        BoostParams(rounds=3, max_depth=3, max_bins=8, reg_lambda=0.1, reg_alpha=2.5, gamma=1.0, min_child_weight=6, eta=0.5),
        BoostParams(rounds=3, max_depth=2, max_bins=8, max_delta_step=0.4, reg_lambda=0.0, reg_alpha=0.3, min_child_samples=40),
    ],
)
def test_every_tree_is_the_plain_one(spark, params):
    df, x, y = _frame(spark)
    model = newton_trees(df, FEATS, params)
    edges = boosting.bin_edges(df, FEATS, params.max_bins)
    w, margin = np.where(y == 1, 3.0, 1.0), np.zeros(len(y))
    assert len(model.trees) == params.rounds
    for tree in model.trees:
        p = 1 / (1 + np.exp(-margin))
        plain = _grow(x, (p - y) * w, np.maximum(p * (1 - p), 1e-16) * w, edges, params, params.max_depth, np.arange(len(y)))
        assert _same(_as_node(tree), plain)
        margin += [_value(plain, r) for r in x]
    got = {r.row_id: r.probability_1 for r in model.predict(df).collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx((1 / (1 + np.exp(-margin))).tolist(), abs=1e-6)


def test_trees_of_the_tables(spark):
    """One tree on the customers of the smallest tables, nulls and all."""
    from renewal.sources.frames import renewal

    feats = ["acctbal", "n_orders", "avg_price", "max_price", "recency_days", "nation", "sparse_col"]
    df = renewal(spark, SF001).where("split = 'train'")
    params = BoostParams(rounds=2, max_depth=4, max_bins=32)
    model = newton_trees(df, feats, params, weight=None)
    rows = df.select(*feats, "label").toPandas()
    x, y = rows[feats].to_numpy(float), rows["label"].to_numpy()
    edges, margin = boosting.bin_edges(df, feats, 32), np.zeros(len(y))
    for tree in model.trees:
        p = 1 / (1 + np.exp(-margin))
        plain = _grow(x, p - y, p * (1 - p), edges, params, 4, np.arange(len(y)))
        assert _same(_as_node(tree), plain)
        margin += [_value(plain, r) for r in x]


def test_partitions_and_chunks_change_nothing(spark, monkeypatch):
    df, _, _ = _frame(spark, 400)
    params = BoostParams(rounds=10, max_depth=3, max_bins=16, subsample=0.7, colsample_bytree=0.8, colsample_bynode=0.7)
    trees = newton_trees(df, FEATS, params).trees
    monkeypatch.setattr(boosting, "CELLS", 40)  # few features at a time
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 37)
    monkeypatch.setattr(boosting, "TREES_PER_WRITE", 3)
    assert newton_trees(df.repartition(7), FEATS, params).trees == trees


def test_nulls_are_routed_without_flags(spark):
    """A column that tells by its nulls alone."""
    df = spark.range(400).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    model = newton_trees(df, ["a"], BoostParams(rounds=5, max_depth=1))
    tree = model.trees[0]
    assert tree.threshold[0] == math.inf and not tree.null_left[0]
    assert all(r.prediction == r.label for r in model.predict(df).collect())


def test_patience():
    fall, rise = [1 - 0.01 * i for i in range(10)], [0.92 + 0.01 * i for i in range(20)]
    again = [0.9 - 0.02 * i for i in range(1, 6)]
    curve = fall + rise + again  # rises for 20 rounds and falls again
    assert not any(best_prefix(curve[: i + 1], 21)[1] for i in range(len(curve)))
    assert best_prefix(curve, 21) == (len(curve), False)
    stop = next(i for i in range(len(curve)) if best_prefix(curve[: i + 1], 20)[1])
    assert stop == 29 and best_prefix(curve[: stop + 1], 20) == (10, True)
    assert best_prefix([0.5, 0.4, 0.4], 1) == (2, True) and best_prefix([], 3) == (0, False)


def test_the_best_prefix_predicts(spark):
    df, x, y = _frame(spark, 500, seed=3)
    df = df.withColumn("is_valid", F.pmod("row_id", F.lit(4)) == 0)
    params = BoostParams(rounds=40, max_depth=4, eta=0.8, patience=6, max_bins=32)
    model = newton_trees(df, FEATS, params, valid="is_valid")
    valid = np.arange(len(y)) % 4 == 0
    w, margin, losses = np.where(y == 1, 3.0, 1.0), np.zeros(len(y)), []
    for tree in model.trees:
        margin += [_value(_as_node(tree), r) for r in x]
        losses.append(np.average(boosting.log_loss(y, margin)[valid], weights=w[valid]))
    assert model.losses == pytest.approx(losses, abs=1e-6)
    assert model.best_round == 1 + int(np.argmin(losses)) and len(model.trees) == model.best_round + 6 < 40
    best = newton_trees(df.where("not is_valid"), FEATS, BoostParams(rounds=model.best_round, max_depth=4, eta=0.8, max_bins=32))
    assert best.trees == model.trees[: model.best_round]  # validation rows take no part
    got, want = ({r.row_id: r.probability_1 for r in m.predict(df).collect()} for m in (model, best))
    assert got == pytest.approx(want)
    curve = model.curve(spark).collect()
    assert [r["round"] for r in curve] == list(range(1, len(losses) + 1)) and {r.best_round for r in curve} == {model.best_round}


def test_stored_trees_predict_the_same(spark, tmp_path):
    df, _, _ = _frame(spark, 300)
    model = newton_trees(df, FEATS, {"eta": 0.4, "n_estimators": 3, "max_depth": 3, "lambda": 0.5})
    assert (model.trees and boosting.boost_params({"eta": 0.4, "lambda_l1": 0.5}).reg_alpha) == 0.5
    model.table(spark).write.parquet(f"{tmp_path}/trees")
    read = boosting.NewtonModel.from_table(spark.read.parquet(f"{tmp_path}/trees"), FEATS)
    assert read.trees == model.trees and read.best_round == 3
    assert read.predict(df).orderBy("row_id").collect() == model.predict(df).orderBy("row_id").collect()


def test_odd_tables(spark):
    schema = "row_id long, a double, b double, label int, weight double"
    empty = newton_trees(spark.createDataFrame([], schema), ["a", "b"])
    assert empty.trees == [] and [r.probability_1 for r in empty.predict(spark.createDataFrame([(1, 2.0, None, 0, 1.0)], schema)).collect()] == [0.5]
    rows = [(1, None, None, 1, 1.0), (1, None, float("nan"), 1, 2.0), (None, None, None, None, 1.0), (2, None, None, 0, None), (3, None, None, 0, 0.0)]
    one = newton_trees(spark.createDataFrame(rows, schema), ["a", "b"], BoostParams(rounds=2))
    assert [t.feature for t in one.trees] == [[-1], [-1]] and one.trees[0].value[0] > 0
    for bad in ({"max_bins": 1}, {"subsample": 0.0}, {"reg_lambda": -1.0}):
        with pytest.raises(ValueError):
            BoostParams(**bad)
    with pytest.warns(UserWarning, match="grow_policy"):
        boosting.boost_params({"grow_policy": "lossguide"})
