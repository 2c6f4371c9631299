"""The whole preparation chain and a fitted model on 290 columns."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from renewal.operators.boosting import BoostParams, newton_trees
from renewal.operators.evaluate import f1_value
from renewal.operators.impute import impute_mean, impute_median
from renewal.operators.models import class_weight
from renewal.operators.split import holdout
from renewal.plans.prepare import prune_features_by_split, split_frames

P = 290


@pytest.fixture(scope="module")
def wide(spark):
    """Constants, copies of other columns, half-empty columns, nulls, and a label that a few columns tell."""
    rng = np.random.default_rng(11)
    n = 500
    x = rng.normal(size=(n, P))
    label = (x[:, 0] + x[:, 7] - x[:, 21] > 0.8).astype(int)
    x[:, 30:40] = 3.0
    x[:, 40:60] = x[:, :20] * 2 + rng.normal(0, 0.01, (n, 20))
    x[:, 60:70][rng.random((n, 10)) < 0.6] = np.nan
    x[:, 100:200][rng.random((n, 100)) < 0.05] = np.nan
    cols = [f"feature_{j}" for j in range(P)]
    rows = [(i, "test" if i % 4 == 3 else "train", *[None if np.isnan(v) else float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, label, strict=True))]
    schema = "row_id long, split string, " + ", ".join(f"{c} double" for c in cols) + ", label int"
    return spark.createDataFrame(rows, schema).repartition(4).checkpoint(), cols, x


def test_prune_impute_and_fit(wide):
    df, cols, x = wide
    kept = prune_features_by_split(df, cols).kept
    assert kept == [c for j, c in enumerate(cols) if not 30 <= j < 70]
    train, test = split_frames(df)
    train, test = train.select("row_id", *kept, "label"), test.select("row_id", *kept, "label")
    for impute, of in ((impute_mean, np.nanmean), (impute_median, np.nanmedian)):
        filled = impute(train, test, kept)[1].orderBy("row_id").collect()
        rows = np.arange(len(x)) % 4 == 3
        want = np.where(np.isnan(x[rows]), of(x[~rows], axis=0), x[rows])
        got = np.array([[r[c] for c in kept] for r in filled])
        assert np.abs(got - want[:, [cols.index(c) for c in kept]]).max() < 1e-9
    parts = class_weight(holdout(train, 0.25, 10)).checkpoint()
    model = newton_trees(parts, kept, BoostParams(rounds=8, max_depth=3, eta=0.5, max_bins=32), valid="is_valid")
    held = model.predict(parts.where("is_valid"))
    assert held.where(F.col("probability_1").isNull()).isEmpty() and f1_value(held) > 0.6
    used = {kept[f] for t in model.trees for f in t.feature if f >= 0}
    assert {"feature_0", "feature_7", "feature_21"} <= used
