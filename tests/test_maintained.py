"""Cleaning loops on a maintained table: the rows of the plain rounds, fewer searches."""

from __future__ import annotations

import numpy as np
import pytest

from renewal.operators import maintained, resample

FEATS = ["a", "b"]


def _frame(spark, n, seed, labels=(0, 0, 0, 1)):
    rng = np.random.default_rng(seed)
    label = rng.choice(labels, n)
    x = (rng.normal(size=(n, 2)) + 0.9 * label[:, None]).round(2)
    return spark.createDataFrame([(i, float(a), float(b), int(t)) for i, ((a, b), t) in enumerate(zip(x, label, strict=True))], "row_id long, a double, b double, label int").repartition(3)


def _ids(df):
    return sorted(r.row_id for r in df.select("row_id").collect())


@pytest.mark.parametrize("reserve,strategy", [(9, "auto"), (0, "all")])
def test_repeated_enn(spark, reserve, strategy):
    df = _frame(spark, 260, 1)
    got, rounds = maintained.repeated_enn(df, FEATS, 3, strategy=strategy, reserve=reserve)
    assert _ids(got) == _ids(resample.repeated_enn(df, FEATS, 3, strategy=strategy))
    rows = rounds.orderBy("round").collect()
    assert rows[0].searched == 260 and len(rows) >= 2
    assert all(r.searched < rows[0].searched / (4 if reserve else 1) for r in rows[1:])


@pytest.mark.parametrize("k", [1, 3])
def test_condensed_nn(spark, k):
    df = _frame(spark, 220, 2, (0, 0, 1))
    got, rounds = maintained.condensed_nn(df, FEATS, k=k, n_seeds=k)
    assert _ids(got) == _ids(resample.condensed_nn(df, FEATS, k=k, n_seeds=k))
    rows = rounds.orderBy("round").collect()
    # a round searches among the rows just added: all rounds together, the store once
    assert len(rows) >= 2 and sum(r.among for r in rows) == rows[-1].rows == got.count()
    assert [r.searched + r.rows for r in rows] == [220] * len(rows)
    with pytest.raises(RuntimeError):
        maintained.condensed_nn(df, FEATS, k=k, n_seeds=k, max_rounds=1)


def test_few_rows(spark):
    df = _frame(spark, 260, 1).where("row_id < 3")
    got, rounds = maintained.repeated_enn(df, FEATS, 3)
    assert _ids(got) == _ids(resample.repeated_enn(df, FEATS, 3)) and rounds.count() >= 1
