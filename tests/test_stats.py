"""Radix selection: order of the keys, hot values, extremes, plans."""

from __future__ import annotations

import math

import numpy as np
import pytest

from renewal.operators import stats


def test_keys_keep_the_order():
    v = np.array([-math.inf, -1e300, -1.5, -5e-324, -0.0, 0.0, 5e-324, 1e-3, 1.0, 1e300, math.inf])
    k = stats.ordered(v)
    assert k[4] == k[5] and (np.diff(k.astype(object)) >= 0).all() and len(set(k.tolist())) == 10
    assert [stats.unordered(int(x)) for x in k] == v.tolist()


@pytest.mark.parametrize("limit", [1, 40, stats.EXACT_LIMIT])
def test_quantiles_with_hot_values(spark, limit):
    """60 % of the rows on one value at a bracket's edge; nulls, NaN, infinities, one value, none."""
    rng = np.random.default_rng(2)
    n = 3000
    hot = np.where(rng.random(n) < 0.6, 4.0, rng.normal(4, 1e-9, n))
    wide = rng.normal(0, 1, n) * 10.0 ** rng.integers(-300, 300, n)
    ints = rng.integers(-3, 4, n).astype(float)
    rows = [(float(a), float(b) if i % 3 else None, float(c) if i % 7 else math.nan, 2.5, None, [1.0, 2.0, None][min(i, 2)]) for i, (a, b, c) in enumerate(zip(hot, wide, ints, strict=True))]
    df = spark.createDataFrame(rows, "hot double, wide double, ints double, one double, none double, two double").repartition(6)
    kept = {"hot": hot, "wide": wide[np.arange(n) % 3 > 0], "ints": ints[np.arange(n) % 7 > 0], "one": np.array([2.5]), "two": np.array([1.0, 2.0])}
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = stats.exact_quantiles(df, ["hot", "wide", "ints", "one", "none", "two"], q, limit)
        assert got.pop("none") is None
        assert got == {c: pytest.approx(float(np.quantile(v, q)), rel=1e-15) for c, v in kept.items()}


def test_ends_at_infinity_and_empty(spark):
    df = spark.createDataFrame([(math.inf,), (math.inf,), (-math.inf,)], "v double")
    assert stats.exact_medians(df, ["v"]) == {"v": math.inf}
    assert stats.exact_medians(df.limit(0), ["v"]) == {"v": None} and stats.exact_medians(df, []) == {}


def test_no_window_over_a_column(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    plan = stats._digits(df.selectExpr("v as c0"), ["c0"], [(0, 0, 64, 48)])._jdf.queryExecution().toString()
    assert "Window" not in plan and "percentile" not in plan
