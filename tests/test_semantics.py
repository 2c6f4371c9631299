"""Hand-made edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from renewal.operators import clean, encode, evaluate, profile, split
from renewal.operators.correlation import corr_matrix, correlated_report
from renewal.plans.prepare import correlation_kept
from renewal.sources import io


def test_sentinel_is_whole_cell(spark):
    df = spark.createDataFrame([("#",), ("a#",), ("x",), (None,)], "f string")
    out = [r.f for r in clean.null_sentinel(df).collect()]
    assert out == [None, "a#", "x", None]


def test_coerce_rejects_java_suffixes_and_underscores(spark):
    df = spark.createDataFrame([(" 12 ",), ("1d",), ("1_0",), ("NaN",), ("abc",), ("-3.5e2",), (".5",)], "f string")
    out = [r.f for r in clean.cast_coerce(df, ["f"]).collect()]
    assert out == [12.0, None, None, None, None, -350.0, 0.5]


def test_strict_cast_fails_on_text(spark):
    df = spark.createDataFrame([("1",), ("oops",)], "f string")
    with pytest.raises(Exception):
        clean.cast_strict(df, ["f"]).collect()
    ok = spark.createDataFrame([("1",), (None,)], "f string")
    assert [r.f for r in clean.cast_strict(ok, ["f"], "int").collect()] == [1, None]


def test_na_tokens(spark):
    df = spark.createDataFrame([("NA",), ("n/a",), ("",), ("ok",)], "f string")
    assert [r.f for r in io.apply_na_tokens(df).collect()] == [None, None, None, "ok"]


def test_constant_rule_all_null_stays_and_test_only_constant_drops(spark):
    train = spark.createDataFrame([(1.0, None, 1.0), (1.0, None, 2.0)], "c double, n double, t double")
    test = spark.createDataFrame([(1.0, None, 5.0), (1.0, None, 5.0)], "c double, n double, t double")
    rep = {r.column: r.drop for r in profile.constant_report(train, test, ["c", "n", "t"]).collect()}
    assert rep == {"c": True, "n": False, "t": True}


def test_sparse_threshold_is_greater_or_equal(spark):
    rows = [(None,)] * 3999 + [(1.0,)]
    train = spark.createDataFrame(rows, "a double")
    test = spark.createDataFrame([(1.0,)], "a double")
    assert profile.kept_columns(profile.sparse_report(train, test, ["a"], 4000)) == ["a"]
    train2 = spark.createDataFrame([(None,)] * 4000, "a double")
    assert profile.kept_columns(profile.sparse_report(train2, test, ["a"], 4000)) == []


def test_correlation_chain_drops_b_and_c(spark):
    # a~b strongly, b~c strongly, a and c weakly: both b and c go (the earlier column counts even if dropped)
    rows = [(1.0, 1.0, 5.0), (2.0, 2.1, 2.0), (3.0, 2.9, 4.0), (4.0, 4.2, 1.0), (5.0, 5.0, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double").withColumn("c", F.col("b") * 2 + F.col("c") * 0.4)
    corr = {(r.column_i, r.column_j): r.corr for r in corr_matrix(df, ["a", "b", "c"]).collect()}
    assert corr[("a", "b")] >= 0.75 and corr[("b", "c")] >= 0.75
    rep = {r.column: r.drop for r in correlated_report(corr_matrix(df, ["a", "b", "c"]), ["a", "b", "c"]).collect()}
    assert rep == {"a": False, "b": True, "c": True}


def test_exact_threshold_is_inclusive(spark):
    # corr(x, y) = 0.75 exactly is built from y = 0.75·x + sqrt(1-0.5625)·z with x ⟂ z, equal norms
    x = [1.0, -1.0, 1.0, -1.0]
    z = [1.0, 1.0, -1.0, -1.0]
    y = [0.75 * a + math.sqrt(1 - 0.5625) * b for a, b in zip(x, z)]
    df = spark.createDataFrame(list(zip(x, y)), "x double, y double")
    r = corr_matrix(df, ["x", "y"]).collect()[0].corr
    assert abs(r - 0.75) < 1e-12
    rep = {q.column: q.drop for q in correlated_report(corr_matrix(df, ["x", "y"]), ["x", "y"], threshold=r).collect()}
    assert rep["y"] is True


def test_constant_pair_is_null_not_nan(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "a double, b double")
    for method in ("gram", "pairs"):
        assert corr_matrix(df, ["a", "b"], method).collect()[0].corr is None


def test_text_column_vanishes_in_correlation_step(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "y"), (3.0, "z")], "a double, s string")
    assert correlation_kept(df, df, ["a", "s"]) == ["a"]


def test_rint_half_to_even(spark):
    df = spark.createDataFrame([(0.5,), (0.5000001,), (0.49,), (1.0,)], "p double")
    assert [r.prediction for r in encode.to_label(df, "p").collect()] == [0, 1, 0, 1]


def test_one_hot_unseen_and_null_are_zero(spark):
    train = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "row_id int, s string")
    test = spark.createDataFrame([(4, "c"), (5, None), (6, "a")], "row_id int, s string")
    dic = encode.fit_dictionary(train, ["s"])
    assert dic == {"s": ["a", "b"]}
    out = {r.row_id: (r.s_a, r.s_b) for r in encode.one_hot(test, ["s"], dic).collect()}
    assert out == {4: (0, 0), 5: (0, 0), 6: (1, 0)}


def test_f1_without_positives_is_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    assert evaluate.f1_value(df) == 0.0


def test_illegal_ratio_is_rejected(spark):
    from renewal.operators.resample import over_total, rus_smote

    with pytest.raises(ValueError):
        over_total({0: 100, 1: 50}, 0.3)
    with pytest.raises(ValueError):
        split.under_quotas({0: 100, 1: 10}, 0.05)
    df = spark.createDataFrame([(1, 0.0, 0)], "row_id long, x double, label int")
    with pytest.raises(ValueError):
        rus_smote(df, ["x"], under=0.9, over=0.6)
