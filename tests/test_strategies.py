"""Sampling strategies of the cleaners, refusals of the over-samplers, and the leaf search."""

import numpy as np
import pytest

from renewal.operators.clean import cast_strict
from renewal.operators.impute import anchor_cover
from renewal.operators.models import tree_params
from renewal.operators.neighbors import knn
from renewal.operators.resample import adasyn, cleaned_classes, condensed_nn, enn_round, over_total, repeated_enn, smote, tomek_links

FEATS = ["x0", "x1"]


def _frame(spark, rows):
    return spark.createDataFrame([(i, float(a), float(b), c) for i, (a, b, c) in enumerate(rows)], "row_id long, x0 double, x1 double, label int")


def test_cleaned_classes_follow_the_strategy():
    counts = {0: 50, 1: 5, 2: 20}
    assert cleaned_classes(counts) == cleaned_classes(counts, "not minority") == [0, 2]
    assert cleaned_classes(counts, "majority") == [0]
    assert cleaned_classes(counts, "not majority") == [1, 2]
    assert cleaned_classes(counts, "all") == [0, 1, 2]
    assert cleaned_classes({}) == []
    for wrong in ("minority", "both"):
        with pytest.raises(ValueError):
            cleaned_classes(counts, wrong)
    assert over_total({0: 50, 1: 5}, "not minority") == 0


@pytest.mark.parametrize("strategy,gone", [("auto", {0}), ("majority", {0}), ("not minority", {0}), ("not majority", {1}), ("all", {0, 1})])
def test_tomek_and_enn_drop_the_named_classes(spark, strategy, gone):
    # rows 0 and 1 are a Tomek link; the rest are far away, in one-class groups
    far = [(100 + i, 0, 0) for i in range(8)] + [(0, 100 + i, 1) for i in range(4)]
    df = _frame(spark, [(0, 0, 0), (0, 0.1, 1), *far])
    for cleaned in (tomek_links(df, FEATS, strategy=strategy), enn_round(df, FEATS, 1, strategy=strategy)):
        assert {0, 1} - {r.row_id for r in cleaned.collect()} == gone


def test_over_samplers_refuse_too_few_minority_rows(spark):
    df = _frame(spark, [(i, i % 3, 1 if i < 4 else 0) for i in range(44)])
    for sampler in (smote, adasyn):
        with pytest.raises(ValueError, match="minority"):
            sampler(df, FEATS, k=5)
    assert smote(df, FEATS, k=3).where("label = 1").count() == 40
    twice = smote(smote(df, FEATS, 0.5, k=3), FEATS, k=3)
    assert twice.select("row_id").distinct().count() == twice.count() == 80


def test_repeated_enn_stops_below_the_first_minority_count(spark):
    rows = [(i % 7, i // 7, 0) for i in range(35)] + [(i % 7 + 0.4, i // 7, 1) for i in range(30)]
    got = repeated_enn(_frame(spark, rows), FEATS, 3)
    assert got.where("label = 1").count() == 30 or got.where("label = 0").count() < 30


def test_condensed_nn_keeps_a_consistent_store(spark):
    rng = np.random.default_rng(0)
    rows = [(*rng.normal(0, 1, 2), 0) for _ in range(80)] + [(*rng.normal(3, 1, 2), 1) for _ in range(15)]
    df = _frame(spark, rows)
    store = {r.row_id for r in condensed_nn(df, FEATS, n_seeds=2).collect()}
    assert {i for i, r in enumerate(rows) if r[2] == 1} <= store
    pts = np.array([r[:2] for r in rows])
    for i, r in enumerate(rows):  # the 1-NN rule on the store is right for every row left out
        if i not in store:
            near = min(store, key=lambda j: (((pts[i] - pts[j]) ** 2).sum(), j))
            assert rows[near][2] == r[2]
    with pytest.raises(RuntimeError):
        condensed_nn(df, FEATS, max_rounds=1)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_leaf_search_equals_brute_force(spark, metric):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 20, (9, 6))
    x = np.round(np.concatenate([c + rng.normal(0, 1, (130, 6)) for c in centres]), 1)
    x[50:90] = x[0]  # copies
    feats = [f"f{j}" for j in range(6)]
    base = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, " + ", ".join(f"{f} double" for f in feats))
    got: dict[int, list] = {}
    for r in knn(None, base, feats, 4, metric=metric).collect():
        got.setdefault(r.row_id, []).append((r.nn_rank, r.neighbor_key))
    for i in range(0, len(x), 7):
        d = np.zeros(len(x))
        for j in range(6):
            gap = x[i, j] - x[:, j]
            d += np.abs(gap) if metric == "manhattan" else gap * gap
        want = sorted((d[j], j) for j in range(len(x)) if j != i)[:4]
        assert [k for _, k in sorted(got[i])] == [j for _, j in want]
    missing = base.union(spark.createDataFrame([(5000, None, *[0.0] * 5)], base.schema))
    assert knn(missing.where("row_id = 5000"), base, feats, 2, metric=metric).count() == 0


def test_strict_integers_refuse_fractions(spark):
    df = spark.createDataFrame([("1",), ("2.0",), (None,)], "f string")
    assert [r.f for r in cast_strict(df, ["f"], "int").collect()] == [1, 2, None]
    with pytest.raises(Exception, match="cast_strict"):
        cast_strict(spark.createDataFrame([("1.5",)], "f string"), ["f"], "int").collect()


def test_anchor_cover_takes_many_columns(spark):
    cols = [f"c{i}" for i in range(100)]
    df = spark.createDataFrame([tuple(float(i) if j != i else None for j in range(100)) for i in range(3)], ", ".join(f"{c} double" for c in cols))
    assert anchor_cover(df, df, cols) == ["c3"]
    only = df.select(*[cols[99] if c == cols[99] else (df[c] * None).cast("double").alias(c) for c in cols])
    assert anchor_cover(only, df, cols) == ["c99"]


def test_tree_params_name_what_they_drop():
    with pytest.warns(UserWarning, match="alpha, lambda"):
        assert tree_params({"lambda": 1, "alpha": 2, "min_data_in_bin": 7}) == {"maxBins": 7}
    assert tree_params({"max_depth": -1, "num_leaves": 31}) == tree_params({"num_leaves": 31, "max_depth": -1})
