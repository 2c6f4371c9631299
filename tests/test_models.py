"""Model sanity: weighting, AdaBoost round 1, stacking out-of-fold discipline, tuning draws."""

from pyspark.sql import functions as F

from conftest import SF01
from renewal.operators import evaluate, models, split, tuning
from renewal.operators.impute import apply_fill, fit_means
from renewal.sources import frames

FEATS = ["acctbal", "n_orders", "avg_price", "max_price", "recency_days", "nation"]


def _frames(spark):
    df = frames.renewal(spark, SF01)
    tr, te = df.where("split='train'"), df.where("split='test'")
    m = fit_means(tr, FEATS)
    return apply_fill(tr.select("row_id", *FEATS, "label"), m), apply_fill(te.select("row_id", *FEATS, "label"), m)


def test_weighting_raises_recall(spark):
    tr, te = _frames(spark)
    plain = models.predict(models.boosted_trees(tr, FEATS, {"n_estimators": 10, "max_depth": 3}, weight=None), te, FEATS)
    weighted = models.predict(models.boosted_trees(models.class_weight(tr), FEATS, {"n_estimators": 10, "max_depth": 3}), te, FEATS)
    r0 = evaluate.f1_report(plain).collect()[0].recall
    r1 = evaluate.f1_report(weighted).collect()[0].recall
    assert r1 >= r0


def test_adaboost_first_round_is_the_base_tree(spark):
    tr, te = _frames(spark)
    ada = models.adaboost(tr, FEATS, n_estimators=1, max_depth=2)
    p_ada = {r.row_id: r.prediction for r in ada.predict(te).collect()}
    p_tree = {r.row_id: r.prediction for r in models.predict(ada.trees[0], te, FEATS).collect()}
    assert p_ada == p_tree


def test_trial_draws_are_reproducible_and_conditional():
    space = [
        tuning.Param("booster", "cat", choices=("gbtree", "gblinear")),
        tuning.Param("depth", "int", 1, 25, step=1),
        tuning.Param("eta", "float", 1e-8, 1.0, log=True),
        tuning.Param("sub", "float", 0.0, 1.0, step=0.1, when=("booster", ("gbtree",))),
    ]
    a = [tuning.sample(space, t, 10) for t in range(20)]
    assert a == [tuning.sample(space, t, 10) for t in range(20)]
    for p in a:
        assert 1 <= p["depth"] <= 25 and 1e-8 <= p["eta"] <= 1.0
        assert ("sub" in p) == (p["booster"] == "gbtree")


def test_step_prefixes_are_validated():
    import pytest

    assert tuning.validate_steps({"smote__k": [1, 2]}, ["rus", "smote"]) == {("smote", "k"): [1, 2]}
    with pytest.raises(ValueError):
        tuning.validate_steps({"xgbmodel_smote__eta": [0.1]}, ["rus", "smote", "model"])


def test_knn_vote_and_kmeans_run(spark):
    e = frames.embed(spark, "/root/testdata/sf0.001")
    h = split.holdout(e, 0.25, 10)
    out = models.knn_classify(h.where("NOT is_valid"), h.where("is_valid"), [f"x{i}" for i in range(8)], 5, "distance")
    assert out.count() == h.where("is_valid").count()
    km = models.kmeans_labels(e, [f"x{i}" for i in range(8)], 2)
    assert km.select(F.countDistinct("_cluster")).collect()[0][0] <= 2


def test_resampling_never_sees_validation_rows(spark):
    from renewal.operators.resample import smote

    e = frames.embed(spark, "/root/testdata/sf0.001")
    xs = [f"x{i}" for i in range(8)]
    seen = []

    def resample(df):
        seen.append({r.row_id for r in df.select("row_id").collect()})
        return smote(df, xs, "auto", 3, 10)

    folds = split.strat_folds(e.select("row_id", "label"), 3, 1, 10).collect()
    out = tuning.resampled_cv(e, xs, resample, lambda df: models.boosted_trees(df, xs, {"n_estimators": 3, "max_depth": 2}, weight=None), 3, 1, 10)
    assert out.count() == 3
    by_fold = {}
    for r in folds:
        by_fold.setdefault(r.fold, set()).add(r.row_id)
    for f, keys in enumerate(seen):
        assert not keys & by_fold[f]
        assert keys == set().union(*[v for g, v in by_fold.items() if g != f])
