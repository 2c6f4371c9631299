"""Properties of splits, ranks, neighbours, resamplers and order statistics."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF001, SF01
from renewal.functions import hash_u32
from renewal.operators import split
from renewal.operators.correlation import corr_matrix
from renewal.operators.neighbors import knn
from renewal.operators.stats import exact_medians, exact_quantiles
from renewal.sources import frames

XS = [f"x{i}" for i in range(8)]


def test_hash_rank_is_exact_and_partition_independent(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "row_id")
    a = split.hash_rank(df, hash_u32(7, "row_id"), bucket_bits=4).select("row_id", "_rank")
    b = split.hash_rank(df.repartition(7), hash_u32(7, "row_id"), bucket_bits=20).select("row_id", "_rank")
    ra = dict(a.collect())
    rb = dict(b.collect())
    assert ra == rb
    assert sorted(ra.values()) == list(range(5000))


def test_holdout_size_and_stability(spark):
    df = frames.renewal(spark, SF01).where("split = 'train'").select("row_id")
    h1 = split.holdout(df, 0.25, 10)
    h2 = split.holdout(df.repartition(1), 0.25, 10)
    n = df.count()
    v1 = {r.row_id for r in h1.where("is_valid").collect()}
    assert len(v1) == int(np.ceil(0.25 * n))
    assert v1 == {r.row_id for r in h2.where("is_valid").collect()}


def test_strat_fold_sizes_differ_by_at_most_one(spark):
    df = frames.renewal(spark, SF01).where("split = 'train'").select("row_id", "label")
    folds = split.strat_folds(df, 5, 2, 10).join(df, "row_id")
    sizes = folds.groupBy("repeat", "label", "fold").count().collect()
    by = {}
    for r in sizes:
        by.setdefault((r.repeat, r.label), []).append(r["count"])
    assert all(max(v) - min(v) <= 1 and len(v) == 5 for v in by.values())
    # each row appears once per repeat
    assert folds.groupBy("row_id", "repeat").count().where("count <> 1").count() == 0


def test_undersample_quota(spark):
    df = frames.renewal(spark, SF01).where("split = 'train'").select("row_id", "label")
    out = split.class_counts(split.undersample(df, "auto", 10))
    assert out[0] == out[1]


def test_knn_matches_numpy_brute_force(spark):
    e = frames.embed(spark, SF001)
    pdf = e.toPandas().sort_values("row_id")
    x = pdf[XS].to_numpy()
    ids = pdf["row_id"].to_numpy()
    k = 4
    got = {}
    for r in knn(None, e, XS, k, bucket_rows=16).collect():
        got.setdefault(r.row_id, {})[r.nn_rank] = r.neighbor_key
    for i in range(0, len(ids), 37):
        d2 = ((x - x[i]) ** 2).sum(axis=1)
        order = sorted((d2[j], ids[j]) for j in range(len(ids)) if j != i)[:k]
        assert [got[ids[i]][t + 1] for t in range(k)] == [o[1] for o in order]


def test_knn_query_side(spark):
    e = frames.embed(spark, SF001)
    tr, te = e.where("row_id % 3 <> 0"), e.where("row_id % 3 = 0")
    res = knn(te.select("row_id", *XS), tr.select("row_id", *XS, "label"), XS, 3, bucket_rows=8, extra=["label"])
    assert res.count() == te.count() * 3
    ptr = tr.toPandas()
    pte = te.toPandas().set_index("row_id")
    got = {(r.row_id, r.nn_rank): r.neighbor_key for r in res.collect()}
    for q in list(pte.index)[:20]:
        d2 = ((ptr[XS].to_numpy() - pte.loc[q, XS].to_numpy(dtype=float)) ** 2).sum(axis=1)
        best = sorted(zip(d2, ptr["row_id"]))[:3]
        assert [got[(q, t + 1)] for t in range(3)] == [b[1] for b in best]


def test_smote_points_lie_between_parents(spark):
    from renewal.operators.resample import smote

    e = frames.embed(spark, SF001)
    out = smote(e, XS, "auto", 5, 10)
    counts = split.class_counts(out)
    assert counts[0] == counts[1]
    synth = out.where("row_id < 0").toPandas()
    mino = e.where("label = 1").toPandas()
    lo, hi = mino[XS].min().to_numpy(), mino[XS].max().to_numpy()
    s = synth[XS].to_numpy()
    assert (s >= lo - 1e-9).all() and (s <= hi + 1e-9).all()
    assert synth["row_id"].is_unique


def test_gram_and_pair_paths_agree(spark):
    df = frames.renewal(spark, SF01).where("split = 'train'")
    cols = ["acctbal", "n_orders", "spend", "avg_price", "max_price", "recency_days", "nation", "sparse_col"]
    a = {(r.i, r.j): r.corr for r in corr_matrix(df, cols, "gram").collect()}
    b = {(r.i, r.j): r.corr for r in corr_matrix(df, cols, "pairs").collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert (a[k] is None) == (b[k] is None)
        if a[k] is not None:
            assert abs(a[k] - b[k]) < 1e-9


def test_exact_median_and_quantile_match_numpy(spark):
    rng = np.random.default_rng(3)
    vals = rng.normal(size=3001).round(3).tolist() + [7.0] * 500
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    assert abs(exact_medians(df, ["v"], exact_limit=50)["v"] - float(np.median(vals))) < 1e-12
    for q in (0.1, 0.37, 0.9):
        assert abs(exact_quantiles(df, ["v"], q, exact_limit=50)["v"] - float(np.percentile(vals, 100 * q))) < 1e-9


def test_results_stable_under_repartition(spark):
    from renewal.operators.profile import distinct_profile, null_profile

    df = frames.renewal(spark, SF01)
    tr, te = df.where("split='train'"), df.where("split='test'")
    cols = ["acctbal", "n_orders", "segment"]
    a = sorted(null_profile(tr, te, cols).collect())
    b = sorted(null_profile(tr.repartition(7), te.repartition(1), cols).collect())
    assert a == b
    assert sorted(distinct_profile(tr, te, cols).collect()) == sorted(distinct_profile(tr.repartition(3), te, cols).collect())
    assert F is not None


def test_knn_with_a_hot_group_of_copies(spark):
    rng = np.random.default_rng(5)
    pts = rng.normal(size=(200, 3)).round(2)
    hot = np.tile([[0.1, 0.1, 0.1]], (100, 1))
    allx = np.vstack([pts, hot])
    keys = rng.permutation(np.arange(1000, 1300))
    rows = [(int(k), *map(float, x), int(k) % 2) for k, x in zip(keys, allx)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, label int").repartition(5)
    k = 4
    res = knn(None, df, ["a", "b", "c"], k, bucket_rows=16, extra=["label"])
    got = {}
    for r in res.collect():
        got.setdefault(r.row_id, {})[r.nn_rank] = (r.neighbor_key, r.nb_label)
    assert len(got) == 300
    for i in range(300):
        d2 = ((allx - allx[i]) ** 2).sum(axis=1)
        order = sorted((d2[j], keys[j]) for j in range(300) if j != i)[:k]
        assert [got[keys[i]][t + 1][0] for t in range(k)] == [o[1] for o in order]
        assert all(got[keys[i]][t + 1][1] == got[keys[i]][t + 1][0] % 2 for t in range(k))
    # query side, with copies among the queries too
    q = df.where("row_id % 3 = 0").select("row_id", "a", "b", "c")
    b = df.where("row_id % 3 <> 0")
    res2 = {(r.row_id, r.nn_rank): r.neighbor_key for r in knn(q, b, ["a", "b", "c"], k, bucket_rows=16).collect()}
    bx = [(int(kk), x) for kk, x in zip(keys, allx) if kk % 3 != 0]
    for kk, x in zip(keys, allx):
        if kk % 3:
            continue
        order = sorted((float(((bxx - x) ** 2).sum()), bk) for bk, bxx in bx)[:k]
        assert [res2[(int(kk), t + 1)] for t in range(k)] == [o[1] for o in order]


def test_wide_gram_matches_narrow(spark):
    from renewal.operators import reduce

    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 30))
    cols = [f"c{i}" for i in range(30)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in cols)).repartition(4)
    n, s, g = reduce.gram(df, cols)
    assert n == 300
    assert np.allclose(s, x.sum(axis=0)) and np.allclose(g, x.T @ x)
    reduce.WIDE, old = 100, reduce.WIDE
    try:
        n2, s2, g2 = reduce.gram(df, cols)
    finally:
        reduce.WIDE = old
    assert n2 == n and np.allclose(s, s2) and np.allclose(g, g2)


def test_by_split_profiles_equal_two_table_profiles(spark):
    from renewal.operators import profile

    df = frames.renewal(spark, SF01)
    tr, te = df.where("split='train'"), df.where("split='test'")
    cols = list(frames.RENEWAL_FEATURES)
    pairs = [
        (profile.null_profile(tr, te, cols), profile.null_profile_by_split(df, cols)),
        (profile.constant_report(tr, te, cols), profile.constant_report_by_split(df, cols)),
        (profile.sparse_report(tr, te, cols, 0.4), profile.sparse_report_by_split(df, cols, 0.4)),
        (profile.distinct_profile(tr, te, cols), profile.distinct_profile_by_split(df, cols)),
    ]
    for a, b in pairs:
        order = sorted(a.columns)
        assert sorted(a.columns) == sorted(b.columns)
        assert sorted(tuple(r[c] for c in order) for r in a.collect()) == sorted(tuple(r[c] for c in order) for r in b.collect())


def test_leaf_knn_with_a_hot_vector_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    pts = rng.normal(size=(240, 4)).round(3)
    hot = np.tile([[0.2, -0.1, 0.3, 0.0]], (60, 1))
    allx = np.vstack([pts, hot])
    keys = rng.permutation(np.arange(5000, 5300))
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(int(kk), *map(float, x)) for kk, x in zip(keys, allx)], "row_id long, a double, b double, c double, d double").repartition(3)
    k = 5
    got = {(r.row_id, r.nn_rank): r.neighbor_key for r in knn(None, df, cols, k).collect()}
    for i in range(300):
        d2 = ((allx - allx[i]) ** 2).sum(axis=1)
        order = sorted((d2[j], keys[j]) for j in range(300) if j != i)[:k]
        assert [got[(int(keys[i]), t + 1)] for t in range(k)] == [o[1] for o in order]
    q = df.where("row_id % 4 = 0").select("row_id", *cols)
    b = df.where("row_id % 4 <> 0")
    got2 = {(r.row_id, r.nn_rank): r.neighbor_key for r in knn(q, b, cols, 3).collect()}
    bx = [(int(kk), x) for kk, x in zip(keys, allx) if kk % 4 != 0]
    for kk, x in zip(keys, allx):
        if kk % 4:
            continue
        order = sorted((float(((bxx - x) ** 2).sum()), bk) for bk, bxx in bx)[:3]
        assert [got2[(int(kk), t + 1)] for t in range(3)] == [o[1] for o in order]


def test_prune_by_split_equals_two_tables(spark):
    from renewal.plans.prepare import prune_features, prune_features_by_split

    df = frames.renewal(spark, SF01)
    a = prune_features(df.where("split='train'"), df.where("split='test'"), frames.RENEWAL_FEATURES)
    b = prune_features_by_split(df, frames.RENEWAL_FEATURES)
    assert (a.after_constant, a.after_correlation, a.kept) == (b.after_constant, b.after_correlation, b.kept)
    assert b.kept == ["acctbal", "n_orders", "avg_price", "max_price", "recency_days", "nation"]
    g = {(r.split, r.i, r.j): r.corr for r in corr_matrix(df, ["acctbal", "n_orders", "spend"], group="split").collect()}
    t = {(r.i, r.j): r.corr for r in corr_matrix(df.where("split='test'"), ["acctbal", "n_orders", "spend"]).collect()}
    assert all(abs(g[("test", i, j)] - v) < 1e-12 for (i, j), v in t.items())


def test_requested_ratios_are_met(spark):
    from renewal.operators.resample import rus_smote, smote

    e = frames.embed(spark, SF01)
    before = split.class_counts(e)
    out = split.class_counts(rus_smote(e, XS, under=0.5, over=0.8, k=5, seed=10))
    n_maj = int(before[1] / 0.5)
    assert out[0] == n_maj
    assert out[1] == int(0.8 * n_maj)
    s = split.class_counts(smote(e, XS, 0.5, 5, 10))
    assert s[1] == int(0.5 * before[0]) and s[0] == before[0]
    # same rows whatever the partitioning
    a = sorted(tuple(r) for r in smote(e.repartition(1), XS, 0.5, 5, 10).collect())
    b = sorted(tuple(r) for r in smote(e.repartition(7), XS, 0.5, 5, 10).collect())
    assert a == b


def _knn_impute_numpy(fit, target, k, weights):
    """Reference: nan-euclidean kNN imputation over fit rows that have the value."""
    p = fit.shape[1] - 1
    fx, fk = fit[:, 1:], fit[:, 0]
    means = np.nanmean(fx, axis=0)
    out = target[:, 1:].copy()
    for r in range(len(target)):
        x = target[r, 1:]
        for c in range(p):
            if not np.isnan(x[c]):
                continue
            cands = []
            for d in range(len(fit)):
                if np.isnan(fx[d, c]):
                    continue
                both = ~np.isnan(x) & ~np.isnan(fx[d])
                m = both.sum()
                if m == 0:
                    continue
                ss = 0.0
                for j in range(p):
                    if both[j]:
                        ss = ss + (x[j] - fx[d, j]) * (x[j] - fx[d, j])
                cands.append(((p / m) * ss, fk[d], fx[d, c]))
            cands.sort()
            top = cands[:k]
            if not top:
                out[r, c] = means[c]
            elif weights == "distance":
                d0 = [t for t in top if t[0] == 0]
                w = [1.0 if t[0] == 0 else 0.0 for t in top] if d0 else [1.0 / np.sqrt(t[0]) for t in top]
                out[r, c] = sum(wi * t[2] for wi, t in zip(w, top)) / sum(w)
            else:
                out[r, c] = np.mean([t[2] for t in top])
    return out


def test_impute_knn_matches_numpy(spark):
    from renewal.operators.impute import impute_knn

    rng = np.random.default_rng(21)
    x = rng.normal(size=(80, 4)).round(2)
    x[rng.random(x.shape) < 0.25] = np.nan
    x[10:25] = [0.5, np.nan, 1.0, -0.5]  # a group of copies with a missing value
    x[30] = [np.nan, np.nan, np.nan, 2.0]
    x[31] = [np.nan, 7.0, np.nan, np.nan]  # may share no coordinate with some donors
    keys = np.arange(100, 180, dtype=float)
    data = np.column_stack([keys, x])
    cols = ["a", "b", "c", "d"]
    rows = [(int(r[0]), *[None if np.isnan(v) else float(v) for v in r[1:]]) for r in data]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, d double")
    fit_rows = data[data[:, 0] % 3 != 0]
    for weights in ("uniform", "distance"):
        got = {r.row_id: [r[c] for c in cols] for r in impute_knn(df.where("row_id % 3 <> 0"), df, cols, 3, weights).collect()}
        want = _knn_impute_numpy(fit_rows, data, 3, weights)
        for i, kk in enumerate(keys):
            assert np.allclose(got[int(kk)], want[i], atol=1e-9), (weights, int(kk), got[int(kk)], want[i])
