"""SVM-SMOTE with a kernel margin: kinds of support rows as in numpy, where new rows lie."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from renewal.operators import svm_smote

FEATS = ["a", "b"]


def _rings(spark, n=300, seed=0):
    """A minority disc inside a majority ring (no straight margin parts them), and a few strays."""
    rng = np.random.default_rng(seed)
    label = (np.arange(n) % 4 == 0).astype(int)
    radius = np.where(label == 1, rng.uniform(0, 1.15, n), rng.uniform(1.0, 2.2, n))
    radius[label == 1][:3] = 2.0
    turn = rng.uniform(0, 2 * np.pi, n)
    x = np.stack([radius * np.cos(turn), radius * np.sin(turn)], 1)
    x[[0, 4]] = [[1.9, 0.0], [0.0, -1.9]]  # minority strays among the majority
    return spark.createDataFrame([(i, float(a), float(b), int(t)) for i, ((a, b), t) in enumerate(zip(x, label, strict=True))], "row_id long, a double, b double, label int").repartition(4), x, label


def test_fourier_features_approach_the_kernel(spark):
    df, x, _ = _rings(spark, 120)
    z = np.array([r.z for r in svm_smote.fourier_features(df, FEATS, 0.7, 4096).orderBy("row_id").collect()])
    kernel = np.exp(-0.7 * np.square(x[:, None] - x[None]).sum(2))
    assert np.abs(z @ z.T - kernel).max() < 0.12
    assert svm_smote.rbf_gamma(df, FEATS) == pytest.approx(1 / (2 * x.var()))


def test_kinds_are_told_apart_as_in_numpy(spark):
    df, x, label = _rings(spark)
    support = svm_smote.support_rows(df, FEATS).checkpoint()
    ids = {r.row_id for r in support.collect()}
    assert 5 < len(ids) < (label == 1).sum() and all(label[i] == 1 for i in ids)
    inner = np.hypot(*x.T) < 0.35  # deep inside the disc no row supports a kernel margin
    assert not ids & set(np.flatnonzero(inner & (label == 1)).tolist())
    d2 = np.square(x[:, None] - x[None]).sum(2)
    np.fill_diagonal(d2, np.inf)
    want = {}
    for i in ids:
        n = int((label[np.argsort(d2[i], kind="stable")[:10]] == 0).sum())
        want[i] = "noise" if n == 10 else "danger" if n >= 5 else "safe"
    got = {r.row_id: r.kind for r in svm_smote.support_kinds(df, support, FEATS).collect()}
    assert got == want and set(want.values()) == {"noise", "danger", "safe"}


def test_new_rows_lie_between_or_beyond(spark):
    df, x, label = _rings(spark)
    kinds = {r.row_id: r.kind for r in svm_smote.support_kinds(df, svm_smote.support_rows(df, FEATS), FEATS).collect()}
    out = svm_smote.smote_svm_rbf(df, FEATS)
    new = out.where("row_id < 0").collect()
    assert len(new) == (label == 0).sum() - (label == 1).sum() == len({r.row_id for r in new}) and out.count() == 300 + len(new)
    minority = np.flatnonzero(label == 1)
    beyond = between = 0
    for r in new:
        s = np.array([r.a, r.b])
        placed = set()
        for i, kind in kinds.items():
            others = minority[minority != i]
            for j in others[np.argsort(np.square(x[others] - x[i]).sum(1), kind="stable")[:5]].tolist():
                along = x[j] - x[i]
                t = float((s - x[i]) @ along / (along @ along))
                if np.abs(x[i] + t * along - s).max() < 1e-9 and (0 <= t <= 1 if kind == "danger" else -0.5 <= t <= 0 if kind == "safe" else False):
                    placed.add(kind)
        assert placed
        between, beyond = between + ("danger" in placed), beyond + ("safe" in placed)
    assert abs(between - beyond) <= 2 or min(between, beyond) >= len(new) // 2


def test_refusals(spark):
    df, _, _ = _rings(spark, 60)
    assert svm_smote.smote_svm_rbf(df.where("label = 1").unionByName(df.where("label = 0").limit(15)), FEATS).count() == 30
    with pytest.raises(ValueError, match="neighbours"):
        svm_smote.smote_svm_rbf(df.where(F.col("label") == 0).unionByName(df.where("label = 1").limit(3)), FEATS)
