"""Models (M1–M11) on Spark ML.

Learners are Spark ML estimators (distributed fits); the loops the original ran inside a
library (AdaBoost rounds, stacking folds) are driver loops of Spark jobs whose state lives
in DataFrames checkpointed to the shared checkpoint folder.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from renewal.session import ensure_checkpoint_dir

from renewal.functions import rint_label, safe_div
from renewal.operators.split import class_counts

FEATURES = "_features"
WEIGHT = "weight"


def pos_weight(df: DataFrame, label: str = "label") -> float:
    """negatives / positives from one grouped count (one row per class reaches the driver)."""
    counts = class_counts(df, label)
    neg, pos = counts.get(0, 0), counts.get(1, 0)
    return float(neg) / pos if pos else 1.0


def class_weight(df: DataFrame, label: str = "label", out: str = WEIGHT, ratio: float | None = None) -> DataFrame:
    """M6: weight = negatives/positives on positive rows, 1 elsewhere (``scale_pos_weight``)."""
    r = pos_weight(df, label) if ratio is None else ratio
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(r)).otherwise(F.lit(1.0)))


def assemble(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(feats), outputCol=FEATURES, handleInvalid="error").transform(df)


# Parameter names of the original learners → Spark ML (see SURVEY §2.6).
def tree_params(params: dict[str, Any]) -> dict[str, Any]:
    """Spark ML parameters; what has no counterpart is named in a warning."""
    out: dict[str, Any] = {}
    dropped: list[str] = []
    for k, v in params.items():
        if k in ("eta", "learning_rate"):
            out["stepSize"] = float(min(max(v, 1e-6), 1.0))
        elif k in ("n_estimators", "n_estimator", "num_iterations"):
            out["maxIter"] = int(v)
        elif k == "max_depth":
            out["maxDepth"] = int(min(max(v, 1), 30)) if v and v > 0 else 5
        elif k == "num_leaves":
            out["maxDepth"] = int(min(max(math.ceil(math.log2(max(v, 2))), 1), 30))
        elif k in ("min_child_samples", "min_data_in_leaf"):
            out["minInstancesPerNode"] = int(max(v, 1))
        elif k == "min_child_weight":
            out["minWeightFractionPerNode"] = float(min(max(v, 0.0) / 100.0, 0.49))
        elif k == "gamma":
            out["minInfoGain"] = float(max(v, 0.0))
        elif k in ("subsample", "bagging_fraction"):
            out["subsamplingRate"] = float(min(max(v, 0.05), 1.0))
        elif k in ("colsample_bynode", "colsample_bytree", "feature_fraction", "colsample_bylevel"):
            out["featureSubsetStrategy"] = str(float(min(max(v, 0.05), 1.0)))
        elif k in ("max_bins", "max_bin", "min_data_in_bin"):
            out["maxBins"] = int(max(v, 2))
        else:
            dropped.append(k)
    if params.get("num_leaves") and (params.get("max_depth") or 0) <= 0:  # depth unlimited: leaves decide, in any order
        out["maxDepth"] = int(min(max(math.ceil(math.log2(max(params["num_leaves"], 2))), 1), 30))
    if dropped:
        warnings.warn(f"Spark ML trees have no counterpart of {', '.join(sorted(dropped))}; ignored", stacklevel=2)
    return out


def boosted_trees(train: DataFrame, feats: Sequence[str], params: dict | None = None, label: str = "label", weight: str | None = WEIGHT, seed: int = 10, valid_col: str | None = None):
    """M1 (and M10 with ``valid_col``): weighted gradient-boosted trees, logistic loss."""
    p = {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1}
    p.update(tree_params(params or {}))
    if "featureSubsetStrategy" in p and p["featureSubsetStrategy"] in ("1.0",):
        p["featureSubsetStrategy"] = "all"
    if valid_col:
        # stop when the validation loss stops improving by more than 1 % (no patience window in Spark)
        p.update(validationIndicatorCol=valid_col, validationTol=0.01)
    est = GBTClassifier(featuresCol=FEATURES, labelCol=label, seed=seed, **p)
    if weight and weight in train.columns:
        est.setWeightCol(weight)
    return est.fit(assemble(train, feats))


def random_forest(train: DataFrame, feats: Sequence[str], params: dict | None = None, label: str = "label", weight: str | None = WEIGHT, seed: int = 10):
    """M2: random forest (the LightGBM 'rf' booster; the stacking meta model)."""
    p = {"numTrees": 20, "maxDepth": 5}
    tp = tree_params(params or {})
    if "maxIter" in tp:
        p["numTrees"] = tp.pop("maxIter")
    tp.pop("stepSize", None)
    p.update(tp)
    est = RandomForestClassifier(featuresCol=FEATURES, labelCol=label, seed=seed, **p)
    if weight and weight in train.columns:
        est.setWeightCol(weight)
    return est.fit(assemble(train, feats))


def linear_model(train: DataFrame, feats: Sequence[str], l1: float = 0.0, l2: float = 0.0, label: str = "label", weight: str | None = WEIGHT):
    """M3: the linear booster as an elastic-net logistic regression."""
    reg = float(l1 + l2)
    est = LogisticRegression(
        featuresCol=FEATURES, labelCol=label, regParam=reg, elasticNetParam=(float(l1) / reg if reg > 0 else 0.0), maxIter=100
    )
    if weight and weight in train.columns:
        est.setWeightCol(weight)
    return est.fit(assemble(train, feats))


def predict(model, df: DataFrame, feats: Sequence[str], keep: Sequence[str] = ("row_id", "label")) -> DataFrame:
    """``keep… probability_1 prediction`` with prediction = rint(P(1))."""
    out = model.transform(assemble(df, feats))
    return out.select(
        *[c for c in keep if c in df.columns],
        vector_to_array(F.col(model.getOrDefault("probabilityCol"))).getItem(1).alias("probability_1"),
    ).withColumn("prediction", rint_label("probability_1"))


# ---------------------------------------------------------------- AdaBoost (SAMME.R)


@dataclass
class AdaBoostModel:
    trees: list = field(default_factory=list)
    learning_rate: float = 1.0
    feats: tuple = ()

    def predict(self, df: DataFrame, keep: Sequence[str] = ("row_id", "label")) -> DataFrame:
        """P(1) = sigmoid(2·s), s = mean over trees of ½(log p1 − log p0)."""
        cur = assemble(df, self.feats).select(*[c for c in keep if c in df.columns], FEATURES, F.lit(0.0).alias("_s"))
        for t in self.trees:
            tmp = t.transform(cur)
            pr = vector_to_array(F.col(t.getOrDefault("probabilityCol")))
            p1 = F.greatest(pr.getItem(1), F.lit(1e-12))
            p0 = F.greatest(pr.getItem(0), F.lit(1e-12))
            cur = tmp.select(*[c for c in keep if c in df.columns], FEATURES, (F.col("_s") + F.lit(0.5) * (F.log(p1) - F.log(p0))).alias("_s"))
        s = F.col("_s") / F.lit(float(max(len(self.trees), 1)))
        return cur.select(*[c for c in keep if c in df.columns], (F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * s))).alias("probability_1")).withColumn(
            "prediction", rint_label("probability_1")
        )


def adaboost(train: DataFrame, feats: Sequence[str], n_estimators: int = 10, learning_rate: float = 1.0, max_depth: int = 1, label: str = "label", key: str = "row_id") -> AdaBoostModel:
    """M4: SAMME.R boosting of weighted decision trees.

    Round m: fit a tree with the current weights, then
    ``w ← w · exp(−½ · lr · ỹ · (log p1 − log p0))`` (ỹ = ±1) as a column expression, normalise
    by the total (one aggregate), and checkpoint the weighted frame to cut the lineage.
    """
    ensure_checkpoint_dir(train.sparkSession)
    cur = assemble(train.select(key, *feats, label), feats).withColumn(WEIGHT, F.lit(1.0)).checkpoint()
    model = AdaBoostModel(learning_rate=learning_rate, feats=tuple(feats))
    n = cur.count()
    for m in range(n_estimators):
        tree = DecisionTreeClassifier(featuresCol=FEATURES, labelCol=label, weightCol=WEIGHT, maxDepth=max_depth, seed=10 + m).fit(cur)
        model.trees.append(tree)
        scored = tree.transform(cur).withColumn("_pa", vector_to_array("probability"))
        p1 = F.greatest(F.col("_pa").getItem(1), F.lit(1e-12))
        p0 = F.greatest(F.col("_pa").getItem(0), F.lit(1e-12))
        ysign = F.when(F.col(label) == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        nw = F.col(WEIGHT) * F.exp(F.lit(-0.5 * learning_rate) * ysign * (F.log(p1) - F.log(p0)))
        scored = scored.select(key, *feats, label, FEATURES, nw.alias(WEIGHT))
        # weights are kept with mean 1 (sum = row count), which is what the tree learner sees
        total = scored.agg(F.sum(WEIGHT)).collect()[0][0]
        if not total or not math.isfinite(total):
            break
        cur = scored.withColumn(WEIGHT, F.col(WEIGHT) * F.lit(n / total)).checkpoint()
    return model


# ---------------------------------------------------------------- stacking


@dataclass
class StackingModel:
    bases: list
    final: Any
    feats: tuple

    def predict(self, df: DataFrame, keep: Sequence[str] = ("row_id", "label")) -> DataFrame:
        cur = df
        names = []
        for i, (kind, m) in enumerate(self.bases):
            col = f"_base{i}"
            p = predict(m, cur, self.feats, keep=[*[c for c in keep if c in cur.columns]]) if kind != "ada" else m.predict(cur, keep)
            cur = cur.join(p.select("row_id", F.col("probability_1").alias(col)), "row_id")
            names.append(col)
        return predict(self.final, cur, names, keep)


def _fit_base(kind: str, train: DataFrame, feats: Sequence[str], params: dict | None):
    if kind == "gbt":
        return boosted_trees(train, feats, params)
    if kind == "rf":
        return random_forest(train, feats, params)
    if kind == "linear":
        return linear_model(train, feats, **(params or {}))
    raise ValueError(kind)


def stacking(train: DataFrame, feats: Sequence[str], bases: Sequence[tuple[str, dict | None]] = (("gbt", None), ("rf", None)), cv: int = 2, seed: int = 10, label: str = "label", key: str = "row_id") -> StackingModel:
    """M5: final random forest on out-of-fold base probabilities (stratified folds); bases re-fit on all rows."""
    ensure_checkpoint_dir(train.sparkSession)
    from renewal.operators.split import strat_folds

    folds = strat_folds(train.select(key, label), cv, 1, seed).select(key, "fold")
    data = train.join(folds, key).checkpoint()
    oof = None
    for f in range(cv):
        fit_part = data.where(F.col("fold") != f)
        held = data.where(F.col("fold") == f)
        cols = None
        for i, (kind, params) in enumerate(bases):
            m = _fit_base(kind, fit_part, feats, params)
            p = predict(m, held, feats, keep=[key]).select(key, F.col("probability_1").alias(f"_base{i}"))
            cols = p if cols is None else cols.join(p, key)
        oof = cols if oof is None else oof.unionByName(cols)
    meta = data.select(key, label, *([WEIGHT] if WEIGHT in data.columns else [])).join(oof, key).checkpoint()
    names = [f"_base{i}" for i in range(len(bases))]
    final = random_forest(meta, names, {"n_estimators": 20, "max_depth": 4})
    fitted = [(kind, _fit_base(kind, train, feats, params)) for kind, params in bases]
    return StackingModel(fitted, final, tuple(feats))


# ---------------------------------------------------------------- clustering and neighbours


def kmeans_labels(df: DataFrame, feats: Sequence[str], k: int = 2, init: str = "k-means||", seed: int = 10, label: str = "label", key: str = "row_id") -> DataFrame:
    """M7: k-means, each cluster mapped to its majority label (ties → smaller label)."""
    model = KMeans(featuresCol=FEATURES, k=k, initMode=init, seed=seed, predictionCol="_cluster").fit(assemble(df, feats))
    assigned = model.transform(assemble(df, feats)).select(key, label, "_cluster")
    votes = assigned.groupBy("_cluster", label).agg(F.count(F.lit(1)).alias("_n"))
    best = votes.withColumn("_r", F.row_number().over(Window.partitionBy("_cluster").orderBy(F.desc("_n"), label))).where("_r = 1")
    mapping = best.select("_cluster", F.col(label).alias("prediction"))
    # one row per cluster (k rows): broadcast is bounded by k
    return assigned.join(F.broadcast(mapping), "_cluster").select(key, label, "_cluster", F.col("prediction").cast("int").alias("prediction"))


def knn_classify(train: DataFrame, test: DataFrame, feats: Sequence[str], k: int = 5, weights: str = "uniform", label: str = "label", key: str = "row_id", p: int = 2) -> DataFrame:
    """M8: vote of the k nearest training rows (Minkowski p = 2 Euclidean, p = 1 Manhattan);
    'distance' weighs by 1/d (rows at distance 0 take all the weight); ties go to the smaller label."""
    from renewal.operators.neighbors import knn

    metric = "manhattan" if p == 1 else "euclidean"
    nb = knn(test.select(key, *feats), train.select(key, *feats, label), feats, k, key=key, extra=[label], metric=metric)
    if weights == "distance":
        zero = F.max(F.when(F.col("d2") == 0, 1).otherwise(0)).over(Window.partitionBy(key))
        nb = nb.withColumn("_z", zero).withColumn(
            "_w", F.when(F.col("_z") == 1, F.when(F.col("d2") == 0, 1.0).otherwise(0.0)).otherwise(F.lit(1.0) / F.col("dist"))
        )
    else:
        nb = nb.withColumn("_w", F.lit(1.0))
    agg = nb.groupBy(key).agg(
        F.sum(F.when(F.col(f"nb_{label}") == 1, F.col("_w")).otherwise(0.0)).alias("_w1"),
        F.sum(F.when(F.col(f"nb_{label}") != 1, F.col("_w")).otherwise(0.0)).alias("_w0"),
    )
    return agg.select(
        key,
        safe_div(F.col("_w1"), F.col("_w1") + F.col("_w0")).alias("probability_1"),
        F.when(F.col("_w1") > F.col("_w0"), 1).otherwise(0).cast("int").alias("prediction"),
    )


def instance_hardness(train: DataFrame, feats: Sequence[str], cv: int = 5, seed: int = 10, label: str = "label", key: str = "row_id") -> DataFrame:
    """Keep minority rows and the majority rows whose out-of-fold P(true class) is at or
    above the (1 − n_min/n_maj) quantile, so the majority shrinks to the minority size."""
    ensure_checkpoint_dir(train.sparkSession)
    from renewal.operators.split import strat_folds
    from renewal.operators.stats import exact_quantiles

    folds = strat_folds(train.select(key, label), cv, 1, seed).select(key, "fold")
    data = train.join(folds, key).checkpoint()
    oof = None
    for f in range(cv):
        m = random_forest(data.where(F.col("fold") != f), feats, {"n_estimators": 10, "max_depth": 4})
        p = predict(m, data.where(F.col("fold") == f), feats, keep=[key, label])
        p = p.select(key, label, F.when(F.col(label) == 1, F.col("probability_1")).otherwise(1.0 - F.col("probability_1")).alias("p_true"))
        oof = p if oof is None else oof.unionByName(p)
    oof = oof.checkpoint()
    counts = class_counts(train, label)
    n_min, n_maj = counts.get(1, 0), counts.get(0, 0)
    if n_maj == 0 or n_min >= n_maj:
        return train
    thr = exact_quantiles(oof.where(F.col(label) == 0), ["p_true"], 1.0 - n_min / n_maj)["p_true"]
    keep = oof.where((F.col(label) == 1) | (F.col("p_true") >= F.lit(thr))).select(key)
    return train.join(keep, key, "left_semi")
