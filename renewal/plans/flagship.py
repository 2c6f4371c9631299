"""The flagship path: renewal frame → prune → impute → hold-out → score → F1.

``rule_score`` stands in for a fitted model so the whole path has an exact SQL oracle;
``fitted_flagship`` is the path with a fitted model: prune, weights, hold-out, boosted trees with a
patient stop on the hold-out part, its predictions, F1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renewal.functions import rint_label
from renewal.operators.boosting import BoostParams, NewtonModel, newton_trees
from renewal.operators.evaluate import f1_report
from renewal.operators.impute import impute_mean
from renewal.operators.models import class_weight
from renewal.operators.split import holdout
from renewal.plans.prepare import prune_features_by_split, split_frames
from renewal.session import ensure_checkpoint_dir
from renewal.sources.frames import RENEWAL_FEATURES, renewal


def rule_score(n_orders: str = "n_orders") -> F.Column:
    """P(churn) = 4 / (n_orders + 4): fewer earlier orders, more likely to leave (0.5 at 4)."""
    return F.lit(4.0) / (F.col(n_orders).cast("double") + F.lit(4.0))


def prepared(spark: SparkSession, sf_dir: str):
    """(train, test, kept) with train-mean imputation on the kept features."""
    # several profile passes read this frame: materialise it once in the shared checkpoint
    # folder (cuts the lineage back to the orders aggregation; survives lost executors)
    ensure_checkpoint_dir(spark)
    df = renewal(spark, sf_dir).checkpoint()
    train, test = split_frames(df)
    kept = prune_features_by_split(df, RENEWAL_FEATURES).kept
    cols = ["row_id", *kept, "label"]
    tr, te = impute_mean(train.select(*cols), test.select(*cols), kept)
    return tr, te, kept


def scored_holdout(spark: SparkSession, sf_dir: str, seed: int = 10) -> DataFrame:
    tr, _, _ = prepared(spark, sf_dir)
    split = holdout(tr, 0.25, seed)
    valid = split.where("is_valid")
    return valid.select("row_id", "label", rule_score().alias("probability_1")).withColumn("prediction", rint_label("probability_1"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: confusion counts, precision, recall and F1 of the hold-out part."""
    return f1_report(scored_holdout(spark, sf_dir))


#: The booster of the fitted path.
FITTED = BoostParams(rounds=40, eta=0.1, max_depth=4, reg_alpha=0.1, min_child_weight=2, max_delta_step=4, patience=15)


def fitted_parts(spark: SparkSession, sf_dir: str, seed: int = 10) -> tuple[DataFrame, DataFrame, list[str]]:
    """(weighted training rows with ``is_valid``, test rows, kept features); nulls stay nulls."""
    ensure_checkpoint_dir(spark)
    df = renewal(spark, sf_dir).checkpoint()
    kept = prune_features_by_split(df, RENEWAL_FEATURES).kept
    train, test = split_frames(df.select("row_id", "split", *kept, "label"))
    return class_weight(holdout(train, 0.25, seed)).checkpoint(), test, kept


def fitted_model(spark: SparkSession, sf_dir: str, params: BoostParams = FITTED) -> tuple[NewtonModel, DataFrame, DataFrame]:
    """The model fitted on the pruned features, with its weighted training rows and the test rows."""
    parts, test, kept = fitted_parts(spark, sf_dir)
    return newton_trees(parts, kept, params, valid="is_valid"), parts, test


def fitted_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: confusion counts, precision, recall and F1 of the fitted model on the hold-out part."""
    model, parts, _ = fitted_model(spark, sf_dir)
    return f1_report(model.predict(parts.where("is_valid")))
