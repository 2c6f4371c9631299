"""Feature importance from fitted tree models.

A tree ensemble is saved to the shared checkpoint folder and its node table read back as a
DataFrame: split counts and average gains are then plain ``groupBy`` aggregations over the
model's nodes, never a walk over Python objects.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renewal.session import ensure_checkpoint_dir


def node_table(spark: SparkSession, model) -> DataFrame:
    """``(feature_index, gain)`` of every internal node of a saved tree model."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    nodes = data.select("nodeData.*") if "nodeData" in data.columns else data
    return nodes.select(F.col("split.featureIndex").alias("feature_index"), F.col("gain")).where(F.col("feature_index") >= 0)


def _names(spark: SparkSession, feats: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(i, f) for i, f in enumerate(feats)], "feature_index int, feature string")


def split_importance(spark: SparkSession, model, feats: Sequence[str]) -> DataFrame:
    """Number of splits per feature ('weight' / 'split'); unused features are absent."""
    counts = node_table(spark, model).groupBy("feature_index").agg(F.count(F.lit(1)).cast("bigint").alias("importance"))
    return counts.join(F.broadcast(_names(spark, feats)), "feature_index").select("feature", "importance")


def gain_importance(spark: SparkSession, model, feats: Sequence[str]) -> DataFrame:
    """Average split gain per feature ('gain')."""
    gains = node_table(spark, model).groupBy("feature_index").agg(F.avg("gain").alias("importance"))
    return gains.join(F.broadcast(_names(spark, feats)), "feature_index").select("feature", "importance")


def top_features(imp: DataFrame, n: int = 30) -> DataFrame:
    """E5: the n most important features (ties by name) — a top-k report, so the limit is the feature."""
    return imp.orderBy(F.desc("importance"), "feature").limit(n)


def used_features(imp: DataFrame, feats: Sequence[str]) -> list[str]:
    """Features with at least one split, in the original order (bounded by the schema width)."""
    used = {r["feature"] for r in imp.where(F.col("importance") > 0).select("feature").collect()}
    return [f for f in feats if f in used]
