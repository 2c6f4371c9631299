"""The shared preparation chain: clean, prune constants, correlates and sparse columns.

Each decision is a small aggregate job whose result (one row per feature) reaches the
driver as a name list; the data itself is only ever projected.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewal.functions import numeric_columns
from renewal.operators.correlation import corr_matrix, correlated_report
from renewal.operators.profile import constant_report, kept_columns, sparse_report


def split_frames(df: DataFrame, split_col: str = "split") -> tuple[DataFrame, DataFrame]:
    """(train, test) of a frame that carries a split column."""
    return df.where(F.col(split_col) == "train"), df.where(F.col(split_col) == "test")


@dataclass
class Pruned:
    after_constant: list[str] = field(default_factory=list)
    after_correlation: list[str] = field(default_factory=list)
    kept: list[str] = field(default_factory=list)


def correlation_kept(train: DataFrame, test: DataFrame, cols: Sequence[str], threshold: float = 0.75) -> list[str]:
    """Numeric columns not dropped by the correlation rule in train **and** not in test (A6 + A7).

    Text columns are not part of the correlation matrix and vanish here, as in the original.
    """
    numeric = [c for c in cols if c in set(numeric_columns(train.select(*cols)))]
    keep_train = set(kept_columns(correlated_report(corr_matrix(train, numeric), numeric, threshold)))
    keep_test = set(kept_columns(correlated_report(corr_matrix(test, numeric), numeric, threshold)))
    return [c for c in numeric if c in keep_train and c in keep_test]


def prune_features(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    corr_threshold: float = 0.75,
    sparse_threshold: float = 0.4,
) -> Pruned:
    out = Pruned()
    # several small aggregate jobs read the same narrow projection: keep it for their duration
    train = train.select(*features).persist(StorageLevel.MEMORY_AND_DISK)
    test = test.select(*features).persist(StorageLevel.MEMORY_AND_DISK)
    out.after_constant = kept_columns(constant_report(train, test, features))
    out.after_correlation = correlation_kept(train, test, out.after_constant, corr_threshold)
    out.kept = kept_columns(sparse_report(train, test, out.after_correlation, sparse_threshold))
    train.unpersist()
    test.unpersist()
    return out


def prune_features_by_split(
    df: DataFrame,
    features: Sequence[str],
    split: str = "split",
    corr_threshold: float = 0.75,
    sparse_threshold: float = 0.4,
) -> Pruned:
    """``prune_features`` when train and test are slices of one table: each step is one
    grouped pass (constants, both correlation matrices, null counts) instead of one per slice."""
    from renewal.operators.profile import constant_report_by_split, sparse_report_by_split

    out = Pruned()
    data = df.select(split, *features).persist(StorageLevel.MEMORY_AND_DISK)
    out.after_constant = kept_columns(constant_report_by_split(data, features, split))
    numeric = [c for c in out.after_constant if c in set(numeric_columns(data.select(*out.after_constant)))]
    corr = corr_matrix(data, numeric, group=split).persist(StorageLevel.MEMORY_AND_DISK)
    keep_train = set(kept_columns(correlated_report(corr.where(F.col(split) == "train"), numeric, corr_threshold)))
    keep_test = set(kept_columns(correlated_report(corr.where(F.col(split) == "test"), numeric, corr_threshold)))
    out.after_correlation = [c for c in numeric if c in keep_train and c in keep_test]
    out.kept = kept_columns(sparse_report_by_split(data, out.after_correlation, sparse_threshold, split))
    corr.unpersist()
    data.unpersist()
    return out
