"""Evaluation (E1, E2): F1 on the positive class and a per-class report.

Both are one conditional-sum aggregation (one row per task shuffled), never a collect of
predictions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewal.functions import safe_div


def confusion(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    y, p = F.col(label), F.col(pred)
    return df.agg(
        F.count(F.when((y == 1) & (p == 1), 1)).alias("tp"),
        F.count(F.when((y == 0) & (p == 1), 1)).alias("fp"),
        F.count(F.when((y == 1) & (p == 0), 1)).alias("fn"),
        F.count(F.when((y == 0) & (p == 0), 1)).alias("tn"),
    )


def f1_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """``tp fp fn tn precision recall f1``; f1 = 2TP/(2TP+FP+FN), 0 when nothing is positive."""
    c = confusion(df, label, pred)
    tp, fp, fn = (F.col(x).cast("double") for x in ("tp", "fp", "fn"))
    return c.select(
        *[F.col(x).cast("bigint").alias(x) for x in ("tp", "fp", "fn", "tn")],
        F.coalesce(safe_div(tp, tp + fp), F.lit(0.0)).alias("precision"),
        F.coalesce(safe_div(tp, tp + fn), F.lit(0.0)).alias("recall"),
        F.coalesce(safe_div(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
    )


def f1_value(df: DataFrame, label: str = "label", pred: str = "prediction") -> float:
    return float(f1_report(df, label, pred).collect()[0]["f1"])


def class_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support for each class (rows: class 1 and class 0),
    from one aggregation pass."""
    c = confusion(df, label, pred)
    rows = []
    for cls, tp_, fp_, fn_ in ((1, "tp", "fp", "fn"), (0, "tn", "fn", "fp")):
        tp, fp, fn = (F.col(x).cast("double") for x in (tp_, fp_, fn_))
        rows.append(
            F.struct(
                F.lit(cls).alias("class"),
                F.coalesce(safe_div(tp, tp + fp), F.lit(0.0)).alias("precision"),
                F.coalesce(safe_div(tp, tp + fn), F.lit(0.0)).alias("recall"),
                F.coalesce(safe_div(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
                (F.col(tp_) + F.col(fn_)).cast("bigint").alias("support"),
            )
        )
    return c.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")
