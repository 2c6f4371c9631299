"""Profiling aggregations and column pruning.

Profiles are long tables ``(column, ordinal, ...)``, one row per feature, so they stay
small (bounded by the schema width, never by the row count).  Each split is scanned once
per profile with one aggregation that has map-side partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from renewal.functions import safe_div


def _long(row: DataFrame, cols: Sequence[str], value: str, cast: str = "bigint") -> DataFrame:
    """Turn a one-row aggregate with one column per feature into ``(column, ordinal, value)``."""
    items = [
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("ordinal"), F.col(f"`{c}`").cast(cast).alias(value))
        for i, c in enumerate(cols)
    ]
    keep = [c for c in row.columns if c.startswith("_")]
    return row.select(*keep, F.explode(F.array(*items)).alias("_s")).select(*keep, "_s.*")


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, ordinal, nulls, _rows)`` for one split, in one pass (count(*) - count(c))."""
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[(F.count(F.lit(1)) - F.count(F.col(c))).alias(c) for c in cols])
    return _long(row, cols, "nulls")


def null_profile(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A1: null count per column in train and test, side by side."""
    a = null_counts(train, cols).select("column", "ordinal", F.col("nulls").alias("nulls_train"), F.col("_rows").alias("rows_train"))
    b = null_counts(test, cols).select("column", "ordinal", F.col("nulls").alias("nulls_test"), F.col("_rows").alias("rows_test"))
    return a.join(b, ["column", "ordinal"])


def _value_long(df: DataFrame, cols: Sequence[str], ordinal: dict[str, int]) -> DataFrame:
    """Unpivot to ``(column, ordinal, value)`` with the non-null values, in one pass.

    Numbers become text through double (so 1 and 1.0 are one value; -0.0 is folded into
    0.0, as pandas ``nunique`` does); text stays as is.
    """
    types = dict(df.dtypes)

    def as_text(c: str):
        if types[c] == "string":
            return F.col(c)
        x = F.col(c).cast("double")
        return F.when(x == 0, F.lit(0.0)).otherwise(x).cast("string")

    items = [F.struct(F.lit(c).alias("column"), F.lit(ordinal[c]).alias("ordinal"), as_text(c).alias("value")) for c in cols]
    return df.select(F.explode(F.array(*items)).alias("_s")).select("_s.*").where(F.col("value").isNotNull())


def distinct_counts(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """``(column, ordinal, nunique)``: distinct non-null values per column (pandas ``nunique``).

    Exact: unpivot, de-duplicate ``(column, value)`` with a partial aggregation, then count per
    column — two narrow shuffles instead of one ``countDistinct`` per column (each of which
    would expand every row).  ``approx``: one HyperLogLog++ pass, no value shuffle at all.
    """
    ordinal = {c: i for i, c in enumerate(cols)}
    if approx:
        row = df.agg(F.lit(0).alias("_z"), *[F.approx_count_distinct(F.col(c)).alias(c) for c in cols])
        return _long(row, cols, "nunique").drop("_z")
    long = _value_long(df, cols, ordinal)
    counted = long.select("column", "ordinal", "value").distinct().groupBy("column", "ordinal").agg(F.count(F.lit(1)).alias("nunique"))
    # every column appears, also those with no value at all (nunique 0)
    names = df.sparkSession.createDataFrame([(c, i) for c, i in ordinal.items()], "column string, ordinal int")
    return names.join(counted, ["column", "ordinal"], "left").select("column", "ordinal", F.coalesce("nunique", F.lit(0)).cast("bigint").alias("nunique"))


def distinct_profile(train: DataFrame, test: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """A2: distinct non-null counts in train and test."""
    a = distinct_counts(train, cols, approx).withColumnRenamed("nunique", "nunique_train")
    b = distinct_counts(test, cols, approx).withColumnRenamed("nunique", "nunique_test")
    return a.join(b, ["column", "ordinal"])


def unique_values(df: DataFrame, col: str) -> DataFrame:
    """A3: the distinct values of one column, null included (as pandas ``unique``)."""
    return df.select(col).distinct()


def constant_flags(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, ordinal, constant)``: exactly one distinct non-null value, via min = max.

    min/max is one cheap pass with a tiny aggregation buffer; an all-null column has a null
    minimum and is *not* constant (its distinct count is 0, not 1).
    """
    row = df.agg(F.lit(0).alias("_z"), *[F.coalesce(F.min(c) == F.max(c), F.lit(False)).alias(c) for c in cols])
    return _long(row, cols, "constant", cast="boolean").drop("_z")


def constant_report(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A4 decision table: drop when constant in train **or** test."""
    a = constant_flags(train, cols).withColumnRenamed("constant", "constant_train")
    b = constant_flags(test, cols).withColumnRenamed("constant", "constant_test")
    return a.join(b, ["column", "ordinal"]).withColumn("drop", F.col("constant_train") | F.col("constant_test"))


def sparse_report(train: DataFrame, test: DataFrame, cols: Sequence[str], threshold: float = 0.4) -> DataFrame:
    """A9 decision table: drop when nulls ≥ threshold in train **or** test.

    ``threshold`` ≥ 1 is an absolute count (the original 4000); below 1 it is a fraction of
    the split's row count, which carries over to other table sizes.
    """
    prof = null_profile(train, test, cols)

    def limit(rows: Column) -> Column:
        return F.lit(float(threshold)) if threshold >= 1 else F.lit(float(threshold)) * rows

    return prof.withColumn(
        "drop", (F.col("nulls_train") >= limit(F.col("rows_train"))) | (F.col("nulls_test") >= limit(F.col("rows_test")))
    )


def kept_columns(report: DataFrame) -> list[str]:
    """Collect a decision table (one row per feature: bounded by the schema) → kept names in order."""
    rows = report.where(~F.col("drop")).select("column", "ordinal").collect()
    return [r["column"] for r in sorted(rows, key=lambda r: r["ordinal"])]


def intersect_kept(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names kept in both lists (left-semi), ordinal order."""
    return a.join(b.select("column"), "column", "left_semi").orderBy("ordinal")


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per label with the negative/positive ratio (the count plot's data)."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    # the grouped table has one row per class, so a window over all of it is tiny
    everything = Window.partitionBy()
    return counts.select(
        "label",
        "n",
        F.sum("n").over(everything).alias("_total"),
        F.sum(F.when(F.col("label") == 0, F.col("n"))).over(everything).alias("_neg"),
        F.sum(F.when(F.col("label") == 1, F.col("n"))).over(everything).alias("_pos"),
    ).select(
        "label",
        F.col("n").cast("bigint").alias("n"),
        safe_div(F.col("n").cast("double"), F.col("_total").cast("double")).alias("share"),
        safe_div(F.col("_neg").cast("double"), F.col("_pos").cast("double")).alias("neg_pos_ratio"),
    )


def dtype_split(df: DataFrame, exclude: Sequence[str] = ()) -> list[tuple[str, str]]:
    """``(column, 'numeric' | 'text' | 'other')`` from the schema (no data pass)."""
    out = []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)):
            out.append((f.name, "numeric"))
        elif isinstance(f.dataType, T.StringType):
            out.append((f.name, "text"))
        else:
            out.append((f.name, "other"))
    return out


# ---------------------------------------------------------------- one pass over a split column
# When train and test are two slices of one table, each profile is a single scan grouped by
# the split column (two groups, partial aggregation) instead of one scan per slice.


def _by_split(df: DataFrame, split: str, aggs: dict[str, Column], cols: Sequence[str], cast: str) -> DataFrame:
    """``(column, ordinal, <name>_train, <name>_test …)`` from one grouped aggregation."""
    grouped = df.groupBy(F.col(split).alias("_split")).agg(
        *[e.alias(f"{name}__{i}") for i in range(len(cols)) for name, e in [(n, f(cols[i])) for n, f in aggs.items()]]
    )
    items = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(i).alias("ordinal"),
            *[F.col(f"{name}__{i}").cast(cast).alias(name) for name in aggs],
        )
        for i, c in enumerate(cols)
    ]
    long = grouped.select("_split", F.explode(F.array(*items)).alias("_s")).select("_split", "_s.*")
    out = long.groupBy("column", "ordinal").agg(
        *[F.max(F.when(F.col("_split") == s, F.col(name))).alias(f"{name}_{s}") for name in aggs for s in ("train", "test")]
    )
    return out


def null_profile_by_split(df: DataFrame, cols: Sequence[str], split: str = "split") -> DataFrame:
    """A1 in one pass: ``(column, ordinal, nulls_train, rows_train, nulls_test, rows_test)``."""
    aggs = {"nulls": lambda c: F.count(F.lit(1)) - F.count(F.col(c)), "rows": lambda c: F.count(F.lit(1))}
    return _by_split(df, split, aggs, cols, "bigint")


def constant_report_by_split(df: DataFrame, cols: Sequence[str], split: str = "split") -> DataFrame:
    """A4 in one pass."""
    aggs = {"constant": lambda c: F.coalesce(F.min(c) == F.max(c), F.lit(False))}
    out = _by_split(df, split, aggs, cols, "boolean")
    return out.select(
        "column", "ordinal",
        F.coalesce("constant_train", F.lit(False)).alias("constant_train"),
        F.coalesce("constant_test", F.lit(False)).alias("constant_test"),
    ).withColumn("drop", F.col("constant_train") | F.col("constant_test"))


def sparse_report_by_split(df: DataFrame, cols: Sequence[str], threshold: float = 0.4, split: str = "split") -> DataFrame:
    """A9 in one pass."""
    prof = null_profile_by_split(df, cols, split)

    def limit(rows: Column) -> Column:
        return F.lit(float(threshold)) if threshold >= 1 else F.lit(float(threshold)) * rows

    return prof.withColumn(
        "drop", (F.col("nulls_train") >= limit(F.col("rows_train"))) | (F.col("nulls_test") >= limit(F.col("rows_test")))
    )


def distinct_profile_by_split(df: DataFrame, cols: Sequence[str], split: str = "split") -> DataFrame:
    """A2 in one pass: one unpivot, de-duplicate ``(split, column, value)``, count per split."""
    ordinal = {c: i for i, c in enumerate(cols)}
    types = dict(df.dtypes)

    def as_text(c: str):
        if types[c] == "string":
            return F.col(c)
        x = F.col(c).cast("double")
        return F.when(x == 0, F.lit(0.0)).otherwise(x).cast("string")

    items = [F.struct(F.lit(c).alias("column"), F.lit(ordinal[c]).alias("ordinal"), as_text(c).alias("value")) for c in cols]
    long = df.select(F.col(split).alias("_split"), F.explode(F.array(*items)).alias("_s")).select("_split", "_s.*").where(F.col("value").isNotNull())
    counted = long.distinct().groupBy("column", "ordinal").agg(
        F.count(F.when(F.col("_split") == "train", 1)).alias("nunique_train"),
        F.count(F.when(F.col("_split") == "test", 1)).alias("nunique_test"),
    )
    names = df.sparkSession.createDataFrame([(c, i) for c, i in ordinal.items()], "column string, ordinal int")
    return names.join(counted, ["column", "ordinal"], "left").select(
        "column", "ordinal",
        F.coalesce("nunique_train", F.lit(0)).cast("bigint").alias("nunique_train"),
        F.coalesce("nunique_test", F.lit(0)).cast("bigint").alias("nunique_test"),
    )
