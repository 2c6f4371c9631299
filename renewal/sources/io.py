"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renewal.functions import PANDAS_NA_TOKENS, string_columns


def apply_na_tokens(df: DataFrame, tokens: Iterable[str] = PANDAS_NA_TOKENS, cols: Iterable[str] | None = None) -> DataFrame:
    """Whole-cell match of any token → null on the string columns (or ``cols``)."""
    toks = list(tokens)
    targets = set(cols) if cols is not None else set(string_columns(df))
    return df.select(
        *[
            F.when(F.col(c).isin(toks), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c) if c in targets else F.col(c)
            for c in df.columns
        ]
    )


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    na_tokens: Iterable[str] | None = PANDAS_NA_TOKENS,
    key: str | None = "row_id",
) -> DataFrame:
    """Read a headered CSV (every column as text, no inference pass) or a parquet table.

    ``key`` renames the leading index column (Spark calls an unnamed header ``_c0``) and casts
    it to bigint; rows have no order in Spark, so the index is kept as the row key instead of
    being thrown away.  ``na_tokens`` gives pandas' missing-value tokens; ``None`` keeps text.
    """
    if fmt == "csv":
        df = spark.read.option("header", True).csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    if na_tokens is not None:
        df = apply_na_tokens(df, na_tokens)
    if key is not None:
        first = df.columns[0]
        df = df.withColumnRenamed(first, key).withColumn(key, F.col(key).cast("bigint"))
    return df


def drop_position(df: DataFrame, position: int = 0) -> DataFrame:
    """Drop a column by its position."""
    return df.drop(df.columns[position])


def write_predictions(df: DataFrame, path: str, key: str = "row_id", label: str = "prediction", header: bool = False) -> None:
    """One label per row as CSV (S3).  The key is written too: row order is not a contract."""
    df.select(key, F.col(label).cast("int").alias(label)).write.mode("overwrite").option("header", header).csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Results tables (S4: search results, importances) to CSV or parquet."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
