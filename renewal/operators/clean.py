"""Cleaning, casts and projections."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from renewal.functions import is_numeric_text, string_columns


def null_sentinel(df: DataFrame, token: str = "#", cols: Iterable[str] | None = None) -> DataFrame:
    """A cell that is exactly ``token`` becomes null ('a#' stays), on every string column."""
    targets = set(cols) if cols is not None else set(string_columns(df))
    return df.select(
        *[
            F.when(F.col(c) == token, F.lit(None).cast("string")).otherwise(F.col(c)).alias(c) if c in targets else F.col(c)
            for c in df.columns
        ]
    )


def normalize_nan(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """NaN → null on float columns (Spark counts NaN as a value; the data model has one missing)."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    targets = floats & set(cols) if cols is not None else floats
    return df.select(*[F.nanvl(F.col(c), F.lit(None)).alias(c) if c in targets else F.col(c) for c in df.columns])


def split_label(df: DataFrame, label: str = "target", key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """(features, label) by name; both keep the row key, so nothing relies on row order."""
    feats = df.drop(label)
    lab = df.select(key, F.col(label).cast("int").alias("label"))
    return feats, lab


def cast_strict(df: DataFrame, cols: Sequence[str], to: str = "double") -> DataFrame:
    """Text → number; a non-null cell that is not a number fails the job (CAST_INVALID_INPUT style).

    For an integer target a number with a fraction fails too.
    """
    wanted = set(cols)
    whole = to in ("int", "integer", "long", "bigint", "smallint", "tinyint")

    def conv(c: str):
        v = F.col(c)
        ok = v.isNull() | is_numeric_text(v)
        if whole:
            number = F.when(is_numeric_text(v), F.trim(v).cast("double"))
            ok = ok & (number.isNull() | (number == F.floor(number)))
        msg = F.concat(F.lit(f"cast_strict: column {c} has non-numeric text '"), v, F.lit("'"))
        return F.when(ok, F.trim(v).cast("double").cast(to)).otherwise(F.raise_error(msg).cast(to)).alias(c)

    return df.select(*[conv(c) if c in wanted else F.col(c) for c in df.columns])


def cast_coerce(df: DataFrame, cols: Sequence[str], to: str = "double") -> DataFrame:
    """Text → number; anything that is not a finite decimal number becomes null."""
    wanted = set(cols)

    def conv(c: str):
        v = F.col(c)
        return F.when(is_numeric_text(v), F.trim(v).cast("double")).cast(to).alias(c)

    return df.select(*[conv(c) if c in wanted else F.col(c) for c in df.columns])


def select_features(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """P5: keep the key columns then ``names`` in the given (ordinal) order."""
    cols = [c for c in keep if c in df.columns] + [c for c in names if c not in keep]
    return df.select(*cols)
