from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The text tokens pandas' CSV reader turns into missing by default
# (public pandas documentation, ``na_values``).  Spark only nulls the empty cell.
PANDAS_NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "n/a",
    "nan",
    "null",
)

# A finite decimal number, optionally signed, with optional exponent and surrounding blanks.
# Spark alone would also accept '1d' / '1f' (Java suffixes) and DuckDB '1_0'; both are text.
NUMERIC_TEXT_PATTERN = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def hash_u32(seed: int | str, *cols: str | Column) -> Column:
    """Unsigned 32-bit integer from the first 8 hex digits of md5('seed:c1:c2...').

    Independent of partitioning and of the engine (DuckDB: ``('0x'||substr(md5(..),1,8))::ubigint``).
    """
    parts: list[Column] = [F.lit(str(seed))]
    for c in cols:
        parts.append(F.lit(":"))
        parts.append(_c(c).cast("string"))
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 8), 16, 10).cast("bigint")


def uniform(seed: int | str, *cols: str | Column) -> Column:
    """Deterministic uniform draw in [0, 1): ``hash_u32 / 2**32``."""
    return hash_u32(seed, *cols) / F.lit(4294967296.0)


def is_numeric_text(col: str | Column) -> Column:
    return _c(col).rlike(NUMERIC_TEXT_PATTERN)


def rint_label(prob: str | Column) -> Column:
    """Probability → label by round-half-to-even (0.5 → 0), as numpy ``rint`` does."""
    return F.rint(_c(prob)).cast("int")


def safe_div(num: Column, den: Column) -> Column:
    """Division that yields null on a zero or null denominator, also under ANSI mode."""
    return F.try_divide(num, den)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]
