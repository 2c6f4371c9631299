"""Column expressions shared by the operators.

Everything here returns a ``pyspark.sql.Column`` built from built-in functions, so it stays
inside whole-stage codegen.  Each helper has a DuckDB twin in ``renewal.plans.oracle`` that
computes the same value, which is what makes the oracle checks exact.
"""

from renewal.functions.columns import (
    NUMERIC_TEXT_PATTERN,
    PANDAS_NA_TOKENS,
    hash_u32,
    is_numeric_text,
    numeric_columns,
    rint_label,
    safe_div,
    string_columns,
    uniform,
)

__all__ = [
    "NUMERIC_TEXT_PATTERN",
    "PANDAS_NA_TOKENS",
    "hash_u32",
    "is_numeric_text",
    "numeric_columns",
    "rint_label",
    "safe_div",
    "string_columns",
    "uniform",
]
