"""Sources and sinks: CSV/parquet readers with missing-token handling, writers, fixture frames."""

from renewal.sources.frames import docq, dirty, embed, renewal, table
from renewal.sources.io import apply_na_tokens, drop_position, read_table, write_predictions, write_table

__all__ = [
    "apply_na_tokens",
    "dirty",
    "docq",
    "drop_position",
    "embed",
    "read_table",
    "renewal",
    "table",
    "write_predictions",
    "write_table",
]
