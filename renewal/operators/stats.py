"""Exact order statistics by radix selection, without gathering a column into one task.

Doubles map to 64-bit numbers of the same order.  A first job counts every column's values by
their leading 16 bits; the digit that holds the wanted rank becomes the prefix, and the next job
counts the next 16 bits of the values that have it, for all columns at once.  Four digits give the
value itself.  A bracket of at most ``exact_limit`` values is read in one step, by all bits that
are left.  Counts are summed per batch before the shuffle, so a value that most rows hold costs a
row per batch, and a group holds at most 65,536 (or ``exact_limit``) digits of one column: no column
is sorted and no bracket can be missed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXACT_LIMIT = 1 << 16
DIGIT_BITS = 16
_TOP = np.uint64(1 << 63)


def ordered(values: np.ndarray) -> np.ndarray:
    """64-bit numbers in the order of the doubles; both zeros are one."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & _TOP, ~bits, bits | _TOP)


def unordered(key: int) -> float:
    bits = np.array([key], np.uint64)
    return float(np.where(bits & _TOP, bits & ~_TOP, ~bits).view(np.float64)[0])


def _digits(df: DataFrame, names: Sequence[str], brackets: list[tuple[int, int, int, int]]) -> DataFrame:
    """bracket, digit, n: counts of the next digit.  A bracket: column, its prefix, bits left, bits after the digit."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: dict[int, np.ndarray] = {}
            for i, (c, prefix, left, after) in enumerate(brackets):
                if c not in keys:
                    v = pc.fill_null(batch.column(names[c]), float("nan")).to_numpy(zero_copy_only=False)
                    keys[c] = ordered(v[~np.isnan(v)])
                k = keys[c] if left == 64 else keys[c][keys[c] >> np.uint64(left) == np.uint64(prefix)]
                digit, n = np.unique(k & np.uint64((1 << left) - 1) if left < 64 else k, return_counts=True)
                digit, first = np.unique(digit >> np.uint64(after), return_index=True)
                if len(digit):
                    n = np.add.reduceat(n, first)
                    yield pa.RecordBatch.from_pydict({"bracket": pa.array(np.full(len(digit), i, np.int32)), "digit": pa.array(digit.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    return df.mapInArrow(count, "bracket int, digit long, n long").groupBy("bracket", "digit").agg(F.sum("n").alias("n"))


def _picker(wanted: list[dict[str, int] | None], q: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        """The digits that hold the wanted ranks of one bracket."""
        i = int(frame["bracket"].iloc[0])
        frame = frame.sort_values("digit")
        upto = frame["n"].cumsum().to_numpy()
        at = (upto[-1] - 1) * q
        ranks = wanted[i] or {"lo": math.floor(at), "hi": math.ceil(at)}
        place = np.searchsorted(upto, list(ranks.values()), "right")
        n = frame["n"].to_numpy()[place]
        return pd.DataFrame({"bracket": np.int32(i), "side": list(ranks), "digit": frame["digit"].to_numpy()[place], "rank": np.array(list(ranks.values())) - (upto[place] - n), "n": n, "share": at - math.floor(at)})

    return pick


def exact_medians(df: DataFrame, cols: Sequence[str], exact_limit: int = EXACT_LIMIT) -> dict[str, float | None]:
    """Median per column (mean of the two middle values for even counts), nulls ignored."""
    return exact_quantiles(df, cols, 0.5, exact_limit)


def exact_quantiles(df: DataFrame, cols: Sequence[str], q: float, exact_limit: int = EXACT_LIMIT) -> dict[str, float | None]:
    """Quantile q per column with linear interpolation between the ranks floor/ceil((n-1)q).

    Nulls and NaN are left out; a column without values gives None.
    """
    cols = list(cols)
    names = [f"c{i}" for i in range(len(cols))]
    rows = df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(cols, names, strict=True)])
    # (column, prefix, bits left, bits after the next digit) -> wanted ranks inside; None: from the count
    brackets: dict[tuple[int, int, int, int], dict[str, int] | None] = {(i, 0, 64, 64 - DIGIT_BITS): None for i in range(len(cols))}
    found: dict[tuple[int, str], float] = {}
    share: dict[int, float] = {}
    while brackets:
        keys, wanted = list(brackets), list(brackets.values())
        counted = _digits(rows, names, keys)
        picked = counted.groupBy("bracket").applyInPandas(_picker(wanted, q), "bracket int, side string, digit long, rank long, n long, share double").collect()  # two rows a column
        brackets = {}
        for r in picked:
            c, prefix, left, after = keys[r["bracket"]]
            if left == 64:
                share[c] = r["share"]
            prefix = (prefix << (left - after)) | r["digit"]
            if after == 0:
                found[c, r["side"]] = unordered(prefix)
            else:
                key = (c, prefix, after, 0 if r["n"] <= exact_limit else max(0, after - DIGIT_BITS))
                brackets.setdefault(key, {})[r["side"]] = r["rank"]
    out: dict[str, float | None] = {}
    for i, c in enumerate(cols):
        lo, hi = found.get((i, "lo")), found.get((i, "hi"))
        out[c] = None if lo is None or hi is None else lo if lo == hi else lo + (hi - lo) * share[i]
    return out
