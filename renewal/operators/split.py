"""Reproducible splits and random undersampling.

Randomness is a hash of ``seed:row_id`` (never ``rand()``/``randomSplit``, which depend on
the partitioning), so results are equal under any repartitioning and equal to the DuckDB
oracle.  Exact sizes need exact ranks; ``hash_rank`` gets them without a global sort and
without putting a whole class into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from renewal.functions import hash_u32

RANK_BUCKET_BITS = 20


def hash_rank(
    df: DataFrame,
    order: Column,
    tie: str = "row_id",
    groups: Sequence[str] = (),
    out: str = "_rank",
    bucket_bits: int = RANK_BUCKET_BITS,
) -> DataFrame:
    """Exact 0-based rank by ``(order, tie)`` within ``groups``; adds ``out`` and ``_group_rows``.

    ``order`` must be a uniform unsigned 32-bit hash.  Its top ``bucket_bits`` bits cut every
    group into up to 2**bucket_bits buckets of similar size (a class holding most rows is
    still spread over a million keys).  A count per ``(group, bucket)`` — at most
    groups × 2**bucket_bits rows — gives each bucket its offset by a running sum; a
    ``row_number`` inside each bucket gives the rest.  ``groups`` must be low-cardinality
    (class label, repeat index).  The input is read twice — a partially aggregated count and
    the ranked rows — which is cheaper than deriving the counts from the sorted rows; pass a
    materialised (checkpointed) frame when the input is expensive to recompute.
    """
    g = list(groups)
    shift = 32 - bucket_bits
    keyed = df.withColumn("_h", order).withColumn("_b", F.shiftright(F.col("_h"), shift))
    counts = keyed.groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    running = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*g)
    offsets = counts.select(
        *g,
        "_b",
        F.coalesce(F.sum("_cnt").over(running), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(whole).alias("_group_rows"),
    )
    inner = Window.partitionBy(*g, "_b").orderBy("_h", tie)
    ranked = keyed.withColumn("_rn", F.row_number().over(inner) - 1)
    return (
        ranked.join(offsets, [*g, "_b"])
        .withColumn(out, (F.col("_off") + F.col("_rn")).cast("bigint"))
        .drop("_h", "_b", "_off", "_rn")
    )


def holdout(df: DataFrame, test_size: float = 0.25, seed: int = 10, key: str = "row_id") -> DataFrame:
    """Shuffled, not stratified hold-out; adds ``is_valid`` (exactly ceil(test_size·n) rows).

    The first ceil(test_size·n) rows in ``md5(seed:key)`` order are the validation part.
    """
    ranked = hash_rank(df, hash_u32(seed, key), tie=key)
    n_valid = F.ceil(F.lit(float(test_size)) * F.col("_group_rows"))
    return ranked.withColumn("is_valid", F.col("_rank") < n_valid).drop("_rank", "_group_rows")


def strat_folds(df: DataFrame, n_splits: int = 5, n_repeats: int = 2, seed: int = 10, label: str = "label", key: str = "row_id") -> DataFrame:
    """Repeated stratified k-fold; returns ``(key, repeat, fold)`` for every row and repeat.

    Within each repeat and class, rows are ranked by ``md5(seed:repeat:key)`` and the fold is
    rank mod k, so per class the fold sizes differ by at most one.
    """
    # all repeats in one ranking: each row once per repeat, ranked within (repeat, class)
    base = df.select(key, label).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))))
    ranked = hash_rank(base, hash_u32(seed, "repeat", key), tie=key, groups=["repeat", label])
    return ranked.select(key, F.col("repeat").cast("int").alias("repeat"), (F.col("_rank") % n_splits).cast("int").alias("fold"))


def class_counts(df: DataFrame, label: str = "label") -> dict[int, int]:
    """Rows per class (one row per class reaches the driver)."""
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


def under_quotas(counts: dict[int, int], strategy: float | str = "auto") -> dict[int, int]:
    """Rows to keep per class for undersampling (imbalanced-learn semantics)."""
    if not counts:
        return {}
    minority = min(counts, key=lambda c: (counts[c], c))
    majority = max(counts, key=lambda c: (counts[c], -c))
    n_min = counts[minority]
    if isinstance(strategy, (int, float)) and not isinstance(strategy, bool):
        if len(counts) != 2:
            raise ValueError("a float sampling strategy needs exactly two classes")
        if not 0 < strategy <= 1:
            raise ValueError(f"sampling ratio must be in (0, 1], got {strategy}")
        want = int(n_min / float(strategy))
        if want > counts[majority]:
            raise ValueError(f"ratio {strategy} would need more majority rows ({want}) than exist ({counts[majority]})")
        return {minority: n_min, majority: want}
    targets = {
        "auto": [c for c in counts if c != minority],
        "not minority": [c for c in counts if c != minority],
        "majority": [majority],
        "not majority": [c for c in counts if c != majority],
        "all": list(counts),
    }
    if strategy not in targets:
        raise ValueError(f"unknown sampling strategy {strategy!r}")
    return {c: (min(n, n_min) if c in targets[strategy] else n) for c, n in counts.items()}


def undersample(df: DataFrame, strategy: float | str = "auto", seed: int = 10, label: str = "label", key: str = "row_id") -> DataFrame:
    """Random undersampling; per class keep the first ``quota`` rows in ``md5(seed:key)`` order."""
    quotas = under_quotas(class_counts(df, label), strategy)
    quota = F.lit(None).cast("bigint")
    for c, q in quotas.items():
        quota = F.when(F.col(label) == c, F.lit(q)).otherwise(quota)
    ranked = hash_rank(df, hash_u32(seed, key), tie=key, groups=[label])
    return ranked.where(F.col("_rank") < quota).drop("_rank", "_group_rows")

