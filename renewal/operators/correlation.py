"""Pairwise-complete absolute Pearson correlation (A5) and the correlation prune.

Two physical paths, same result:

* ``gram`` (default): each partition computes masked Gram blocks with numpy
  (``N = MᵀM``, ``Sx = XᵀM``, ``Sxx = (X²)ᵀM``, ``Sxy = XᵀX`` plus masked min/max) in an
  Arrow-batched ``mapInPandas``; the blocks are summed by ``groupBy(i, j)``.  One pass over the
  data after a cheap mean pass used as a shift (keeps the raw moments well conditioned).
  Shuffle: one row per pair per task.
* ``pairs`` (cross-check): one JVM aggregation with ``covar_pop / (stddev_pop · stddev_pop)``
  per pair, each restricted to rows where both values are present.  Exact and codegen'd,
  but its plan grows with p² aggregates and compiles slowly (measured ~7× slower at p = 11).

A pair is undefined (null, never NaN) when fewer than two rows hold both values or either
side is constant over those rows.  ``corr`` itself is avoided: under ANSI mode it raises
DIVIDE_BY_ZERO on constant pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_GRAM_SCHEMA = (
    "i int, j int, n bigint, sx double, sy double, sxx double, syy double, sxy double, "
    "minx double, maxx double, miny double, maxy double"
)


def _pairs_path(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    aggs = []
    pairs = []
    for i, a in enumerate(cols):
        for j in range(i + 1, len(cols)):
            b = cols[j]
            x, y = F.col(a).cast("double"), F.col(b).cast("double")
            xb = F.when(y.isNotNull(), x)
            yb = F.when(x.isNotNull(), y)
            k = f"{i}_{j}"
            aggs += [
                F.covar_pop(x, y).alias(f"c{k}"),
                F.stddev_pop(xb).alias(f"sx{k}"),
                F.stddev_pop(yb).alias(f"sy{k}"),
                F.count(xb).alias(f"n{k}"),
            ]
            pairs.append((i, j, k))
    if not pairs:
        return df.sparkSession.createDataFrame([], "i int, j int, n bigint, r double")
    row = df.agg(*aggs)
    items = [
        F.struct(
            F.lit(i).alias("i"),
            F.lit(j).alias("j"),
            F.col(f"n{k}").cast("bigint").alias("n"),
            F.when(
                (F.col(f"n{k}") >= 2) & (F.col(f"sx{k}") > 0) & (F.col(f"sy{k}") > 0),
                F.try_divide(F.col(f"c{k}"), F.col(f"sx{k}") * F.col(f"sy{k}")),
            ).alias("r"),
        )
        for i, j, k in pairs
    ]
    return row.select(F.explode(F.array(*items)).alias("_s")).select("_s.*")


def _gram_blocks(cols: Sequence[str], shifts: dict, group: str | None):
    p = len(cols)
    iu, ju = np.triu_indices(p, k=1)

    def fresh():
        return [np.zeros((p, p)), np.zeros((p, p)), np.zeros((p, p)), np.zeros((p, p)), np.full((p, p), np.inf), np.full((p, p), -np.inf)]

    def update(acc, x):
        n, sx, sxx, sxy, mn, mx = acc
        m = ~np.isnan(x)
        x0 = np.where(m, x, 0.0)
        mf = m.astype(np.float64)
        n += mf.T @ mf
        sx += x0.T @ mf
        sxx += (x0 * x0).T @ mf
        sxy += x0.T @ x0
        # masked min / max of column i over rows where column j is present
        for jj in range(p):
            rows = m[:, jj]
            if not rows.any():
                continue
            sub = np.where(m[rows], x[rows], np.nan)
            with np.errstate(all="ignore"):
                lo = np.nanmin(np.where(np.isnan(sub), np.inf, sub), axis=0)
                hi = np.nanmax(np.where(np.isnan(sub), -np.inf, sub), axis=0)
            mn[:, jj] = np.minimum(mn[:, jj], lo)
            mx[:, jj] = np.maximum(mx[:, jj], hi)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        accs: dict = {}
        for pdf in batches:
            if pdf.empty:
                continue
            parts = pdf.groupby(group, sort=False, dropna=False) if group else [(None, pdf)]
            for g, sub in parts:
                shift = np.asarray(shifts.get(g, [0.0] * p), dtype=np.float64)
                x = sub[list(cols)].to_numpy(dtype=np.float64, na_value=np.nan) - shift
                update(accs.setdefault(g, fresh()), x)
        for g, (n, sx, sxx, sxy, mn, mx) in accs.items():
            out = pd.DataFrame(
                {
                    "i": iu.astype(np.int32),
                    "j": ju.astype(np.int32),
                    "n": n[iu, ju].astype(np.int64),
                    "sx": sx[iu, ju],
                    "sy": sx[ju, iu],
                    "sxx": sxx[iu, ju],
                    "syy": sxx[ju, iu],
                    "sxy": sxy[iu, ju],
                    "minx": mn[iu, ju],
                    "maxx": mx[iu, ju],
                    "miny": mn[ju, iu],
                    "maxy": mx[ju, iu],
                }
            )
            if group:
                out.insert(0, "_g", g)
            yield out

    return run


def _gram_path(df: DataFrame, cols: Sequence[str], group: str | None = None) -> DataFrame:
    keys = [F.col(group).cast("string").alias("_g")] if group else []
    narrow = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    gcols = ["_g"] if group else []
    means = narrow.groupBy(*gcols).agg(*[F.avg(c).alias(c) for c in cols]).collect()
    shifts = {(r["_g"] if group else None): [float(r[c]) if r[c] is not None else 0.0 for c in cols] for r in means}
    schema = ("_g string, " if group else "") + _GRAM_SCHEMA
    blocks = narrow.mapInPandas(_gram_blocks(cols, shifts, "_g" if group else None), schema)
    s = blocks.groupBy(*gcols, "i", "j").agg(
        F.sum("n").alias("n"),
        *[F.sum(c).alias(c) for c in ("sx", "sy", "sxx", "syy", "sxy")],
        F.min("minx").alias("minx"),
        F.max("maxx").alias("maxx"),
        F.min("miny").alias("miny"),
        F.max("maxy").alias("maxy"),
    )
    n = F.col("n").cast("double")
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    vx = n * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = n * F.col("syy") - F.col("sy") * F.col("sy")
    defined = (F.col("n") >= 2) & (F.col("minx") < F.col("maxx")) & (F.col("miny") < F.col("maxy")) & (vx > 0) & (vy > 0)
    return s.select(*gcols, "i", "j", "n", F.when(defined, F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy))).alias("r"))


def corr_matrix(df: DataFrame, cols: Sequence[str], method: str = "auto", group: str | None = None) -> DataFrame:
    """A5: ``(column_i, column_j, i, j, n, corr)`` for i < j with ``corr = |r|`` (null if undefined).

    ``group`` (Gram path) computes one matrix per value of that column in the same pass, e.g.
    train and test slices of one table; the value comes back as a leading string column.
    """
    cols = list(cols)
    if method == "auto":
        method = "gram"
    if group is not None and method != "gram":
        raise ValueError("grouped correlation uses the Gram path")
    raw = _pairs_path(df, cols) if method == "pairs" else _gram_path(df, cols, group)
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("i") + 1) if cols else F.lit(None)
    name_j = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("j") + 1) if cols else F.lit(None)
    return raw.select(
        *([F.col("_g").alias(group)] if group else []),
        name.alias("column_i"),
        name_j.alias("column_j"),
        "i",
        "j",
        "n",
        F.when(F.col("r").isNotNull(), F.least(F.abs(F.col("r")), F.lit(1.0))).alias("corr"),
    )


def correlated_report(corr: DataFrame, cols: Sequence[str], threshold: float = 0.75) -> DataFrame:
    """A6 decision table: column j is dropped if any earlier column i < j has corr ≥ threshold.

    The earlier column counts even if it is dropped itself (A~B and B~C drop both B and C),
    so this is one left-anti join, not an iterative elimination.
    """
    spark = corr.sparkSession
    names = spark.createDataFrame([(c, i) for i, c in enumerate(cols)], "column string, ordinal int")
    hits = corr.where(F.col("corr") >= F.lit(threshold)).select(F.col("j").alias("ordinal")).distinct()
    dropped = names.join(hits, "ordinal", "left_semi").withColumn("drop", F.lit(True))
    kept = names.join(hits, "ordinal", "left_anti").withColumn("drop", F.lit(False))
    return kept.unionByName(dropped).select("column", "ordinal", "drop")
