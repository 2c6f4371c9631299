"""Scaling and dimension reduction.

Fits are single aggregation passes whose result is bounded by the number of features
(means, standard deviations, a p×p Gram matrix); the projections are plain column
expressions, so the transform stays in whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    row = df.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"m_{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{i}") for i, c in enumerate(cols)],
    ).collect()[0]
    return {c: (row[f"m_{i}"], row[f"s_{i}"]) for i, c in enumerate(cols)}


def standardize(df: DataFrame, cols: Sequence[str], stats: dict | None = None, with_mean: bool = True) -> DataFrame:
    """z-score with the population standard deviation (a zero deviation scales by 1)."""
    stats = stats if stats is not None else fit_scaler(df, cols)

    def z(c: str):
        m, s = stats[c]
        x = F.col(c).cast("double")
        if with_mean and m is not None:
            x = x - F.lit(m)
        scale = s if s not in (None, 0.0) else 1.0
        return (x / F.lit(scale)).alias(c)

    return df.select(*[z(c) if c in stats else F.col(c) for c in df.columns])


def l2_normalize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """scale each row to unit Euclidean length (a zero row stays zero)."""
    sq = None
    for c in cols:
        t = F.col(c).cast("double") * F.col(c).cast("double")
        sq = t if sq is None else sq + t
    norm = F.col("_norm")
    keep = [c for c in df.columns if c not in cols]
    return df.withColumn("_norm", F.sqrt(sq)).select(  # a column of its own: computed once per row
        *keep,
        *[F.when(norm > 0, F.col(c).cast("double") / norm).otherwise(F.col(c).cast("double")).alias(c) for c in cols],
    )


WIDE = 24


def _gram_blocks(cols: Sequence[str]):
    p = len(cols)
    iu, ju = np.triu_indices(p)

    def run(batches):
        import pandas as pd

        n, s, g = 0, np.zeros(p), np.zeros((p, p))
        for pdf in batches:
            x = pdf[list(cols)].to_numpy(dtype=np.float64, na_value=0.0)
            n += len(x)
            s += x.sum(axis=0)
            g += x.T @ x
        if n:
            yield pd.DataFrame({"i": iu.astype(np.int32), "j": ju.astype(np.int32), "v": g[iu, ju], "n": n})
            yield pd.DataFrame({"i": np.arange(p, dtype=np.int32), "j": np.full(p, -1, dtype=np.int32), "v": s, "n": 0})

    return run


def gram(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, column sums, XᵀX) in one pass (nulls count as 0).

    Up to ``WIDE`` columns: p(p+1)/2 JVM sums in one aggregation.  Wider: per-partition numpy
    blocks in an Arrow-batched ``mapInPandas`` summed by ``groupBy(i, j)`` — the plan stays
    small and the shuffle is one row per entry per task.
    """
    p = len(cols)
    if p > WIDE:
        narrow = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
        parts = narrow.mapInPandas(_gram_blocks(cols), "i int, j int, v double, n bigint")
        rows = parts.groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
        s, g, n = np.zeros(p), np.zeros((p, p)), 0
        for r in rows:
            if r["j"] < 0:
                s[r["i"]] = r["v"]
            else:
                g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["v"]
                if r["i"] == 0 and r["j"] == 0:
                    n = int(r["n"])
        return n, s, g
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(x[i]).alias(f"s{i}") for i in range(p)]
    aggs += [F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)]
    row = df.agg(*aggs).collect()[0]
    s = np.array([row[f"s{i}"] or 0.0 for i in range(p)])
    g = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    return int(row["n"]), s, g


def _sign_fix(v: np.ndarray) -> np.ndarray:
    """Make the largest-magnitude loading of every component positive (deterministic signs)."""
    idx = np.argmax(np.abs(v), axis=0)
    signs = np.sign(v[idx, np.arange(v.shape[1])])
    signs[signs == 0] = 1.0
    return v * signs


def _project(df: DataFrame, cols: Sequence[str], comps: np.ndarray, center: np.ndarray | None, prefix: str, keep: Sequence[str]) -> DataFrame:
    outs = []
    for k in range(comps.shape[1]):
        e = None
        for i, c in enumerate(cols):
            x = F.col(c).cast("double")
            if center is not None:
                x = x - F.lit(float(center[i]))
            t = x * F.lit(float(comps[i, k]))
            e = t if e is None else e + t
        outs.append(e.alias(f"{prefix}{k}"))
    return df.select(*[c for c in keep if c in df.columns], *outs)


def pca(df: DataFrame, cols: Sequence[str], k: int, keep: Sequence[str] = ("row_id", "label")) -> DataFrame:
    """centred PCA (sample covariance eigenvectors), scores ``pc0..pc{k-1}``."""
    n, s, g = gram(df, cols)
    mean = s / max(n, 1)
    cov = (g - n * np.outer(mean, mean)) / max(n - 1, 1)
    w, v = np.linalg.eigh(cov)
    order = np.argsort(w)[::-1][:k]
    return _project(df, cols, _sign_fix(v[:, order]), mean, "pc", keep)


def truncated_svd(df: DataFrame, cols: Sequence[str], k: int, keep: Sequence[str] = ("row_id", "label")) -> DataFrame:
    """F8: uncentred truncated SVD; scores ``X·V_k`` = ``U_k·Σ_k`` as ``sv0..``."""
    _, _, g = gram(df, cols)
    w, v = np.linalg.eigh(g)
    order = np.argsort(w)[::-1][:k]
    return _project(df, cols, _sign_fix(v[:, order]), None, "sv", keep)
