"""SVM-SMOTE with a kernel margin (R4): support rows told apart by their neighbours.

The RBF kernel is given by random Fourier features (fixed by the seed), so that a linear SVM on
them, fitted by Spark, has the kernel's margin; its support rows are those on or inside the margin.
Of the minority's support rows

* those whose m nearest rows are all of the majority are noise and dropped,
* those with at least half of the m in the majority are in danger: new rows lie between them and
  minority neighbours,
* the others are safe: new rows lie beyond them, away from minority neighbours, by up to
  ``out_step`` of the distance, into the majority's side of the border.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from renewal.operators.neighbors import knn
from renewal.operators.resample import MINORITY, _check_neighbours, _even_copies, _interpolate, _lowest_key, majority_share, over_total
from renewal.operators.split import class_counts
from renewal.session import ensure_checkpoint_dir

COMPONENTS = 256


def rbf_gamma(df: DataFrame, feats: Sequence[str]) -> float:
    """1 / (columns times the variance of all values)."""
    row = df.agg(*[F.avg(F.col(c)).alias(f"m{i}") for i, c in enumerate(feats)], *[F.avg(F.col(c) * F.col(c)).alias(f"s{i}") for i, c in enumerate(feats)]).first()
    p = len(feats)
    variance = sum(row[f"s{i}"] for i in range(p)) / p - (sum(row[f"m{i}"] for i in range(p)) / p) ** 2
    return 1.0 / (p * variance) if variance > 0 else 1.0


def fourier_features(df: DataFrame, feats: Sequence[str], gamma: float, components: int = COMPONENTS, seed: int = 10, keep: Sequence[str] = ("row_id", "label"), out: str = "z") -> DataFrame:
    """``keep`` and an array whose products approach exp(-gamma |x - y|^2)."""
    rng = np.random.default_rng(seed)
    turns, shift = rng.normal(0.0, np.sqrt(2 * gamma), (len(feats), components)), rng.uniform(0, 2 * np.pi, components)
    names = [f"_f{i}" for i in range(len(feats))]

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], 1)
            z = np.sqrt(2 / components) * np.cos(x @ turns + shift)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * components), pa.array(z.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists], names=[*keep, out])

    rows = df.select(*keep, *[F.col(c).cast("double").alias(n) for c, n in zip(feats, names, strict=True)])
    return rows.mapInArrow(turn, df.select(*keep).schema.add(out, ArrayType(DoubleType())))


def support_rows(df: DataFrame, feats: Sequence[str], cost: float = 1.0, gamma: float | None = None, components: int = COMPONENTS, seed: int = 10, key: str = "row_id", label: str = "label", slack: float = 0.01) -> DataFrame:
    """key, side: minority rows on or inside the kernel margin (``side``: signed distance, at most 1 + slack)."""
    data = df.select(key, *feats, label)
    gamma = rbf_gamma(data, feats) if gamma is None else gamma
    z = fourier_features(data, feats, gamma, components, seed, (key, label)).select(key, label, array_to_vector("z").alias("_features"), "z")
    z = z.checkpoint()  # the fit reads it many times
    model = LinearSVC(featuresCol="_features", labelCol=label, regParam=1.0 / (cost * max(1, z.count())), maxIter=100, standardization=False).fit(z)
    weights, bias = model.coefficients.toArray().tolist(), float(model.intercept)
    side = F.aggregate(F.zip_with("z", F.array(*[F.lit(w) for w in weights]), lambda a, b: a * b), F.lit(bias), lambda a, b: a + b)
    return z.where(F.col(label) == MINORITY).select(key, side.alias("side")).where(F.col("side") <= 1 + slack)


def support_kinds(df: DataFrame, support: DataFrame, feats: Sequence[str], m: int = 10, key: str = "row_id", label: str = "label") -> DataFrame:
    """key, kind: 'noise', 'danger' or 'safe' for every support row."""
    share = majority_share(df, feats, m, key, label).join(support.select(key), key, "left_semi")
    return share.select(key, F.when(F.col("n_maj") >= m, "noise").when(F.col("n_maj") * 2 >= m, "danger").otherwise("safe").alias("kind"))


def smote_svm_rbf(
    df: DataFrame, feats: Sequence[str], strategy: float | str = "auto", k: int = 5, m: int = 10, out_step: float = 0.5, cost: float = 1.0, gamma: float | None = None, components: int = COMPONENTS, seed: int = 10, key: str = "row_id", label: str = "label"
) -> DataFrame:
    """Original rows plus synthetic minority rows, half from rows in danger and half from safe ones
    (all from one kind where the other has none)."""
    data = df.select(key, *feats, label)
    counts = class_counts(data, label)
    g = over_total(counts, strategy)
    if g == 0:
        return data
    _check_neighbours(counts.get(MINORITY, 0), k)
    ensure_checkpoint_dir(df.sparkSession)
    kinds = support_kinds(data, support_rows(data, feats, cost, gamma, components, seed, key, label), feats, m, key, label).checkpoint()
    sizes = {r["kind"]: r["n"] for r in kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    danger, safe = sizes.get("danger", 0), sizes.get("safe", 0)
    if not danger + safe:
        raise ValueError("smote_svm_rbf: no minority support row is left; lower cost or use smote")
    shares = {"danger": g if not safe else 0 if not danger else -(-g // 2), "safe": g if not danger else 0 if not safe else g // 2}
    minority = data.where(F.col(label) == MINORITY)
    seeds, most, before = None, 1, 0
    for kind in ("danger", "safe"):
        if shares[kind]:
            own, copies = _even_copies(minority.join(kinds.where(F.col("kind") == kind), key), shares[kind], seed, key)
            own = own.withColumn("_srank", F.col("_srank") + F.lit(before))
            seeds, most = own if seeds is None else seeds.unionByName(own), max(most, copies)
        before += sizes.get(kind, 0)
    nbrs = knn(None, minority, feats, k, key=key, extra=list(feats))
    own = seeds.select(key, "kind", *[F.col(c).alias(f"_x_{c}") for c in feats])
    turned = lambda c: F.when(F.col("kind") == "safe", F.col(f"_x_{c}") - F.lit(out_step) * (F.col(f"nb_{c}") - F.col(f"_x_{c}"))).otherwise(F.col(f"nb_{c}"))
    nbrs = nbrs.join(own, key).select(key, "nn_rank", *[turned(c).alias(f"nb_{c}") for c in feats])
    return data.unionByName(_interpolate(seeds, nbrs, feats, k, seed, key, label, most, _lowest_key(data, key)))
