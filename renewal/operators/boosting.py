"""Second-order gradient boosting over binned columns (M1) with a patient stop.

Trees are grown level by level on quantile bins.  A level is one Spark job: every task adds up
gradients, hessians and row counts of its rows by (node, feature, bin), the sums are shuffled once by
(node, feature), and split gains come from window sums over a feature's bins.  Only the best
split of each open node reaches the driver, which holds the trees and nothing that grows with the
rows.  Null and NaN values have a bin of their own and go to the side that gains more, so missing
values need neither a fill nor a flag.

With G and H the sums of a node, its weight is the minimum of
``G w + (H + lambda) w^2 / 2 + alpha |w|`` over ``|w| <= max_delta_step`` (0: no limit), and a split
gains what that minimum falls by, doubled; splits that gain less than ``gamma`` or leave a side
less hessian than ``min_child_weight`` or fewer rows than ``min_child_samples`` don't count.

Gradients are rounded to fixed-point numbers before they are added, so all sums are exact
and a tree doesn't depend on how rows are dealt to tasks (ties: the first feature, then the lowest bin,
then nulls to the right).

Rows are kept as checkpointed blocks of bins with their margins; margins are brought up to date
every ``TREES_PER_WRITE`` trees, and between two writes a task adds the few trees since.

Validation rows take no part in the sums; the first level's job of the next tree also returns their
loss.  ``patience`` rounds without a better loss end the training, and the best prefix of
trees predicts.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, fields
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from renewal.functions import rint_label
from renewal.session import ensure_checkpoint_dir

#: Rows of a block: their fixed-point sums stay exact in doubles.
BLOCK_ROWS = 1 << 14
#: Cells (node, feature, bin) that a task adds up before it hands them on.
CELLS = 1 << 21
#: Trees between two writes of the margins.
TREES_PER_WRITE = 8
_LEAST_GAIN = 1e-6
_BLOCK = "bins binary, label binary, weight binary, margin binary, uid binary, valid binary"
_CELL = "node int, feature int, bin int, g long, h long, n long"


@dataclass(frozen=True)
class BoostParams:
    rounds: int = 10
    eta: float = 0.3
    max_depth: int = 6
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    min_child_samples: int = 1
    max_delta_step: float = 0.0
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    colsample_bylevel: float = 1.0
    colsample_bynode: float = 1.0
    max_bins: int = 64
    patience: int | None = None
    seed: int = 10

    def __post_init__(self):
        if not 2 <= self.max_bins <= 255:
            raise ValueError("max_bins is 2 to 255")
        if not (self.rounds >= 0 and self.max_depth >= 1 and self.eta > 0):
            raise ValueError("rounds >= 0, max_depth >= 1 and eta > 0")
        for name in ("subsample", "colsample_bytree", "colsample_bylevel", "colsample_bynode"):
            if not 0 < getattr(self, name) <= 1:
                raise ValueError(f"{name} is above 0 and at most 1")
        for name in ("reg_lambda", "reg_alpha", "gamma", "min_child_weight", "max_delta_step"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} is not negative")


_NAMES = {
    "learning_rate": "eta",
    "n_estimators": "rounds",
    "n_estimator": "rounds",
    "num_iterations": "rounds",
    "num_boost_round": "rounds",
    "lambda": "reg_lambda",
    "lambda_l2": "reg_lambda",
    "alpha": "reg_alpha",
    "lambda_l1": "reg_alpha",
    "min_data_in_leaf": "min_child_samples",
    "min_sum_hessian_in_leaf": "min_child_weight",
    "min_split_gain": "gamma",
    "bagging_fraction": "subsample",
    "feature_fraction": "colsample_bytree",
    "max_bin": "max_bins",
    "early_stopping_rounds": "patience",
    "random_state": "seed",
}


def boost_params(params: dict[str, Any]) -> BoostParams:
    """Parameters under the names that the boosting libraries use; what has no counterpart is named in a warning."""
    known = {f.name for f in fields(BoostParams)}
    out = {_NAMES.get(k, k): v for k, v in params.items()}
    if unknown := sorted(set(out) - known):
        warnings.warn(f"no counterpart of {', '.join(unknown)}; ignored", stacklevel=2)
    return BoostParams(**{k: v for k, v in out.items() if k in known})


def bin_edges(df: DataFrame, feats: Sequence[str], max_bins: int) -> list[np.ndarray]:
    """Per feature at most ``max_bins - 1`` rising thresholds from one quantile-sketch aggregate.

    A value lies in the first bin whose threshold it is below; nulls and NaN are left out.  Only
    thresholds above the smallest value count, so no bin is empty by construction.
    """
    grid = F.array(*[F.lit(i / max_bins) for i in range(max_bins)])
    value = {f: F.nullif(F.col(f).cast("double"), F.lit(float("nan"))) for f in feats}
    row = df.agg(*[F.percentile_approx(value[f], grid, 20 * max_bins).alias(f"e{i}") for i, f in enumerate(feats)], *[F.min(value[f]).alias(f"m{i}") for i, f in enumerate(feats)]).first()
    found = [np.unique(np.array(row[f"e{i}"] or [], float)) for i in range(len(feats))]
    return [e[e > (row[f"m{i}"] if row[f"m{i}"] is not None else 0.0)] for i, e in enumerate(found)]


def binned(values: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """Bins of the features' values (features x rows): 0 for null or NaN, else 1 + thresholds passed."""
    return np.stack([np.where(np.isnan(v), 0, 1 + np.searchsorted(e, v, "right")).astype(np.uint8) for v, e in zip(values, edges, strict=True)])


def _doubles(batch: pa.RecordBatch, names: Sequence[str]) -> list[np.ndarray]:
    return [pc.fill_null(batch.column(c).cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False) for c in names]


@dataclass
class Tree:
    """Arrays by node; ``feature`` is -1 at a leaf.  A value of bin <= ``bin`` (below ``threshold``) goes left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    null_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])

    def add(self, value: float, cover: float) -> int:
        for column, v in zip((self.feature, self.bin, self.threshold, self.null_left, self.left, self.right, self.value, self.gain, self.cover), (-1, 0, 0.0, False, -1, -1, value, 0.0, cover), strict=True):
            column.append(v)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, bin_: int, threshold: float, null_left: bool, gain: float, left: int, right: int) -> None:
        self.feature[node], self.bin[node], self.threshold[node], self.null_left[node] = feature, bin_, threshold, null_left
        self.gain[node], self.left[node], self.right[node] = gain, left, right

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row (a column of ``bins``) ends in."""
        feature, cut, null_left, left, right = (np.array(x) for x in (self.feature, self.bin, self.null_left, self.left, self.right))
        rows = np.arange(bins.shape[1])
        node = np.zeros(len(rows), np.int64)
        while len(rows):
            rows = rows[feature[node[rows]] >= 0]
            at = node[rows]
            b = bins[feature[at], rows]
            node[rows] = np.where(np.where(b == 0, null_left[at], b <= cut[at]), left[at], right[at])
        return node

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


def uniform(uid: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each row and seed (splitmix64 of the row's hash)."""
    with np.errstate(over="ignore"):
        z = uid.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def _blocks(df: DataFrame, feats: Sequence[str], edges: list[np.ndarray], label: str, weight: str | None, valid: str | None, key: Sequence[str], seed: int) -> DataFrame:
    """The rows as blocks of bins, labels, weights, margins (0), row hashes and validation flags."""
    names = [f"f{i}" for i in range(len(feats))]
    rows = df.select(
        *[F.col(f).cast("double").alias(n) for f, n in zip(feats, names, strict=True)],
        F.col(label).cast("int").alias("label"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"),
        F.xxhash64(F.lit(seed), *key).alias("uid"),
        (F.coalesce(F.col(valid).cast("boolean"), F.lit(False)) if valid else F.lit(False)).alias("valid"),
    ).filter("label is not null and weight > 0")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), BLOCK_ROWS):
                batch = whole.slice(i, BLOCK_ROWS)
                column = lambda c, kind: np.ascontiguousarray(batch.column(c).to_numpy(zero_copy_only=False).astype(kind)).tobytes()  # noqa: B023, E731
                made = {"bins": binned(_doubles(batch, names), edges).tobytes(), "label": column("label", "u1"), "weight": column("weight", "f8"), "margin": bytes(8 * len(batch)), "uid": column("uid", "i8"), "valid": column("valid", "u1")}
                yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.binary()) for k, v in made.items()})

    return rows.mapInArrow(block, _BLOCK)


def _read(row: dict[str, bytes], n_feats: int, pending: Sequence[Tree]) -> tuple[np.ndarray, ...]:
    """bins, label, weight, margin (with the pending trees), uid, valid of a block."""
    label, weight, margin, uid, valid = (np.frombuffer(row[c], k) for c, k in (("label", "u1"), ("weight", "f8"), ("margin", "f8"), ("uid", "i8"), ("valid", "u1")))
    bins = np.frombuffer(row["bins"], np.uint8).reshape(n_feats, len(label))
    for tree in pending:
        margin = margin + tree.values(bins)
    return bins, label, weight, margin, uid, valid.astype(bool)


def _rows(batch: pa.RecordBatch) -> list[dict[str, bytes]]:
    return batch.to_pylist()


def _with_margins(blocks: DataFrame, n_feats: int, pending: Sequence[Tree]) -> DataFrame:
    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                row["margin"] = _read(row, n_feats, pending)[3].tobytes()
                yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.binary()) for k, v in row.items()})

    return blocks.mapInArrow(update, _BLOCK)


def log_loss(label: np.ndarray, margin: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, np.where(label == 1, -margin, margin))


def _cells(blocks: DataFrame, tree: Tree | None, open_: Sequence[int], allowed: np.ndarray, pending: Sequence[Tree], n_bins: int, scale: float, params: BoostParams, round_: int, with_loss: bool) -> DataFrame:
    """node, feature, bin, g, h, n of the open nodes' training rows; the validation loss as node -1.

    ``allowed``: features that each open node may use (open nodes x features); ``tree`` None: the loss only.
    """
    n_feats, width = allowed.shape[1], n_bins + 1
    at_once = max(1, CELLS // max(1, len(open_) * width))  # features added up at a time
    used = np.flatnonzero(allowed.any(0))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss = np.zeros(3, np.int64)
        whole = len(used) <= at_once
        total = np.zeros((len(used) if whole else 0, len(open_) * width, 3), np.int64)

        def cells(feature: np.ndarray, sums_: np.ndarray) -> pa.RecordBatch:
            f, cell = np.nonzero(sums_[:, :, 2])
            node, bin_ = cell // width, cell % width
            may = allowed[node, feature[f]]
            f, cell, node, bin_ = f[may], cell[may], node[may], bin_[may]
            ints = [np.array(open_, np.int32)[node], feature[f].astype(np.int32), bin_.astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (*ints, *sums_[f, cell].T)], names=["node", "feature", "bin", "g", "h", "n"])

        for batch in batches:
            for row in _rows(batch):
                bins, label, weight, margin, uid, valid = _read(row, n_feats, pending)
                if with_loss and valid.any():
                    terms = np.rint(np.minimum(log_loss(label[valid], margin[valid]), 1000.0) * weight[valid] * (scale / 1024))
                    loss += [int(terms.astype(np.int64).sum()), int(np.rint(weight[valid] * (scale / 1024)).astype(np.int64).sum()), int(valid.sum())]
                if tree is None:
                    continue
                in_ = ~valid
                if params.subsample < 1:
                    in_ &= uniform(uid, params.seed * 100_003 + round_) < params.subsample
                place = np.full(len(tree.feature), -1)
                place[list(open_)] = np.arange(len(open_))
                node = place[tree.leaves(bins)]
                in_ &= node >= 0
                node, bins_ = node[in_], bins[:, in_]
                p = 1 / (1 + np.exp(-margin[in_]))
                g = np.rint((p - label[in_]) * weight[in_] * scale)
                h = np.rint(np.maximum(p * (1 - p), 1e-16) * weight[in_] * scale)
                for a in range(0, len(used), at_once):
                    some = used[a : a + at_once]
                    part = np.stack([np.stack([np.bincount(c, x, len(open_) * width) for x in (g, h, None)], 1) for f in some for c in [node * width + bins_[f]]]).astype(np.int64)
                    if whole:
                        total += part
                    else:
                        yield cells(some, part)
        if whole and total.any():
            yield cells(used, total)
        if loss[2]:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in (-1, -1, 0)] + [pa.array([v], pa.int64()) for v in loss], names=["node", "feature", "bin", "g", "h", "n"])

    return blocks.mapInArrow(sums, _CELL)


def _objective_fall(g, h, params: BoostParams):
    """Twice what the best weight takes off the objective (columns in units, not fixed-point)."""
    w = _weight_column(g, h, params)
    return -2 * (g * w + (h + params.reg_lambda) * w * w / 2 + params.reg_alpha * F.abs(w))


def _weight_column(g, h, params: BoostParams):
    shrunk = F.signum(g) * F.greatest(F.abs(g) - params.reg_alpha, F.lit(0.0))
    w = F.when(h + params.reg_lambda > 0, -shrunk / (h + params.reg_lambda)).otherwise(0.0)
    return F.greatest(F.least(w, F.lit(params.max_delta_step)), F.lit(-params.max_delta_step)) if params.max_delta_step else w


def _weight(g: float, h: float, params: BoostParams) -> float:
    w = -math.copysign(max(abs(g) - params.reg_alpha, 0.0), g) / (h + params.reg_lambda) if h + params.reg_lambda > 0 else 0.0
    return max(-params.max_delta_step, min(params.max_delta_step, w)) if params.max_delta_step else w


def best_splits(cells: DataFrame, scale: float, params: BoostParams) -> DataFrame:
    """node, g, h (its sums) and best: the split of the greatest gain (null: none counts)."""
    dealt = cells.repartition("node", "feature")  # for the sums and the windows alike
    summed = dealt.groupBy("node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])
    all_bins = Window.partitionBy("node", "feature")  # at most max_bins + 1 rows
    so_far = all_bins.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    known = lambda c: F.when(F.col("bin") > 0, F.col(c)).otherwise(F.lit(0).cast("long"))
    s = summed.select("node", "feature", "bin", *[F.sum(c).over(all_bins).alias(f"{c}_all") for c in ("g", "h", "n")], *[F.sum(F.col(c) - known(c)).over(all_bins).alias(f"{c}_null") for c in ("g", "h", "n")], *[F.sum(known(c)).over(so_far).alias(f"{c}_below") for c in ("g", "h", "n")])
    side = F.explode(F.array(F.lit(0), F.lit(1))).alias("null_left")
    s = s.select("*", side)
    left = {c: F.col(f"{c}_below") + F.col("null_left") * F.col(f"{c}_null") for c in ("g", "h", "n")}
    s = s.select("node", "feature", "bin", "null_left", *[F.col(f"{c}_all") for c in ("g", "h", "n")], *[left[c].alias(f"{c}_left") for c in ("g", "h", "n")])
    unit = lambda c: F.col(c) / F.lit(scale)
    gl, hl, g, h = unit("g_left"), unit("h_left"), unit("g_all"), unit("h_all")
    gr, hr = (F.col("g_all") - F.col("g_left")) / F.lit(scale), (F.col("h_all") - F.col("h_left")) / F.lit(scale)
    gain = _objective_fall(gl, hl, params) + _objective_fall(gr, hr, params) - _objective_fall(g, h, params)
    s = s.withColumn("gain", gain)
    counts = (
        (F.col("bin") > 0)
        & (F.col("n_left") >= params.min_child_samples)
        & (F.col("n_all") - F.col("n_left") >= params.min_child_samples)
        & (F.col("n_left") > 0)
        & (F.col("n_left") < F.col("n_all"))
        & (hl >= params.min_child_weight)
        & (hr >= params.min_child_weight)
        & (F.col("gain") >= params.gamma)
        & (F.col("gain") > _LEAST_GAIN)
    )
    rank = F.struct(F.col("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), (-F.col("null_left")).alias("s"), gl.alias("gl"), hl.alias("hl"), gr.alias("gr"), hr.alias("hr"))
    return s.groupBy("node").agg(F.max(g).alias("g"), F.max(h).alias("h"), F.max(F.when(counts, rank)).alias("best"))


def best_prefix(losses: Sequence[float], patience: int | None) -> tuple[int, bool]:
    """(rounds of the lowest loss so far, whether ``patience`` rounds have passed since).

    ``losses[i]`` is the loss after i + 1 rounds; of equal losses the first counts.
    """
    if not losses:
        return 0, False
    best = min(range(len(losses)), key=lambda i: (losses[i], i))
    return best + 1, patience is not None and len(losses) - 1 - best >= patience


@dataclass
class NewtonModel:
    features: list[str]
    trees: list[Tree]
    #: Validation loss after each round (empty without validation rows) and rounds that predict.
    losses: list[float]
    best_round: int

    def margins(self, values: list[np.ndarray]) -> np.ndarray:
        """Sum of the trees' values; the features' values decide by the trees' thresholds."""
        total = np.zeros(len(values[0]) if values else 0)
        table = np.stack(values) if values else np.zeros((0, 0))
        for t in self.trees[: self.best_round]:
            feature, threshold, null_left, left, right, value = (np.array(x) for x in (t.feature, t.threshold, t.null_left, t.left, t.right, t.value))
            rows, node = np.arange(len(total)), np.zeros(len(total), np.int64)
            while len(rows):
                rows = rows[feature[node[rows]] >= 0]
                at = node[rows]
                x = table[feature[at], rows]
                node[rows] = np.where(np.where(np.isnan(x), null_left[at], x < threshold[at]), left[at], right[at])
            total += value[node]
        return total

    def predict(self, df: DataFrame, keep: Sequence[str] = ("row_id", "label")) -> DataFrame:
        """``keep... probability_1 prediction``; nulls go where the trees learnt to send them."""
        kept = [c for c in keep if c in df.columns]
        names = [f"_f{i}" for i in range(len(self.features))]
        rows = df.select(*kept, *[F.col(f).cast("double").alias(n) for f, n in zip(self.features, names, strict=True)])
        margins = self.margins

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = 1 / (1 + np.exp(-margins(_doubles(batch, names))))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(p)], names=[*kept, "probability_1"])

        schema = df.select(*kept).schema.add("probability_1", "double")
        return rows.mapInArrow(score, schema).withColumn("prediction", rint_label("probability_1"))

    def table(self, spark: SparkSession) -> DataFrame:
        """The trees as rows (tree, node, feature, threshold, ...), for reading, importances and storage."""
        schema = "tree int, node int, feature string, bin int, threshold double, null_left boolean, left int, right int, value double, gain double, cover double"
        rows = [(i, k, self.features[f] if f >= 0 else None, b, th, nl, lt, rt, v, g, c) for i, t in enumerate(self.trees[: self.best_round]) for k, (f, b, th, nl, lt, rt, v, g, c) in enumerate(zip(t.feature, t.bin, t.threshold, t.null_left, t.left, t.right, t.value, t.gain, t.cover, strict=True))]
        return spark.createDataFrame(rows, schema)

    @classmethod
    def from_table(cls, trees: DataFrame, features: Sequence[str]) -> NewtonModel:
        """The model of a stored ``table`` (bounded by trees times nodes)."""
        of = {f: i for i, f in enumerate(features)}
        found: dict[int, Tree] = {}
        for r in trees.orderBy("tree", "node").collect():
            t = found.setdefault(r["tree"], Tree(*[[] for _ in fields(Tree)]))
            t.add(r["value"], r["cover"])
            t.split(r["node"], of[r["feature"]] if r["feature"] is not None else -1, r["bin"], r["threshold"], r["null_left"], r["gain"], r["left"], r["right"])
        made = [found[i] for i in sorted(found)]
        return cls(list(features), made, [], len(made))

    def curve(self, spark: SparkSession) -> DataFrame:
        """round, valid_loss, best_round of every round trained."""
        return spark.createDataFrame([(i + 1, x, self.best_round) for i, x in enumerate(self.losses)], "round int, valid_loss double, best_round int")


def _sampled(features: np.ndarray, share: float, rng: np.random.Generator) -> np.ndarray:
    return features if share >= 1 else np.sort(rng.choice(features, max(1, int(len(features) * share)), replace=False))


def newton_trees(train: DataFrame, feats: Sequence[str], params: BoostParams | dict[str, Any] | None = None, label: str = "label", weight: str | None = "weight", valid: str | None = None, key: Sequence[str] = ("row_id",), thresholds: Sequence[Sequence[float]] | None = None) -> NewtonModel:
    """Boosted trees of the logistic loss; ``valid`` names a boolean column of validation rows.

    ``thresholds``: per feature the rising values to split at, in place of quantiles (at most 254).

    Rows without a label or a positive weight are left out; ``key`` names a row when rows are
    sampled.  Without training rows, or without a feature, the model has no trees (margin 0).
    """
    params = params if isinstance(params, BoostParams) else boost_params(params or {})
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    feats = list(feats)
    weight = weight if weight in train.columns else None
    fitted = train.filter(~F.coalesce(F.col(valid).cast("boolean"), F.lit(False))) if valid else train
    sizes = train.filter(F.col(label).isNotNull()).agg(F.sum(F.col(weight) if weight else F.lit(1.0)).alias("w"), F.max(F.col(weight) if weight else F.lit(1.0)).alias("top")).first()
    if not feats or not sizes["w"] or sizes["w"] <= 0:
        return NewtonModel(feats, [], [], 0)
    edges = bin_edges(fitted, feats, params.max_bins) if thresholds is None else [np.array(t, float) for t in thresholds]
    if max(map(len, edges)) > 254:
        raise ValueError("at most 254 thresholds a feature")
    n_bins = 1 + max(map(len, edges))
    scale = 2.0 ** math.floor(min(38 - math.log2(sizes["top"]), 61 - math.log2(sizes["w"])))
    blocks = _blocks(train, feats, edges, label, weight, valid, key, params.seed).checkpoint()
    trees: list[Tree] = []
    losses: list[float] = []
    pending: list[Tree] = []

    def level(tree: Tree | None, open_: list[int], allowed: np.ndarray, round_: int, with_loss: bool) -> dict[int, Any]:
        cells = _cells(blocks, tree, open_, allowed, pending, n_bins, scale, params, round_, with_loss)
        found = {r["node"]: r for r in best_splits(cells, scale, params).collect()}  # a row per open node
        if with_loss and -1 in found and (trees or tree is None):
            losses.append(found[-1]["g"] / found[-1]["h"] if found[-1]["h"] else 0.0)
        return found

    for round_ in range(params.rounds):
        rng = np.random.default_rng([params.seed, round_])
        of_tree = _sampled(np.arange(len(feats)), params.colsample_bytree, rng)
        tree, open_ = Tree(), [0]
        for depth in range(params.max_depth):
            of_level = _sampled(of_tree, params.colsample_bylevel, rng)
            allowed = np.zeros((len(open_), len(feats)), bool)
            for i in range(len(open_)):
                allowed[i, _sampled(of_level, params.colsample_bynode, rng)] = True
            found = level(tree, open_, allowed, round_, valid is not None and depth == 0)
            if depth == 0 and best_prefix(losses, params.patience)[1]:
                break
            if depth == 0 and 0 in found:
                tree.value[0], tree.cover[0] = params.eta * _weight(found[0]["g"], found[0]["h"], params), found[0]["h"]
            after: list[int] = []
            for node in open_:
                best = found[node]["best"] if node in found else None
                if best is None:
                    continue
                sides = [tree.add(params.eta * _weight(best[a], best[b], params), best[b]) for a, b in (("gl", "hl"), ("gr", "hr"))]
                f, b = -best["f"], -best["b"]
                tree.split(node, f, b, float(edges[f][b - 1]) if b <= len(edges[f]) else math.inf, best["s"] == -1, best["gain"], *sides)
                after += sides
            open_ = after
            if not open_:
                break
        if best_prefix(losses, params.patience)[1]:
            break
        trees.append(tree)
        pending.append(tree)
        if len(pending) == TREES_PER_WRITE:
            blocks = _with_margins(blocks, len(feats), pending).checkpoint()
            pending = []
    if valid is not None and trees and len(losses) < len(trees):
        level(None, [], np.zeros((0, len(feats)), bool), len(trees), True)
    best = best_prefix(losses, None)[0] if losses else len(trees)
    return NewtonModel(feats, trees, losses, best)
