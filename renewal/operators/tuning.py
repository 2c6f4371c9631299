"""Hyper-parameter search (H1–H6).

Trials are independent Spark fits launched from a driver thread pool (the executors do the
work); the search space is sampled with ``md5(seed:trial:param)`` so a study is reproducible
and its draws do not depend on the order trials finish in.  ``adaptive_study`` draws from what
the trials before have shown.  Results are DataFrames.
"""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renewal.session import ensure_checkpoint_dir


def _u(seed: int | str, trial: int, name: str) -> float:
    h = hashlib.md5(f"{seed}:{trial}:{name}".encode()).hexdigest()
    return int(h[:8], 16) / 4294967296.0


@dataclass(frozen=True)
class Param:
    """One search dimension: ``kind`` is 'cat', 'int' or 'float'; ``when`` makes it
    conditional on another parameter taking one of the given values."""

    name: str
    kind: str
    low: float | None = None
    high: float | None = None
    step: float | None = None
    log: bool = False
    choices: tuple = ()
    when: tuple[str, tuple] | None = None

    def draw(self, u: float):
        if self.kind == "cat":
            return self.choices[min(int(u * len(self.choices)), len(self.choices) - 1)]
        lo, hi = float(self.low), float(self.high)
        if self.log:
            v = math.exp(math.log(lo) + u * (math.log(hi) - math.log(lo)))
        elif self.step:
            n = int(math.floor((hi - lo) / self.step + 1e-9)) + 1
            v = lo + min(int(u * n), n - 1) * self.step
        else:
            v = lo + u * (hi - lo)
        return int(round(v)) if self.kind == "int" else float(v)


def sample(space: Sequence[Param], trial: int, seed: int = 10) -> dict:
    """H3: one parameter set; conditional parameters only when their parent matches."""
    out: dict = {}
    for p in space:
        if p.when is not None and out.get(p.when[0]) not in p.when[1]:
            continue
        out[p.name] = p.draw(_u(seed, trial, p.name))
    return out


def validate_steps(grid: dict[str, list], steps: Sequence[str]) -> dict[tuple[str, str], list]:
    """H5: ``step__param`` keys → ``(step, param)``; unknown steps fail before any fit."""
    out = {}
    for k, v in grid.items():
        if "__" not in k:
            raise ValueError(f"grid key {k!r} has no step prefix")
        step, param = k.split("__", 1)
        if step not in steps:
            raise ValueError(f"grid key {k!r} names unknown step {step!r}; steps are {list(steps)}")
        out[(step, param)] = v
    return out


def trial_study(
    spark: SparkSession,
    objective: Callable[[dict], float],
    space: Sequence[Param],
    n_trials: int,
    timeout: float | None = None,
    seed: int = 10,
    parallelism: int | None = None,
) -> DataFrame:
    """H2: run independent trials (maximise), stop launching new ones after ``timeout`` seconds.

    ``parallelism`` trials run at once (default: the session's default parallelism, at most 8);
    each is a set of Spark jobs, so the executors stay busy between small fits.

    Returns ``(trial_id, params map<string,string>, value, seconds)``.
    """
    start = time.time()
    rows = []

    def run(t: int):
        if timeout is not None and time.time() - start > timeout:
            return None
        params = sample(space, t, seed)
        t0 = time.time()
        value = float(objective(params))
        return (t, {k: str(v) for k, v in params.items()}, value, time.time() - t0)

    if parallelism is None:
        parallelism = min(8, spark.sparkContext.defaultParallelism)
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        for r in pool.map(run, range(n_trials)):
            if r is not None:
                rows.append(r)
    return spark.createDataFrame(rows, "trial_id int, params map<string,string>, value double, seconds double")


def _unit(p: Param, v) -> float:
    """A value's place in [0, 1] on its dimension (logarithmic where the dimension is)."""
    lo, hi, v = float(p.low), float(p.high), float(v)
    if p.log:
        lo, hi, v = math.log(lo), math.log(hi), math.log(v)
    return (v - lo) / (hi - lo) if hi > lo else 0.5


def _density(u: float, seen: list[float]) -> float:
    """A Parzen density on [0, 1] of the values seen, with one uniform kernel among them.

    A kernel is as wide as the gap to its farther neighbour, within bounds, and cut at 0 and 1.
    """
    edges = [0.0, *sorted(seen), 1.0]
    total = 1.0
    for i in range(1, len(edges) - 1):
        m = edges[i]
        s = min(max(m - edges[i - 1], edges[i + 1] - m, 1 / (1 + len(seen))), 1.0)
        inside = 0.5 * (math.erf((1 - m) / (s * math.sqrt(2))) - math.erf(-m / (s * math.sqrt(2))))
        total += math.exp(-0.5 * ((u - m) / s) ** 2) / (s * math.sqrt(2 * math.pi) * inside)
    return total / (1 + len(seen))


def _near(seen: list[float], u: float, v: float) -> float:
    """A draw from the density of ``seen``: ``u`` chooses the kernel, ``v`` the place in it (by inversion)."""
    edges = [0.0, *sorted(seen), 1.0]
    at = int(u * (len(seen) + 1))
    if at >= len(seen):
        return v
    m = edges[at + 1]
    s = min(max(m - edges[at], edges[at + 2] - m, 1 / (1 + len(seen))), 1.0)
    normal = NormalDist(m, s)
    a, b = normal.cdf(0.0), normal.cdf(1.0)
    return min(1.0, max(0.0, normal.inv_cdf(min(max(a + v * (b - a), 1e-12), 1 - 1e-12))))


def suggest(space: Sequence[Param], trials: Sequence[tuple[dict, float]], trial: int, seed: int = 10, startup: int = 10, good_share: float = 0.25, candidates: int = 24) -> dict:
    """H2: the parameters of the next trial by two densities over the trials so far (params, value).

    The best ``good_share`` of the trials give the density of good values, the others that of bad
    ones; of ``candidates`` draws from the good one the draw with the highest ratio is taken,
    dimension by dimension; a conditional parameter only looks at trials that have it.  The
    first ``startup`` trials are plain draws.  Same trials, same suggestion.
    """
    if len(trials) < startup:
        return sample(space, trial, seed)
    ranked = sorted(range(len(trials)), key=lambda i: (-trials[i][1], i))
    n_good = max(1, math.ceil(good_share * len(ranked)))
    good, bad = [trials[i][0] for i in ranked[:n_good]], [trials[i][0] for i in ranked[n_good:]]
    out: dict = {}
    for p in space:
        if p.when is not None and out.get(p.when[0]) not in p.when[1]:
            continue
        sides = [[t[p.name] for t in side if p.name in t] for side in (good, bad)]
        us = [(_u(seed, trial, f"{p.name}:{j}:kernel"), _u(seed, trial, f"{p.name}:{j}")) for j in range(candidates)]
        if p.kind == "cat":
            share = [{c: (1 + side.count(c)) / (len(p.choices) + len(side)) for c in p.choices} for side in sides]
            draws, upto = [], [sum(list(share[0].values())[: i + 1]) for i in range(len(p.choices))]
            draws = [p.choices[min(sum(u >= x for x in upto), len(p.choices) - 1)] for u, _ in us]
            out[p.name] = max(draws, key=lambda c: share[0][c] / share[1][c])
            continue
        seen = [[_unit(p, v) for v in side] for side in sides]
        draws = [_near(seen[0], u, v) for u, v in us]
        best = max(draws, key=lambda u: math.log(_density(u, seen[0])) - math.log(_density(u, seen[1])))
        out[p.name] = p.draw(min(best, 1 - 1e-9))
    return out


def _typed(space: Sequence[Param], params: dict[str, str]) -> dict:
    """Stored (text) parameters as values of their dimensions."""
    of = {p.name: p for p in space}
    read = {"int": int, "float": float}
    return {k: next((c for c in of[k].choices if str(c) == v), v) if of[k].kind == "cat" else read[of[k].kind](v) for k, v in params.items() if k in of}


TRIALS = "trial_id int, params map<string,string>, value double, seconds double"


def adaptive_study(
    spark: SparkSession,
    objective: Callable[[dict], float],
    space: Sequence[Param],
    n_trials: int,
    path: str | None = None,
    timeout: float | None = None,
    seed: int = 10,
    startup: int = 10,
    batch: int | None = None,
) -> DataFrame:
    """H2: trials (maximise) whose parameters follow from the trials before (``suggest``).

    ``batch`` trials are suggested at once and run at once (default: as in ``trial_study``), so a study
    depends on the seed and the batch, not on which trial ends first.  With ``path`` every
    batch is appended to that table, and a study that starts again goes on after the trials it holds.
    """
    start = time.time()
    batch = batch or max(1, min(8, spark.sparkContext.defaultParallelism))
    rows: list[tuple] = []
    if path is not None:
        try:
            rows = [tuple(r) for r in spark.read.schema(TRIALS).parquet(path).orderBy("trial_id").collect()]  # a row per trial
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise

    def run(task: tuple[int, dict]) -> tuple:
        t0 = time.time()
        value = float(objective(task[1]))
        return (task[0], {k: str(v) for k, v in task[1].items()}, value, time.time() - t0)

    with ThreadPoolExecutor(max_workers=batch) as pool:
        while len(rows) < n_trials and (timeout is None or time.time() - start <= timeout):
            known = [(_typed(space, p), v) for _, p, v, _ in rows]
            ids = range(len(rows), min(n_trials, len(rows) + batch))
            new = list(pool.map(run, [(t, suggest(space, known, t, seed, startup)) for t in ids]))
            if path is not None:
                spark.createDataFrame(new, TRIALS).coalesce(1).write.mode("append").parquet(path)
            rows += new
    return spark.createDataFrame(rows, TRIALS)


def best_trial(trials: DataFrame, value: str = "value") -> DataFrame:
    """H4: the best trial (ties → smallest trial id)."""
    return trials.orderBy(F.desc(value), "trial_id").limit(1)


def random_search(
    train: DataFrame,
    feats: Sequence[str],
    build: Callable[[dict], object],
    grid: dict[str, list],
    n_iter: int = 10,
    n_splits: int = 5,
    n_repeats: int = 2,
    seed: int = 10,
    parallelism: int = 2,
    label: str = "label",
    key: str = "row_id",
) -> DataFrame:
    """H1: random draws from a grid, scored by F1 of class 1 with repeated stratified folds.

    Each repeat is one ``CrossValidator`` over a ``foldCol`` (Spark fits the folds × draws in
    parallel); the mean over repeats is reported per draw:
    ``(trial_id, params, repeat, f1)`` rows (the cv_results table).
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator

    from renewal.operators.split import strat_folds

    ensure_checkpoint_dir(train.sparkSession)
    space = [Param(k, "cat", choices=tuple(v)) for k, v in grid.items()]
    draws = [sample(space, t, seed) for t in range(n_iter)]
    folds = strat_folds(train.select(key, label), n_splits, n_repeats, seed)
    spark = train.sparkSession
    rows = []
    for r in range(n_repeats):
        data = train.join(folds.where(F.col("repeat") == r).select(key, F.col("fold").alias("_fold")), key).checkpoint()
        est = build({})
        pipe = Pipeline(stages=[VectorAssembler(inputCols=list(feats), outputCol="_features"), est])
        maps = [{est.getParam(k): v for k, v in d.items()} for d in draws]
        ev = MulticlassClassificationEvaluator(labelCol=label, metricName="fMeasureByLabel", metricLabel=1.0)
        cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps, evaluator=ev, numFolds=n_splits, foldCol="_fold", parallelism=parallelism, seed=seed)
        model = cv.fit(data)
        for t, m in enumerate(model.avgMetrics):
            rows.append((t, {k: str(v) for k, v in draws[t].items()}, r, float(m)))
    return spark.createDataFrame(rows, "trial_id int, params map<string,string>, repeat int, f1 double")


def summarize_search(cv_results: DataFrame) -> DataFrame:
    """Mean F1 per draw over repeats (``value``), for ``best_trial``."""
    return cv_results.groupBy("trial_id").agg(F.first("params").alias("params"), F.avg("f1").alias("value"))


def ablation(spark: SparkSession, variants: dict[str, Callable[[], float]]) -> DataFrame:
    """H6: one F1 per preparation variant, ``(variant, f1)``."""
    rows = [(name, float(fn())) for name, fn in variants.items()]
    return spark.createDataFrame(rows, "variant string, f1 double")


def resampled_cv(
    train: DataFrame,
    feats: Sequence[str],
    resample: Callable[[DataFrame], DataFrame],
    fit: Callable[[DataFrame], object],
    n_splits: int = 5,
    n_repeats: int = 2,
    seed: int = 10,
    label: str = "label",
    key: str = "row_id",
) -> DataFrame:
    """R11 inside H1: per fold, resample the training part only, fit, and score the untouched
    held-out part — synthetic or removed rows never reach a validation fold.

    Returns ``(repeat, fold, f1, train_rows)``; each fold's resampled frame is checkpointed.
    """
    from renewal.operators.evaluate import f1_value
    from renewal.operators.models import predict
    from renewal.operators.split import strat_folds

    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    folds = strat_folds(train.select(key, label), n_splits, n_repeats, seed)
    rows = []
    for r in range(n_repeats):
        data = train.join(folds.where(F.col("repeat") == r).select(key, F.col("fold").alias("_fold")), key).checkpoint()
        for f in range(n_splits):
            part = resample(data.where(F.col("_fold") != f).drop("_fold")).checkpoint()
            model = fit(part)
            held = data.where(F.col("_fold") == f).drop("_fold")
            rows.append((r, f, f1_value(predict(model, held, feats)), part.count()))
    return spark.createDataFrame(rows, "repeat int, fold int, f1 double, train_rows bigint")


def resampled_search(
    train: DataFrame,
    feats: Sequence[str],
    resample: Callable[[DataFrame, dict], DataFrame],
    fit: Callable[[DataFrame, dict], object],
    grid: dict[str, list],
    n_iter: int = 10,
    n_splits: int = 5,
    n_repeats: int = 2,
    seed: int = 10,
) -> DataFrame:
    """H1 with a resampling step: each draw (``step__param`` keys, validated) is scored by
    ``resampled_cv``; returns ``(trial_id, params, f1)`` with the mean over folds."""
    validate_steps(grid, ("resample", "model"))
    space = [Param(k, "cat", choices=tuple(v)) for k, v in grid.items()]
    spark = train.sparkSession
    rows = []
    for t in range(n_iter):
        d = sample(space, t, seed)
        rp = {k.split("__", 1)[1]: v for k, v in d.items() if k.startswith("resample__")}
        mp = {k.split("__", 1)[1]: v for k, v in d.items() if k.startswith("model__")}
        cv = resampled_cv(train, feats, lambda df: resample(df, rp), lambda df: fit(df, mp), n_splits, n_repeats, seed)
        rows.append((t, {k: str(v) for k, v in d.items()}, float(cv.agg(F.avg("f1")).collect()[0][0])))
    return spark.createDataFrame(rows, "trial_id int, params map<string,string>, value double")
