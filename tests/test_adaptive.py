"""The adaptive sampler against plain draws, its conditions, and a study that starts again."""

from __future__ import annotations

import math

import pytest

from renewal.operators import tuning
from renewal.operators.tuning import Param

SPACE = [
    Param("kind", "cat", choices=("a", "b", "c")),
    Param("eta", "float", 1e-4, 1.0, log=True),
    Param("depth", "int", 1, 25, step=1),
    Param("drop", "float", 0.0, 1.0, when=("kind", ("b",))),
]


def _surface(p):
    """Best at kind b, eta 0.03, depth 7, drop 0.8."""
    return -abs(math.log10(p["eta"] / 0.03)) - abs(p["depth"] - 7) / 8 - (abs(p["drop"] - 0.8) if p["kind"] == "b" else 1.0)


def test_beats_plain_draws_over_twenty_seeds():
    wins, gains = 0, []
    for seed in range(20):
        plain = max(_surface(tuning.sample(SPACE, t, seed)) for t in range(60))
        trials: list = []
        for t in range(60):
            p = tuning.suggest(SPACE, trials, t, seed)
            trials.append((p, _surface(p)))
        best = max(v for _, v in trials)
        wins, gains = wins + (best > plain), [*gains, best - plain]
    assert wins >= 15 and sum(gains) / 20 > 0.1


def test_conditions_and_ranges():
    trials = [(p, _surface(p)) for t in range(30) for p in [tuning.sample(SPACE, t)]]
    for t in range(40):
        p = tuning.suggest(SPACE, trials, t, seed=t)
        assert ("drop" in p) == (p["kind"] == "b") and 1e-4 <= p["eta"] <= 1 and 1 <= p["depth"] <= 25 and isinstance(p["depth"], int)
        assert p == tuning.suggest(SPACE, trials, t, seed=t)
        assert "drop" not in p or 0 <= p["drop"] <= 1
    assert tuning.suggest(SPACE, trials[:5], 3) == tuning.sample(SPACE, 3)


def test_density_is_one_over_the_line():
    for seen in ([], [0.0], [0.2, 0.21, 0.9], [0.5] * 9):
        assert sum(tuning._density((i + 0.5) / 2000, seen) for i in range(2000)) / 2000 == pytest.approx(1, abs=2e-3)
        draws = sorted(tuning._near(seen, (i % 53) / 53, (i + 0.5) / 2120) for i in range(2120))
        assert 0 <= draws[0] and draws[-1] <= 1


def test_a_study_goes_on_where_it_stopped(spark, tmp_path):
    whole = tuning.adaptive_study(spark, _surface, SPACE, 24, seed=3, batch=4).collect()
    path, calls = f"{tmp_path}/trials", []

    def objective(p):
        calls.append(p)
        if len(calls) == 14:
            raise RuntimeError("lost")
        return _surface(p)

    with pytest.raises(RuntimeError):
        tuning.adaptive_study(spark, objective, SPACE, 24, path, seed=3, batch=4)
    kept = spark.read.parquet(path).count()
    assert kept == 12
    again = tuning.adaptive_study(spark, _surface, SPACE, 24, path, seed=3, batch=4)
    strip = lambda rows: [(r.trial_id, r.params, r.value) for r in rows]
    assert strip(again.orderBy("trial_id").collect()) == strip(whole) and spark.read.parquet(path).count() == 24
    assert tuning.best_trial(again).first().value == max(r.value for r in whole)
    assert tuning.adaptive_study(spark, _surface, SPACE, 0).collect() == []


def test_random_search_over_any_number_of_folds(spark):
    """More folds than three, and two repeats: a row per draw and repeat."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.sql import functions as F

    df = spark.range(120).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 7 > 3).cast("int").alias("label"))
    got = tuning.random_search(df, ["a"], lambda _: LogisticRegression(featuresCol="_features", labelCol="label"), {"regParam": [0.0, 0.1, 1.0]}, n_iter=3, n_splits=4, n_repeats=2)
    assert sorted((r.trial_id, r.repeat) for r in got.collect()) == [(t, r) for t in range(3) for r in range(2)]
    assert all(0 <= r.f1 <= 1 for r in got.collect()) and tuning.summarize_search(got).count() == 3
