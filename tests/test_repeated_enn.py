"""Repeated ENN searches its rows once, and again only those whose list ran short."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from renewal.operators import neighbors, resample
from renewal.operators.split import class_counts

FEATS = ["a", "b"]


def _frame(spark, n, seed, copies=0):
    rng = np.random.default_rng(seed)
    label = rng.choice((0, 0, 0, 1), n)
    x = (rng.normal(size=(n, 2)) + 0.9 * label[:, None]).round(3)
    rows = [(i, float(a), float(b), int(t)) for i, ((a, b), t) in enumerate(zip(x, label, strict=True))]
    rows += rows[:copies]  # keys that come twice
    return spark.createDataFrame(rows, "row_id long, a double, b double, label int").repartition(3)


def _plain(df, strategy):
    start = before = class_counts(df)
    smallest = min(start, key=lambda c: (start[c], -c))
    while True:
        df = resample.enn_round(df, FEATS, 3, strategy=strategy).checkpoint()
        now = class_counts(df)
        if now == before or len(now) < len(start) or any(n < start[smallest] for c, n in now.items() if c != smallest):
            return df
        before = now


@pytest.mark.parametrize("reserve, strategy, copies", [(9, "auto", 0), (0, "auto", 0), (1, "all", 0), (9, "majority", 0), (9, "auto", 20)])
def test_repeated_enn_equals_plain_rounds(spark, monkeypatch, reserve, strategy, copies):
    monkeypatch.setattr(resample, "RESERVE", reserve, raising=False)
    df = _frame(spark, 240, 3, copies).checkpoint()
    got = resample.repeated_enn(df, FEATS, 3, strategy=strategy)
    assert got.columns == ["row_id", *FEATS, "label"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, _plain(df, strategy).collect()))


def test_repeated_enn_searches_all_rows_once(spark, monkeypatch):
    asked = []

    def counted(query, base, *rest, step=neighbors.knn, **named):
        asked.append(base.count() if query is None else query.count())
        return step(query, base, *rest, **named)

    monkeypatch.setattr(resample, "knn", counted)
    df = _frame(spark, 240, 3).checkpoint()
    before = class_counts(df)
    assert sum(class_counts(resample.repeated_enn(df, FEATS, 3)).values()) < sum(before.values())
    assert asked[0] == 240 and sum(asked[1:]) < 120


def test_knn_of_rows_of_their_own_equals_collapsed(spark, monkeypatch):
    df = _frame(spark, 150, 5).withColumn("a", F.when(F.col("row_id") != 7, F.col("a"))).dropDuplicates(["a", "b"]).checkpoint()
    asking = df.where("row_id % 4 = 0").select("row_id", *FEATS)

    def both():
        return [sorted(tuple(r) for r in neighbors.knn(q, df, FEATS, 4, extra=["label", "a"]).collect()) for q in (None, asking)]

    rows = both()
    monkeypatch.setattr(neighbors, "_all_differ", lambda *_: False)
    assert rows == both() and len(rows[0]) == 4 * (df.count() - 1)
