"""Sparse one-hot rows: many categories, hot values, nulls, unseen values, repeated keys."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from renewal.operators import encode


def test_a_hundred_thousand_categories(spark):
    """A third of the rows hold one value; nothing per value reaches the driver."""
    n = 150_000
    df = spark.range(n).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id"))).alias("a"), (F.col("id") % 2).alias("b"))
    dictionary = encode.fit_sparse_dictionary(df, ["a", "b"]).checkpoint()
    assert dictionary.count() == 100_003 and dictionary.agg(F.min("index"), F.max("index"), F.countDistinct("index")).first() == (0, 100_002, 100_003)
    assert {(r.column, r.value) for r in dictionary.where("hot").collect()} == {("a", "hot"), ("b", "0"), ("b", "1")}
    got = encode.one_hot_sparse(df, ["a", "b"], dictionary).checkpoint()
    assert got.count() == n and got.filter("size(indices) <> 2").isEmpty()
    back = got.select("row_id", F.explode("indices").alias("index")).join(dictionary, "index").groupBy("row_id").pivot("column", ["a", "b"]).agg(F.first("value"))
    assert back.join(df.withColumnRenamed("a", "a0").withColumnRenamed("b", "b0"), "row_id").filter("a <> a0 or b <> cast(b0 as string)").isEmpty()


def test_odd_rows(spark):
    train = spark.createDataFrame([(1, "x", None), (2, "y", "x"), (3, None, "")], "row_id long, a string, b string")
    test = spark.createDataFrame([(1, "x", "x"), (2, "new", None), (3, None, None), (4, "y", ""), (4, "x", None), (None, "x", None)], "row_id long, a string, b string")
    d = encode.fit_sparse_dictionary(train, ["a", "b"])
    index = {(r.column, r.value): r["index"] for r in d.collect()}
    assert set(index) == {("a", "x"), ("a", "y"), ("b", "x"), ("b", "")} and sorted(index.values()) == [0, 1, 2, 3]
    got = {r.row_id: r.indices for r in encode.one_hot_sparse(test, ["a", "b"], d).collect()}
    want = {1: [("a", "x"), ("b", "x")], 2: [], 3: [], 4: [("a", "x"), ("a", "y"), ("b", "")], None: [("a", "x")]}
    assert got == {k: sorted(index[v] for v in vs) for k, vs in want.items()}
    assert encode.one_hot_sparse(test, ["a", "b"], d.limit(0)).filter("size(indices) > 0").isEmpty()
    empty = encode.fit_sparse_dictionary(train.limit(0), ["a"])
    assert empty.collect() == [] and encode.one_hot_sparse(test.limit(0), ["a"], empty).collect() == []


def test_vectors_feed_a_learner(spark):
    from pyspark.ml.classification import LogisticRegression

    df = spark.range(300).select(F.col("id").alias("row_id"), F.concat(F.lit("v"), F.col("id") % 7).alias("a"), (F.col("id") % 7 < 3).cast("int").alias("label"))
    d = encode.fit_sparse_dictionary(df, ["a"])
    rows = encode.sparse_vectors(encode.one_hot_sparse(df, ["a"], d), 7).join(df, "row_id")
    model = LogisticRegression(labelCol="label").fit(rows)
    assert model.transform(rows).filter("prediction <> label").isEmpty()
    assert rows.first().features.toArray().sum() == pytest.approx(1)
