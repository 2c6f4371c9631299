"""Driver entry point, CSV round trip and the prediction sink."""

import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from renewal.sources import frames, io


def test_entry_runs(spark):
    import __spark_entry__ as se

    df = se.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert df.columns == ["tp", "fp", "fn", "tn", "precision", "recall", "f1"]


def test_csv_round_trip_with_unnamed_index(spark):
    d = frames.dirty(spark, SF001)
    path = tempfile.mkdtemp(prefix="renewal-csv-", dir="/tmp") + "/t"
    # an unnamed leading index column, as pandas writes it
    d.select(F.col("row_id").alias(" "), *[c for c in d.columns if c != "row_id"]).coalesce(1).write.option("header", True).csv(path)
    back = io.read_table(spark, path)
    assert back.columns[0] == "row_id" and dict(back.dtypes)["row_id"] == "bigint"
    assert back.count() == d.count()
    assert back.where("feature_36 = 'NA'").count() == 0
    assert back.where("feature_36 = 'a#'").count() > 0


def test_write_predictions(spark):
    df = spark.createDataFrame([(1, 0.7), (2, 0.5)], "row_id long, probability_1 double").withColumn("prediction", F.rint("probability_1"))
    path = tempfile.mkdtemp(prefix="renewal-pred-", dir="/tmp") + "/p"
    io.write_predictions(df, path)
    back = spark.read.csv(path, schema="row_id long, prediction int")
    assert sorted(tuple(r) for r in back.collect()) == [(1, 1), (2, 0)]


def test_dtype_split_and_results_table(spark):
    from renewal.operators.profile import dtype_split

    df = frames.renewal(spark, SF001)
    kinds = dict(dtype_split(df, exclude=("row_id", "split", "label")))
    assert kinds["segment"] == "text" and kinds["acctbal"] == "numeric" and kinds["n_orders"] == "numeric"
    res = spark.createDataFrame([(0, {"a": "1"}, 0.3)], "trial_id int, params map<string,string>, value double")
    path = tempfile.mkdtemp(prefix="renewal-res-", dir="/tmp") + "/r"
    io.write_table(res, path, "parquet")
    assert spark.read.parquet(path).collect()[0].value == 0.3
    io.write_table(res.select("trial_id", "value"), path + "_csv", "csv")
    assert spark.read.option("header", True).csv(path + "_csv").count() == 1
