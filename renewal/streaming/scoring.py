"""Incremental scoring with Structured Streaming (the S3 sink fed as files arrive).

The batch path predicts the test table and writes one label per row.  When test rows
arrive as files, the same fitted preparation and model run per micro-batch: a file
stream source, the fill values and the model applied as ordinary transformations, and a
file sink whose commit log (in the shared checkpoint folder) makes every batch exactly-once
and restartable after a lost executor or driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from renewal.operators.impute import apply_fill
from renewal.operators.models import predict
from renewal.session import ensure_checkpoint_dir


def scored_stream(spark: SparkSession, source_dir: str, schema: str, model, feats: Sequence[str], fill: dict, key: str = "row_id") -> DataFrame:
    """A streaming DataFrame of ``(key, probability_1, prediction)`` over parquet files in ``source_dir``."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(source_dir)
    return predict(model, apply_fill(rows, fill), feats, keep=[key])


def start_scoring(
    spark: SparkSession,
    source_dir: str,
    schema: str,
    model,
    feats: Sequence[str],
    fill: dict,
    sink_dir: str,
    checkpoint: str | None = None,
    key: str = "row_id",
    available_now: bool = True,
) -> StreamingQuery:
    """Start the stream; labels go to ``sink_dir`` as headerless CSV (row key, label)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    ckpt = checkpoint or f"{base}/streams/scoring"
    out = scored_stream(spark, source_dir, schema, model, feats, fill, key).select(key, F.col("prediction").cast("int").alias("prediction"))
    writer = out.writeStream.format("csv").option("header", False).option("checkpointLocation", ckpt).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start(sink_dir)
