"""The streaming scorer gives the batch predictions, exactly once."""

import tempfile

from conftest import SF01
from renewal.operators import models
from renewal.operators.impute import apply_fill, fit_means
from renewal.sources import frames
from renewal.streaming import start_scoring

FEATS = ["acctbal", "n_orders", "avg_price", "max_price", "recency_days", "nation"]


def test_stream_matches_batch(spark):
    df = frames.renewal(spark, SF01)
    tr, te = df.where("split='train'"), df.where("split='test'")
    fill = fit_means(tr, FEATS)
    model = models.boosted_trees(models.class_weight(apply_fill(tr.select("row_id", *FEATS, "label"), fill)), FEATS, {"n_estimators": 5, "max_depth": 3})
    root = tempfile.mkdtemp(prefix="renewal-stream-", dir="/tmp")
    src = te.select("row_id", *FEATS)
    src.where("row_id % 2 = 0").write.parquet(f"{root}/in/a")
    src.where("row_id % 2 = 1").write.parquet(f"{root}/in/b")
    schema = ", ".join(f"{n} {t}" for n, t in src.dtypes)
    q = start_scoring(spark, f"{root}/in/*", schema, model, FEATS, fill, f"{root}/out", checkpoint=f"{root}/ckpt")
    q.awaitTermination(300)
    got = sorted(tuple(r) for r in spark.read.csv(f"{root}/out", schema="row_id long, prediction int").collect())
    want = sorted((r.row_id, r.prediction) for r in models.predict(model, apply_fill(src, fill), FEATS, keep=["row_id"]).collect())
    assert got == want
