"""Streaming lookups and sinks."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from foldwise.operators import encode as E
from foldwise.sources import sinks
from foldwise.streaming.scoring import encode_stream


def test_encode_stream_matches_batch(spark):
    d = tempfile.mkdtemp(prefix="fw-stream-")
    src = os.path.join(d, "in")
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "zz")], "id long, k string").write.parquet(src)
    tr = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "k string, y int")
    m, g = E.te_fit(tr, ["k"], "y")
    stream = spark.readStream.schema("id long, k string").parquet(src)
    q = encode_stream(stream, m, g, ["k"]).writeStream.format("memory").queryName("enc_out") \
        .option("checkpointLocation", os.path.join(d, "ckpt")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["id"]: r["TE_k_mean"] for r in spark.sql("select * from enc_out").collect()}
    assert got[1] == 0.5 and got[2] == 1.0 and abs(got[3] - 2 / 3) < 1e-12


def test_write_scores_and_metadata(spark):
    d = tempfile.mkdtemp(prefix="fw-sink-")
    df = spark.createDataFrame([(1, 0.25), (2, 0.0)], "id long, score double")
    sinks.write_scores(df, os.path.join(d, "s"), fixed=True)
    back = {r["id"]: r["score"] for r in spark.read.option("header", True).csv(os.path.join(d, "s")).collect()}
    assert back == {"1": "0.2500000000", "2": "0.0000010000"}
    sinks.write_metadata(spark, os.path.join(d, "m"), {"models": ["a", "b"], "best_w": 0.3})
    meta = spark.read.json(os.path.join(d, "m")).first()
    assert meta["best_w"] == 0.3 and list(meta["models"]) == ["a", "b"]
    m = spark.createDataFrame([(0.8123456789,)], "auc double")
    assert sinks.metric_stamped_path("oof_cv_{auc}.csv", m) == "oof_cv_0.812346.csv"
