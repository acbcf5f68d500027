"""Readers, schema checks, strict lookups and feature export (IO-1/2/3/8/9, J-4, U-2)."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from foldwise.sources import sinks
from foldwise.sources.tables import read_sources, read_table, require_columns, strict_lookup, table


def test_read_csv_with_schema(spark):
    d = tempfile.mkdtemp(prefix="fw-csv-")
    p = os.path.join(d, "t.csv")
    with open(p, "w") as f:
        f.write('id,topic,answer,is_cheating\n1,a,"two\nlines, and a comma",1\n2,b,plain,0\n')
    df = read_table(spark, p, "id long, topic string, answer string, is_cheating int")
    rows = {r["id"]: r for r in df.collect()}
    assert rows[1]["answer"] == "two\nlines, and a comma" and rows[2]["is_cheating"] == 0


def test_read_sources_and_require_columns(spark):
    tr = spark.createDataFrame([(1, 0.5, 1)], "id long, x double, y int")
    te = spark.createDataFrame([(2, 0.7)], "id long, x double")
    u = read_sources({"train": tr, "test": te})
    assert sorted((r["split"], r["y"]) for r in u.collect()) == [("test", None), ("train", 1)]
    require_columns(u, ["id", "x", "split"])
    with pytest.raises(ValueError):
        require_columns(te, ["id", "y"])


def test_strict_lookup_fails_when_ids_missing(spark, sf_small):
    docs = table(spark, sf_small, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    vec_ids = table(spark, sf_small, "embeddings").select(F.col("vec_id").alias("id"))
    with pytest.raises(ValueError):
        strict_lookup(vec_ids, docs)  # at sf0.001 only 200 of the 500 vectors have a document
    assert strict_lookup(vec_ids, docs, on_missing="skip").columns == ["id"]
    emb = table(spark, sf_small, "embeddings").select(F.col("vec_id").alias("id"), "label")
    assert strict_lookup(docs.select("id"), emb).count() == 200  # every document has a vector


def test_export_features(spark):
    d = tempfile.mkdtemp(prefix="fw-exp-")
    tr = spark.createDataFrame([(1, 0.1)], "id long, f double")
    te = spark.createDataFrame([(2, 0.2)], "id long, f double")
    sinks.export_features(tr, te, os.path.join(d, "all"))
    back = spark.read.parquet(os.path.join(d, "all"))
    assert sorted((r["id"], r["split"]) for r in back.collect()) == [(1, "train"), (2, "test")]


def test_cluster_without_shared_folder_is_refused():
    import types

    from foldwise import session
    sc = types.SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: {}, master="spark://host:7077")
    spark = types.SimpleNamespace(sparkContext=sc, conf={})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(spark)
