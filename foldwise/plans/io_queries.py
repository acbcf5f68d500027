"""Round trips through the readers and writers: what was written is read back and compared by SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import metrics as ME
from ..operators import post as PP
from ..session import ensure_checkpoint_dir
from ..sources import sinks
from ..sources.tables import read_sources, read_table, require_columns, table
from ..sources.views import ANSWERS_SQL, SCORES_SQL, answers, scores
from .common import finish, r6
from .score_queries import POST_VARIANTS_SQL, _calibrated

ANSWER_SCHEMA = "id long, topic string, answer string, is_cheating int"


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/io-{uuid.uuid4().hex}"


def csv_sources(spark, sf_dir):
    """IO-1 / IO-2 / IO-3 / U-2: train and test written as CSV, read with a declared schema, checked, and joined into
    one table tagged by split (the test file has no label)."""
    folder = _folder(spark)
    a = answers(spark, sf_dir)
    quoted = {"header": True, "escape": '"', "quoteAll": True, "emptyValue": ""}
    a.where("split = 'train'").select("id", "topic", "answer", "is_cheating").write.options(**quoted).csv(f"{folder}/train")
    a.where("split = 'test'").select("id", "topic", "answer").write.options(**quoted).csv(f"{folder}/test")
    train = require_columns(read_table(spark, f"{folder}/train", ANSWER_SCHEMA), ["id", "answer", "is_cheating"])
    test = require_columns(read_table(spark, f"{folder}/test", "id long, topic string, answer string"), ["id", "answer"])
    both = read_sources({"train": train, "test": test})
    return finish(both.select("id", "topic", F.md5("answer").alias("answer_md5"), "is_cheating", "split"))


CSV_SOURCES_SQL = f"select id, topic, md5(answer) answer_md5, cast(is_cheating as bigint) is_cheating, split from ({ANSWERS_SQL}) a"


def score_files(spark, sf_dir):
    """IO-4 / IO-6: the three score variants, scored once, written as files with a header and read back."""
    folder = _folder(spark)
    v = PP.variants(_calibrated(spark, sf_dir), "id", "p_topic", "p")
    scored = f"{folder}/scored"
    v.write.parquet(scored)
    paths = sinks.write_variants(spark.read.parquet(scored), f"{folder}/files")
    out = None
    for path in paths:
        one = read_table(spark, path, "id long, is_cheating double", multi_line=False) \
            .withColumn("variant", F.lit(path.rsplit("/", 1)[1]))
        out = one if out is None else out.unionByName(one)
    return finish(out.select("id", "variant", F.col("is_cheating").alias("score")))


SCORE_FILES_SQL = f"""select id, variant, score from ({POST_VARIANTS_SQL}) v
unpivot (score for variant in (main, conservative, aggressive))"""


def feature_export(spark, sf_dir):
    """IO-9: one feature table partitioned by split, read back."""
    a = answers(spark, sf_dir)
    feats = a.select("id", F.length("answer").alias("n_chars"), F.col("is_cheating").alias("y"), "split")
    path = f"{_folder(spark)}/features"
    sinks.export_features(feats.where("split = 'train'").drop("split"), feats.where("split = 'test'").drop("split", "y"), path)
    return finish(spark.read.parquet(path).select("id", "n_chars", "y", F.col("split").cast("string").alias("split")))


FEATURE_EXPORT_SQL = f"select id, length(answer) n_chars, cast(is_cheating as bigint) y, split from ({ANSWERS_SQL}) a"


def run_record(spark, sf_dir):
    """IO-7 / IO-10: out-of-fold scores written under a path stamped with their metric, a metadata record beside them,
    both read back: rows of the scores per model, with what the record says."""
    folder = _folder(spark)
    s = scores(spark, sf_dir)
    by_model = ME.auc(s, "p", "y", by=["model"])
    best = by_model.orderBy(F.desc("auc"), "model").limit(1)
    path = sinks.metric_stamped_path(folder + "/oof_cv_{auc}", best)
    s.write.parquet(path)
    sinks.write_metadata(spark, f"{folder}/meta", {"oof": path, "models": [1, 2, 3], "stamp": path.rsplit("_", 1)[1]})
    meta = spark.read.json(f"{folder}/meta")  # one row
    stamp = meta.select("oof", "stamp").first()
    return finish(spark.read.parquet(stamp["oof"]).groupBy("model").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"))
                  .withColumn("best_auc", F.lit(float(stamp["stamp"]))))


RUN_RECORD_SQL = f"""with s as ({SCORES_SQL}),
a as ({ME.auc_sql(SCORES_SQL, by=['model'])})
select cast(model as bigint) model, count(*) n, {r6('avg(p)')} mean_p, (select round(max(auc), 6) from a) best_auc from s group by model"""


def softmax_scores(spark, sf_dir):
    """ML-6: two logits per row to the probability of the second class, and back to the score."""
    s = scores(spark, sf_dir)
    z = F.log(F.col("p") / (F.lit(1.0) - F.col("p")))
    return finish(s.select("id", "model", ME.softmax2(-z / 2, z / 2).alias("p_soft")))


SOFTMAX_SCORES_SQL = f"""select id, cast(model as bigint) model,
       {r6('exp(z / 2) / (exp(-z / 2) + exp(z / 2))')} p_soft
from (select id, model, ln(p / (1 - p)) z from ({SCORES_SQL}) s) x"""
