"""Minimum slice (also ``entry``): applications -> FO-2 folds -> TE-3 on an interaction -> ME-3 AUC by fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.encode import target_encode_oof
from ..operators.folds import kfold_sql, stratified_kfold
from ..operators.metrics import auc, auc_sql
from ..sources.views import APPLICATIONS_SQL, TARGET, applications
from .common import finish

K = 5
SEED = 42


def train_folds(spark: SparkSession, sf_dir: str, k: int = K, seed: int = SEED) -> DataFrame:
    app = applications(spark, sf_dir).where(F.col("split") == "train")
    return stratified_kfold(app, k, TARGET, seed=seed)


def te_fold_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = train_folds(spark, sf_dir).withColumn(
        "grade_purpose", F.concat_ws("_", F.col("grade_subgrade"), F.col("loan_purpose")))
    enc = target_encode_oof(f, ["grade_purpose"], TARGET, "fold")
    r = auc(enc, score="TE_grade_purpose_mean", label=TARGET, by=["fold"])
    return finish(r.select("fold", "n_pos", "n_neg", "auc"))


TRAIN_FOLDS_SQL = kfold_sql(f"select * from ({APPLICATIONS_SQL}) a where split = 'train'", K, SEED, label=TARGET)


def te_oof_sql(src: str, key_expr: str, y: str = TARGET, fold: str = "fold", id_col: str = "id") -> str:
    """Independent DuckDB form of TE-3/TE-4: per excluded fold, re-aggregate the other folds' rows."""
    return f"""
    with x as (select {id_col} id, {fold} fold, {y} y, {key_expr} key from ({src}) s),
    ks as (select distinct fold from x),
    tp as (select ks.fold kf, x.key, count(*) n, avg(x.y) mu, var_samp(x.y) v
           from ks join x on x.fold <> ks.fold where x.key is not null group by ks.fold, x.key),
    g as (select ks.fold kf, avg(x.y) g from ks join x on x.fold <> ks.fold group by ks.fold),
    m as (select kf, case when var_samp(mu) > 0 then avg(v) / greatest(var_samp(mu), 1e-9) else 0e0 end m
          from tp group by kf)
    select x.id, x.fold, x.y, coalesce((tp.n * tp.mu + m.m * g.g) / (tp.n + m.m), g.g) te
    from x join g on g.kf = x.fold left join m on m.kf = x.fold
    left join tp on tp.kf = x.fold and tp.key = x.key"""


TE_FOLD_AUC_SQL = f"""
select fold, n_pos, n_neg, round(auc, 6) auc from (
{auc_sql(te_oof_sql(TRAIN_FOLDS_SQL, "grade_subgrade || '_' || loan_purpose"), score="te", label="y", by=["fold"])}
) r"""
