"""Profiles and summaries (A-1..A-8, A-10, T-1..T-3, ME-8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import exact_quantiles

QUANTILES = [0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """A-1: ``value_counts(normalize=True)``."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return c.select(label, "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def frequency(df: DataFrame, col: str) -> DataFrame:
    """A-2: frequency table, most frequent first."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(col))


def length_profile(df: DataFrame, text_col: str, label: str | None = None, topic: str | None = None,
                   exact: bool = True) -> DataFrame:
    """A-5: 9 length quantiles (linear interpolation), rows, positive rate, distinct topics.

    Exact quantiles come from distributed ranking (no task gathers all
    values); ``exact=False`` uses ``percentile_approx`` / ``approx_count_distinct``.
    """
    names = ["q00", "q01", "q05", "q25", "q50", "q75", "q95", "q99", "q100"]
    t = df.withColumn("_len", F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("double"))
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if label:
        aggs.append(F.avg(F.col(label).cast("double")).alias("pos_rate"))
    if topic:
        aggs.append((F.countDistinct(topic) if exact else F.approx_count_distinct(topic)).alias("n_topics"))
    if exact:
        q = exact_quantiles(t, "_len", QUANTILES, names=names)
    else:
        pa = t.agg(F.percentile_approx("_len", F.array(*[F.lit(x) for x in QUANTILES]), 10000).alias("_q"))
        q = pa.select(*[F.col("_q")[i].cast("double").alias(n) for i, n in enumerate(names)])
    return q.crossJoin(t.agg(*aggs))  # two one-row tables


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A-6: count, mean, std (ddof 1), min, quartiles, max per column, long form ``(column, stat...)``."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"))
                                         for c in cols])).alias("_e")).select("_e.*")
    stats = long.groupBy("column").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    q = exact_quantiles(long, "v", [0.25, 0.5, 0.75], by=["column"], names=["p25", "p50", "p75"])
    return stats.join(q, "column")


def positives_above(df: DataFrame, p_col: str, threshold: float) -> DataFrame:
    """A-7: count and share of scores above a threshold."""
    return df.agg(F.count_if(F.col(p_col) > threshold).alias("n_above"),
                  F.avg((F.col(p_col) > threshold).cast("double")).alias("share_above"))


def penalised_objective(trials: DataFrame, trial: str = "trial", metric: str = "auc", lam: float = 0.5) -> DataFrame:
    """A-10 / HP-3: mean and population std of fold metrics per trial; score = mean - lam * std."""
    return trials.groupBy(trial).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std")).withColumn(
        "score", F.col("mean") - F.lit(lam) * F.col("std"))


def importance_rollup(imp: DataFrame, top: int = 25, group: Sequence[str] | None = None) -> DataFrame:
    """ME-8 / A-4 / T-2: mean, median, sum and count of gain per feature, top ``top`` by mean gain
    with their rank, flagged when they belong to ``group``."""
    agg = imp.groupBy("feature").agg(F.avg("gain").alias("mean_gain"), F.median("gain").alias("median_gain"),
                                     F.sum("gain").alias("sum_gain"), F.count(F.lit(1)).alias("n"))
    top_df = agg.orderBy(F.col("mean_gain").desc(), F.col("feature")).limit(top)
    ranked = top_df.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("mean_gain").desc(), F.col("feature"))))  # at most ``top`` rows
    if group is not None:
        ranked = ranked.withColumn("in_group", F.col("feature").isin(*group))
    return ranked
