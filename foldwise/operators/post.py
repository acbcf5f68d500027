"""Score post-processing (PP-1..PP-7, P-10..P-12, IO-5, IO-6, IO-11, A-11).

All arithmetic on score columns; the only aggregates are one-row shares and
per-topic statistics (one row per topic).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import isotonic
from .joins import lookup_join


def clip(c: Column, lo: float, hi: float) -> Column:
    """P-11."""
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def confident_mask(p: Column, hi: Column | float, lo: Column | float) -> Column:
    """P-10: rows with p >= hi or p <= lo."""
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    return (p >= hi_c) | (p <= lo_c)


def pseudo_label_thresholds(test: DataFrame, p_col: str = "p", strict=(0.98, 0.02), relaxed=(0.95, 0.05),
                            min_share: float = 0.3) -> DataFrame:
    """PP-1: one-row table ``(hi, lo)``: the strict pair, or the relaxed pair when fewer than
    ``min_share`` of the rows pass the strict one."""
    p = F.col(p_col)
    share = test.agg(F.count(F.lit(1)).alias("_n"),
                     F.sum(confident_mask(p, strict[0], strict[1]).cast("long")).alias("_k"))
    use_strict = F.col("_k") >= F.col("_n") * F.lit(min_share)
    return share.select(F.when(use_strict, F.lit(strict[0])).otherwise(F.lit(relaxed[0])).alias("hi"),
                        F.when(use_strict, F.lit(strict[1])).otherwise(F.lit(relaxed[1])).alias("lo"))


def pseudo_labels(train: DataFrame, test: DataFrame, id_col: str = "id", y_col: str = "y", p_col: str = "p",
                  **kw) -> DataFrame:
    """PP-2 / U-1: training rows (weight 1) plus confident test rows labelled ``p > .5`` with weight
    ``.5 * max(p, 1 - p)``. Output ``(id, y, weight, source)``."""
    th = pseudo_label_thresholds(test, p_col, **kw)
    p = F.col(p_col)
    sel = test.crossJoin(F.broadcast(th)).where(confident_mask(p, F.col("hi"), F.col("lo")))  # one-row table
    pseudo = sel.select(F.col(id_col), (p > 0.5).cast("int").alias(y_col),
                        (F.lit(0.5) * F.greatest(p, F.lit(1.0) - p)).alias("weight"), F.lit("pseudo").alias("source"))
    base = train.select(F.col(id_col), F.col(y_col).cast("int").alias(y_col), F.lit(1.0).alias("weight"),
                        F.lit("train").alias("source"))
    return base.unionByName(pseudo)


def topic_calibration(test: DataFrame, train: DataFrame, topic_col: str = "topic", y_col: str = "y",
                      p_col: str = "p", min_count: int = 5, strength: float = 0.1) -> DataFrame:
    """PP-4 / A-3 / J-6: for topics with more than ``min_count`` training rows, mean > .7 pushes test
    scores up (``(1-s) p + s clip(p + .1)``), mean < .3 down; other rows unchanged. Adds ``p_topic``."""
    stats = (train.where(F.col(topic_col).isNotNull()).groupBy(topic_col)
             .agg(F.avg(F.col(y_col).cast("double")).alias("_tm"), F.count(F.lit(1)).alias("_tc"))
             .where(F.col("_tc") > min_count))
    # one row per topic: broadcast after a size check
    j = lookup_join(test, stats, topic_col, "left")
    p = F.col(p_col)
    up = p * (1 - strength) + clip(p + 0.1, 0.0, 1.0) * strength
    down = p * (1 - strength) + clip(p - 0.1, 0.0, 1.0) * strength
    adj = F.when(F.col("_tm") > 0.7, up).when(F.col("_tm") < 0.3, down).otherwise(p)
    return j.withColumn("p_topic", adj).drop("_tm", "_tc")


def isotonic_fit_transform(oof: DataFrame, target: DataFrame, p_col: str = "p", y_col: str = "y",
                           out: str = "p_iso") -> DataFrame:
    """PP-5: isotonic regression fitted on OOF scores, applied to ``target`` (constant outside the fitted range, linear
    between blocks)."""
    return isotonic.transform(target, isotonic.fit(oof, p_col, y_col), p_col, out)


def final_smoothing(calibrated: Column, uncalibrated: Column) -> Column:
    """PP-6: clip to [.001, .999], then .97 * calibrated + .03 * uncalibrated."""
    return F.lit(0.97) * clip(calibrated, 0.001, 0.999) + F.lit(0.03) * uncalibrated


def sharpen(p: Column, power: float = 0.9) -> Column:
    """PP-7."""
    return F.pow(p, F.lit(power))


def variants(df: DataFrame, id_col: str, calibrated: str, uncalibrated: str) -> DataFrame:
    """IO-6: main / conservative / aggressive columns from one scored table."""
    main = final_smoothing(F.col(calibrated), F.col(uncalibrated))
    return df.select(F.col(id_col), main.alias("main"), clip(F.col(calibrated), 0.001, 0.999).alias("conservative"),
                     sharpen(main).alias("aggressive"))


def fixed_precision(p: Column, lo: float = 1e-6, hi: float = 1 - 1e-6) -> Column:
    """IO-5: ``%.10f`` after clipping."""
    return F.format_string("%.10f", clip(p, lo, hi))


def binarise(p: Column, t: Column | float) -> Column:
    """P-12."""
    return (p >= (t if isinstance(t, Column) else F.lit(t))).cast("int")


def validate_output(out: DataFrame, expected_ids: DataFrame, id_col: str = "id", label_col: str = "label") -> DataFrame:
    """IO-11: one row: output rows, expected rows, labels outside {0,1}, expected ids missing from the output."""
    o = out.agg(F.count(F.lit(1)).alias("rows"),
                F.sum((~F.col(label_col).isin(0, 1) | F.col(label_col).isNull()).cast("long")).alias("bad_labels"))
    e = expected_ids.agg(F.count(F.lit(1)).alias("expected_rows"))
    missing = expected_ids.select(id_col).join(out.select(id_col), id_col, "left_anti").agg(
        F.count(F.lit(1)).alias("missing_ids"))
    return o.crossJoin(e).crossJoin(missing)  # three one-row tables
