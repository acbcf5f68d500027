"""Metrics and thresholds (ME-1..ME-7, ME-10, A-9..A-12).

Exact ROC AUC with ties (half credit) is the core primitive. Rows are first
folded to one row per distinct score (map-side partial aggregation), the
distinct scores are cut into balanced, order-preserving ranges by the range
partitioner, each range is prefix-summed inside its own task, and only the
per-range totals (``groups * buckets`` rows) are prefix-summed across
ranges. No step holds all rows of a group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import default_buckets, range_bucketed


def _score_counts(df: DataFrame, score: str, label: str, by: Sequence[str], weight: str | None = None) -> DataFrame:
    y = F.col(label).cast("int")
    w = F.col(weight) if weight else F.lit(1)
    return df.groupBy(*by, score).agg(
        F.sum(F.when(y == 1, w).otherwise(0)).alias("_pos"),
        F.sum(F.when(y == 0, w).otherwise(0)).alias("_neg"),
    )


def auc(df: DataFrame, score: str = "p", label: str = "y", by: Sequence[str] = (), n_buckets: int | None = None,
        out: str = "auc", weight: str | None = None, bounds: Sequence[float] | None = None) -> DataFrame:
    """ME-1/ME-2/ME-3: exact ROC AUC per group; 0.5 when a class is missing.

    Returns ``(*by, n_pos, n_neg, auc)``. A row stands for ``weight`` rows (default: itself). ``bounds`` are the scores that
    cut the ranges, where the caller knows them; otherwise a pass over the distinct scores finds them.
    """
    by = list(by)
    dist = _score_counts(df, score, label, by, weight)
    nb = n_buckets or default_buckets(df)
    rb = range_bucketed(dist, [*by, score], nb, bounds=bounds)
    below = Window.partitionBy(*by, "_b").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    rb = rb.withColumn("_nb", F.coalesce(F.sum("_neg").over(below), F.lit(0)))
    per_b = rb.groupBy(*by, "_b").agg(
        F.sum(F.col("_pos") * (F.col("_nb") + F.lit(0.5) * F.col("_neg"))).alias("_win"),
        F.sum("_pos").alias("_P"),
        F.sum("_neg").alias("_N"),
    )
    # at most groups * n_buckets rows
    prev = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1) if by else \
        Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per_b = per_b.withColumn("_before", F.coalesce(F.sum("_N").over(prev), F.lit(0)))
    res = per_b.groupBy(*by).agg(
        F.sum(F.col("_win") + F.col("_P") * F.col("_before")).alias("_num"),
        F.sum("_P").alias("n_pos"),
        F.sum("_N").alias("n_neg"),
    )
    value = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                   F.col("_num") / (F.col("n_pos") * F.col("n_neg"))).otherwise(F.lit(0.5))
    return res.select(*by, "n_pos", "n_neg", value.alias(out))


def auc_sql(source: str, score: str = "p", label: str = "y", by: Sequence[str] = (), out: str = "auc") -> str:
    """DuckDB oracle text of ``auc`` (one window per group over distinct scores)."""
    g = ", ".join(by)
    gsel = f"{g}, " if by else ""
    part = f"partition by {g} " if by else ""
    grp = f"group by {g}" if by else ""
    return f"""
      select {gsel}cast(sum(pos) as bigint) n_pos, cast(sum(neg) as bigint) n_neg,
             case when sum(pos) > 0 and sum(neg) > 0
                  then sum(pos * (nb + 0.5e0 * neg)) / (sum(pos) * sum(neg)) else 0.5e0 end {out}
      from (select *, coalesce(sum(neg) over ({part}order by {score} rows between unbounded preceding and 1 preceding), 0) nb
            from (select {gsel}{score}, sum(case when {label} = 1 then 1 else 0 end) pos,
                         sum(case when {label} = 0 then 1 else 0 end) neg
                  from ({source}) a0 group by {gsel}{score}) a1) a2
      {grp}"""


def roc_curve(df: DataFrame, score: str = "p", label: str = "y", by: Sequence[str] = (),
              n_buckets: int | None = None) -> DataFrame:
    """ME-4: ``(*by, threshold, tp, fp, tpr, fpr)``, one row per distinct score.

    Counts are of rows with score >= threshold. Within-range suffix sums run
    per range; per-range totals (bounded) give each range's offset, joined
    back by broadcast.
    """
    by = list(by)
    dist = _score_counts(df, score, label, by)
    nb = n_buckets or default_buckets(df)
    rb = range_bucketed(dist, [*by, score], nb)
    at_or_above = Window.partitionBy(*by, "_b").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    rb = (rb.withColumn("_tp_in", F.sum("_pos").over(at_or_above))
            .withColumn("_fp_in", F.sum("_neg").over(at_or_above)))
    per_b = rb.groupBy(*by, "_b").agg(F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    after = (Window.partitionBy(*by) if by else Window).orderBy(F.col("_b").desc()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    tot = Window.partitionBy(*by) if by else Window.partitionBy()
    per_b = (per_b.withColumn("_tp_off", F.coalesce(F.sum("_P").over(after), F.lit(0)))
                  .withColumn("_fp_off", F.coalesce(F.sum("_N").over(after), F.lit(0)))
                  .withColumn("_PT", F.sum("_P").over(tot))
                  .withColumn("_NT", F.sum("_N").over(tot))
                  .drop("_P", "_N"))
    # per_b has at most groups * n_buckets rows
    j = rb.join(F.broadcast(per_b), [*by, "_b"])
    tp = F.col("_tp_in") + F.col("_tp_off")
    fp = F.col("_fp_in") + F.col("_fp_off")
    return j.select(
        *by,
        F.col(score).alias("threshold"),
        tp.alias("tp"),
        fp.alias("fp"),
        F.when(F.col("_PT") > 0, tp / F.col("_PT")).alias("tpr"),
        F.when(F.col("_NT") > 0, fp / F.col("_NT")).alias("fpr"),
    )


def youden_threshold(roc: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ME-5: threshold maximising ``tpr - fpr``; ties go to the highest threshold (first in descending order)."""
    by = list(by)
    j = F.col("tpr") - F.col("fpr")
    return roc.groupBy(*by).agg(
        F.max_by(F.col("threshold"), F.struct(j, F.col("threshold"))).alias("youden_threshold"),
        F.max(j).alias("youden_j"),
    )


def prevalence_threshold(df: DataFrame, score: str = "p", label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """ME-6: ``(*by, prevalence_threshold)``, the ``1 - positive rate`` quantile of the scores (linear interpolation, numpy
    default).

    The fraction is data dependent: it is a row per group; the quantile is
    read from the distinct-score position ranges (see ``exact_quantiles``).
    """
    by = list(by)
    stats = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.avg(F.col(label).cast("double")).alias("_rate"))
    x = stats.select(*by, ((F.lit(1.0) - F.col("_rate")) * (F.col("_n") - 1)).alias("_x"))
    pos = value_positions(df, score, by)
    lo = _value_at(pos, x.select(*by, "_x", F.floor("_x").cast("long").alias("_pos")), by).select(
        *by, "_x", F.col("_pos").alias("_plo"), F.col("_v").alias("_vlo"))
    hi = _value_at(pos, x.select(*by, F.ceil("_x").cast("long").alias("_pos")), by).select(*by, F.col("_v").alias("_vhi"))
    j = lo.join(hi, by) if by else lo.crossJoin(hi)  # one row per group
    return j.select(*by, (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * (F.col("_x") - F.col("_plo")))
                    .alias("prevalence_threshold"))


def value_positions(df: DataFrame, value: str, by: Sequence[str] = (), n_buckets: int | None = None,
                    weight: str | None = None) -> DataFrame:
    """``(*by, _v, _lo, _hi)``: each distinct value with the 0-based positions it occupies in the sorted
    multiset of its group. Rows are first folded to (value, count) with partial aggregation, so a value
    held by a third of the rows is one row; counts are prefix-summed in two levels (value-range buckets).
    A row stands for ``weight`` rows (default: itself)."""
    by = list(by)
    w = F.col(weight) if weight else F.lit(1)
    dist = df.select(*by, F.col(value).cast("double").alias("_v"), w.alias("_w")).where(F.col("_v").isNotNull()) \
        .groupBy(*by, "_v").agg(F.sum("_w").alias("_c"))
    nb = n_buckets or default_buckets(df)
    rb = range_bucketed(dist, [*by, "_v"], nb)
    within = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    rb = rb.withColumn("_in", F.coalesce(F.sum("_c").over(within), F.lit(0)))
    counts = rb.groupBy(*by, "_b").agg(F.sum("_c").alias("_bc"))
    w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_bc").over(w), F.lit(0))).drop("_bc")  # groups * buckets rows
    j = rb.join(F.broadcast(offs), [*by, "_b"])
    lo = F.col("_off") + F.col("_in")
    return j.select(*by, "_v", lo.alias("_lo"), (lo + F.col("_c") - 1).alias("_hi"))


def _value_at(positions: DataFrame, wanted: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join wanted ``(*by, key..., _pos)`` rows (a small table) to the value whose position range holds _pos."""
    w = wanted.select(*[F.col(c).alias(f"_w_{c}") for c in by], *[c for c in wanted.columns if c not in by])
    cond = (F.col("_pos") >= F.col("_lo")) & (F.col("_pos") <= F.col("_hi"))
    for c in by:
        cond = cond & (F.col(c) == F.col(f"_w_{c}"))
    return positions.join(F.broadcast(w), cond)  # wanted: groups * quantiles rows


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float], by: Sequence[str] = (),
                    names: Sequence[str] | None = None, weight: str | None = None) -> DataFrame:
    """Linear-interpolation quantiles (numpy default / ``quantile_cont``) without gathering a group's
    values in one task: distinct values with their position ranges, then the values at ``floor`` and
    ``ceil`` of ``q * (n - 1)``, interpolated. Returns ``(*by, <name>...)``. A row stands for ``weight`` rows."""
    by = list(by)
    names = list(names or [f"q{i}" for i in range(len(qs))])
    pos = value_positions(df, value, by, weight=weight)
    n = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.sum(F.col(weight) if weight else F.lit(1)).alias("_n"))
    want = n.select(*by, F.explode(F.array(*[F.struct(F.lit(i).alias("qi"), F.lit(float(q)).alias("q"))
                                             for i, q in enumerate(qs)])).alias("_e"), "_n") \
        .select(*by, "_e.qi", (F.col("_e.q") * (F.col("_n") - 1)).alias("_x"))
    lo = want.select(*by, "qi", "_x", F.floor("_x").cast("long").alias("_pos"))
    hi = want.select(*by, "qi", F.ceil("_x").cast("long").alias("_pos"))
    vlo = _value_at(pos, lo, by).select(*by, "qi", "_x", F.col("_pos").alias("_plo"), F.col("_v").alias("_vlo"))
    vhi = _value_at(pos, hi, by).select(*by, "qi", F.col("_v").alias("_vhi"))
    j = vlo.join(vhi, [*by, "qi"])
    val = F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * (F.col("_x") - F.col("_plo"))
    return j.groupBy(*by).agg(*[F.max(F.when(F.col("qi") == i, val)).alias(nm) for i, nm in enumerate(names)])


def final_threshold(youden: Column, prevalence: Column) -> Column:
    """ME-7: clip(.75*(.45*youden + .45*prevalence + .05) + .125, .2, .8)."""
    t = F.lit(0.75) * (F.lit(0.45) * youden + F.lit(0.45) * prevalence + F.lit(0.05)) + F.lit(0.125)
    return F.least(F.greatest(t, F.lit(0.2)), F.lit(0.8))


def accuracy(df: DataFrame, score: str = "p", label: str = "y", by: Sequence[str] = (), cut: float = 0.5) -> DataFrame:
    """A-12: accuracy of the arg-max label (``p > cut``)."""
    hit = ((F.col(score) > cut).cast("int") == F.col(label).cast("int")).cast("double")
    return df.groupBy(*by).agg(F.avg(hit).alias("accuracy"))


def softmax2(l0: Column, l1: Column) -> Column:
    """ML-6: probability of class 1 from two logits."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(l0 - l1))
