"""TE-3 with every aggregate: leave-fold-out count, sum, mean, std, min, max and median of a target by key.

One aggregate by ``(column, key, fold)``; what a fold leaves out is taken together per key from at most ``k`` summaries, so extremes
come from the best of the other folds and no fold is read again. The median has no such summary: distinct values are counted
by fold, the counts of the others are added up, and positions decide, in ranges, so a hot key's values never meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .encode import key_expr
from .metrics import exact_quantiles
from .rowlookup import HEAD_BYTES, look_up

AGGS = ("count", "sum", "mean", "std", "min", "max", "median")


def _others(k: int, median: Column | None) -> dict[str, Column]:
    """The aggregates of all summaries but fold ``k``'s; null without a value (std: without two)."""
    rest = F.filter("cells", lambda c: c["fold"] != k)
    add = lambda f: F.aggregate(rest, F.lit(0.0), lambda a, c: a + c[f])
    n, s, ss = add("n"), add("s"), add("ss")
    return {"count": F.when(n > 0, n), "sum": F.when(n > 0, s), "mean": F.when(n > 0, s / n),
            "std": F.when(n > 1, F.sqrt(F.greatest((ss - s * s / n) / (n - 1), F.lit(0.0)))),
            "min": F.array_min(F.transform(rest, lambda c: c["mn"])), "max": F.array_max(F.transform(rest, lambda c: c["mx"])),
            "median": median}


def oof_aggregates(df: DataFrame, cols: Sequence[str], y: str, fold: str, n_folds: int, aggs: Sequence[str] = AGGS) -> DataFrame:
    """``(column, key, freq, vals)``: ``vals[k * len(aggs) + j]`` is aggregate ``j`` of the rows outside fold ``k``, folds ``0..n_folds-1``.

    ``column`` is a place in ``cols``; ``len(cols)`` with the key '' stands for all rows. Null keys are left out.
    """
    keys = F.array(*[key_expr(c) for c in cols], F.lit(""))
    long = df.select(F.col(fold).alias("fold"), F.col(y).cast("double").alias("y"), F.posexplode(keys).alias("column", "key")).where(F.col("key").isNotNull())
    zero = F.lit(0.0)
    by_fold = long.groupBy("column", "key", "fold").agg(
        F.count(F.lit(1)).alias("c"), F.count("y").cast("double").alias("n"), F.coalesce(F.sum("y"), zero).alias("s"),
        F.coalesce(F.sum(F.col("y") * F.col("y")), zero).alias("ss"), F.min("y").alias("mn"), F.max("y").alias("mx"))
    t = by_fold.groupBy("column", "key").agg(F.sum("c").alias("freq"), F.collect_list(F.struct("fold", "n", "s", "ss", "mn", "mx")).alias("cells"))
    if "median" in aggs:
        every = F.filter(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda k: k != F.col("fold"))
        counts = long.where(F.col("y").isNotNull()).groupBy("column", "key", "fold", "y").agg(F.count(F.lit(1)).alias("c")) \
            .withColumn("k", F.explode(every)).groupBy("column", "key", "k", "y").agg(F.sum("c").alias("c"))
        med = exact_quantiles(materialize(counts), "y", [0.5], ["column", "key", "k"], ["median"], weight="c")
        med = med.groupBy("column", "key").agg(*[F.max(F.when(F.col("k") == k, F.col("median"))).alias(f"_m{k}") for k in range(n_folds)])
        t = t.join(med, ["column", "key"], "left")
    vals = [_others(k, F.col(f"_m{k}") if "median" in aggs else None)[a] for k in range(n_folds) for a in aggs]
    return materialize(t.select("column", "key", "freq", F.array(*vals).alias("vals")))


def target_encode_aggs(df: DataFrame, cols: Sequence[str], y: str, fold: str, n_folds: int, aggs: Sequence[str] = AGGS, id_col: str = "id",
                       prefix: str = "TE_", max_bytes: int = HEAD_BYTES) -> DataFrame:
    """TE-3: ``df`` and ``TE_<col>_<agg>`` of the rows outside each row's fold; a null or unseen key, or an undefined value, gets the
    aggregate of all those rows. ``df`` is read twice."""
    table = oof_aggregates(df, cols, y, fold, n_folds, aggs)
    whole = table.where(F.col("column") == len(cols)).select("vals").first()
    default = [None if v is None else float(v) for v in whole["vals"]] if whole else [None] * (n_folds * len(aggs))
    picks = F.array(*[(F.col(fold) * len(aggs) + j).cast("int") for j in range(len(aggs))])
    found = look_up(df, [key_expr(c) for c in cols], table.where(F.col("column") < len(cols)), n_folds * len(aggs), "freq", id_col,
                    picks, len(aggs), max_bytes=max_bytes)
    defaults = F.array(*[F.lit(v).cast("double") for v in default])

    def value(place: int, j: int) -> Column:
        v = F.col("_found")[place * len(aggs) + j]
        return F.when(F.isnan(v), F.element_at(defaults, (F.col(fold) * len(aggs) + j + 1).cast("int"))).otherwise(v)

    return found.select(*df.columns, *[value(p, j).alias(f"{prefix}{c}_{a}") for p, c in enumerate(cols) for j, a in enumerate(aggs)])
