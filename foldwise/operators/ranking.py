"""Distributed ranking primitives.

Spark plans ``row_number() over (order by x)`` as one task holding every row
(``Exchange SinglePartition``). The operators here rank in two levels
instead: rows are split into many order-preserving buckets, each bucket is
ranked inside its own task, and only per-bucket counts (a table of bounded
size) are prefix-summed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hex_bucket
from ..session import materialize


def rank_by_hash(df: DataFrame, part_cols: Sequence[str], hash_col: str, tie_col: str,
                 out: str = "_rank", out_global: str | None = None) -> DataFrame:
    """0-based rank within ``part_cols`` ordered by ``(hash_col, tie_col)``; keeps every column.

    ``hash_col`` is an md5 hex string, so its first 3 hex digits give 4096
    uniform buckets whose order agrees with the full order. Rows are
    shuffled once by ``(part, bucket)``; the offsets table has at most
    ``|part| * 4096`` rows. ``out_global`` adds the rank over the
    concatenation of parts in ascending part order.
    """
    part_cols = list(part_cols)
    t = df.withColumn("_hb", hex_bucket(F.col(hash_col)))
    counts = t.groupBy(*part_cols, "_hb").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*part_cols).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if out_global:
        # bounded: |part| * 4096 rows in one task
        before_all = Window.orderBy(*part_cols, "_hb").rowsBetween(Window.unboundedPreceding, -1)
        offs = offs.withColumn("_off_all", F.coalesce(F.sum("_n").over(before_all), F.lit(0)))
    offs = offs.drop("_n")
    within = Window.partitionBy(*part_cols, "_hb").orderBy(hash_col, tie_col)
    t = t.withColumn("_rn", F.row_number().over(within) - 1)
    # offsets: at most |part| * 4096 rows (parts are classes / seeds), so the broadcast is bounded
    j = t.join(F.broadcast(offs), [*part_cols, "_hb"], "inner")
    j = j.withColumn(out, F.col("_off") + F.col("_rn"))
    if out_global:
        j = j.withColumn(out_global, F.col("_off_all") + F.col("_rn")).drop("_off_all")
    return j.drop("_hb", "_off", "_rn")


def range_bucketed(df: DataFrame, order_cols: Sequence[str | Column], n_buckets: int,
                   out: str = "_b", bounds: Sequence[float] | None = None) -> DataFrame:
    """Split rows into about ``n_buckets`` contiguous, balanced ranges of the last ``order_cols`` column.

    Bucket bounds are approximate quantiles of the value (a bounded list of
    ``n_buckets - 1`` numbers computed by one distributed pass), applied by
    binary search in the JVM (``Bucketizer``). The bucket is a pure
    function of the value, so it is identical in every branch of a plan and
    after any task retry; bucket order follows value order and equal values
    share a bucket. A skewed value distribution still gives balanced buckets.
    Leading ``order_cols`` (group keys) stay separate columns of the key.
    Given ``bounds`` replace the quantiles, and their pass over ``df``.
    """
    from pyspark.ml.feature import Bucketizer

    value = order_cols[-1]
    value = value if isinstance(value, str) else None
    if value is None:
        raise ValueError("the last order column must be a column name")
    probs = [i / n_buckets for i in range(1, n_buckets)]
    qs = bounds if bounds is not None else df.approxQuantile(value, probs, 1.0 / (4 * n_buckets)) if n_buckets > 1 else []
    inner = sorted({float(q) for q in qs if q == q and q not in (float("inf"), float("-inf"))})
    splits = [float("-inf"), *inner, float("inf")]
    tmp = "_bv"
    t = df.withColumn(tmp, F.col(value).cast("double"))
    b = Bucketizer(splits=splits, inputCol=tmp, outputCol=out, handleInvalid="keep").transform(t)
    return b.withColumn(out, F.col(out).cast("int")).drop(tmp)


def rank_by_range(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "_rank") -> DataFrame:
    """0-based rank within ``by`` in ascending order of the columns ``order`` (any orderable types); keeps every column.

    Rows are dealt to contiguous ranges of ``(by, order)``, written, and ranked inside their range; the counts before
    a range (``|by| * ranges`` rows) are prefix-summed and broadcast.
    """
    by = list(by)
    t = df.repartitionByRange(default_buckets(df), *by, *order).withColumn("_pid", F.spark_partition_id())
    t = materialize(t)
    w = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = t.groupBy(*by, "_pid").agg(F.count(F.lit(1)).alias("_c")) \
        .withColumn("_off", F.coalesce(F.sum("_c").over(w), F.lit(0))).drop("_c")
    within = Window.partitionBy(*by, "_pid").orderBy(*order)
    t = t.withColumn("_rn", F.row_number().over(within) - 1).join(F.broadcast(offs), [*by, "_pid"])
    return t.withColumn(out, F.col("_off") + F.col("_rn")).drop("_off", "_rn", "_pid")


def default_buckets(df: DataFrame, floor: int = 16) -> int:
    sp = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(sp, floor)
