"""PP-5: isotonic regression pooled in ranges of the score.

Rows fold to distinct scores with sums and weights, which are dealt to contiguous ranges. A task pools its range's adjacent
violators with a stack of blocks; neighbouring ranges are then merged by the same stack over their *blocks*, a few ranges at a
time, until no block is above the one that follows it. Rows never meet in one task, and the driver sees one row per range.

The fitted function is constant on a block, linear between blocks and constant outside them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ranking import default_buckets

MERGED_RANGES = 8
KNOT_BYTES = 64 << 20  # of a broadcast function

_BLOCKS = "r long, lo double, hi double, s double, w double"
_NAMES = ["r", "lo", "hi", "s", "w"]


def pool(lo: np.ndarray, hi: np.ndarray, s: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks of rising means from blocks in ascending order: a block takes in the one before it while that is not below it."""
    stack: list[list[float]] = []
    for a, b, x, n in zip(lo.tolist(), hi.tolist(), s.tolist(), w.tolist()):
        while stack and stack[-1][2] * n >= x * stack[-1][3]:
            a0, _, x0, n0 = stack.pop()
            a, x, n = a0, x0 + x, n0 + n
        stack.append([a, b, x, n])
    return tuple(np.array(c, float) for c in zip(*stack)) if stack else (np.zeros(0),) * 4


def _pooled(blocks: DataFrame) -> DataFrame:
    def work(t: pa.Table) -> pa.Table:
        t = t.sort_by("lo")
        out = pool(*[t.column(c).to_numpy() for c in _NAMES[1:]])
        return pa.table([pa.array(np.full(len(out[0]), t.column("r")[0].as_py()), pa.int64()), *map(pa.array, out)], names=_NAMES)

    return materialize(blocks.groupBy("r").applyInArrow(work, _BLOCKS))


def _violated(blocks: DataFrame) -> bool:
    """Whether a range ends above the start of the next: one row per range."""
    mean = F.col("s") / F.col("w")
    ends = blocks.groupBy("r").agg(F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last")).orderBy("r").collect()
    return any(a["last"] >= b["first"] for a, b in zip(ends, ends[1:]))


def fit(rows: DataFrame, p_col: str = "p", y_col: str = "y", weight_col: str | None = None, ranges: int | None = None) -> DataFrame:
    """``(r, lo, hi, s, w)``: the blocks of the isotonic fit of ``y`` on ``p``; the value of a block is ``s / w``.

    Rows with a null or NaN score or a null ``y``, and those without positive weight, take no part.
    """
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    t = rows.select(F.col(p_col).cast("double").alias("p"), F.col(y_col).cast("double").alias("y"), w.alias("w")) \
        .where(F.col("y").isNotNull() & ~F.isnan("p") & (F.col("w") > 0))
    cells = materialize(t.groupBy("p").agg(F.sum(F.col("y") * F.col("w")).alias("s"), F.sum("w").alias("w")))
    dealt = cells.repartitionByRange(ranges or default_buckets(rows), "p")
    blocks = _pooled(materialize(dealt.select(F.spark_partition_id().cast("long").alias("r"), F.col("p").alias("lo"),
                                              F.col("p").alias("hi"), "s", "w")))
    while _violated(blocks):
        # the last round, if it comes to that, has one group of blocks
        blocks = _pooled(blocks.withColumn("r", F.floor(F.col("r") / MERGED_RANGES).cast("long")))
    return blocks


def _values(p: np.ndarray, lo, hi, value) -> np.ndarray:
    if not len(lo):
        return np.full(len(p), np.nan)
    x, y = np.column_stack([lo, hi]).reshape(-1), np.repeat(value, 2)
    keep = np.concatenate([[True], x[1:] > x[:-1]])  # a block of one score is one knot
    return np.interp(p, x[keep], y[keep])


def transform(target: DataFrame, blocks: DataFrame, p_col: str = "p", out: str = "p_iso", max_bytes: int = KNOT_BYTES) -> DataFrame:
    """Adds ``out``, the fitted value at ``p_col`` (null for a null or NaN score, or without any block).

    Up to ``max_bytes`` the blocks are broadcast and rows stay where they are. Beyond, distinct scores meet the blocks of their
    range, with one block on either side, and their values come back by score.
    """
    value: Column = F.col("s") / F.col("w")
    if blocks.count() * 24 <= max_bytes:
        b = blocks.select("lo", "hi", value.alias("v")).toPandas().sort_values("lo")
        held = target.sparkSession.sparkContext.broadcast(tuple(b[c].to_numpy() for c in ("lo", "hi", "v")))

        @F.pandas_udf("double")
        def at(p):
            import pandas as pd

            return pd.Series(_values(p.to_numpy(dtype=float), *held.value)).where(p.notna())
        return target.withColumn(out, F.nanvl(at(F.col(p_col).cast("double")), F.lit(None)))

    spark = target.sparkSession
    ends = blocks.groupBy("r").agg(F.min("lo").alias("lo")).orderBy("r").collect()  # one row per range
    numbers = [r["r"] for r in ends]
    wanted = target.select(F.col(p_col).cast("double").alias("p")).where(F.col("p").isNotNull() & ~F.isnan("p")).distinct()
    if len(numbers) > 1:
        splits = [float("-inf"), *[r["lo"] for r in ends[1:]], float("inf")]
        wanted = Bucketizer(splits=splits, inputCol="p", outputCol="_b").transform(wanted).select(
            "p", F.element_at(F.array(*[F.lit(k) for k in numbers]), F.col("_b").cast("int") + 1).alias("r"))
    else:
        wanted = wanted.withColumn("r", F.lit(numbers[0]))
    # the neighbours' edge blocks, one row per range and side
    edge = blocks.select("r", F.struct("lo", "hi", value.alias("v")).alias("b")).groupBy("r").agg(F.min("b").alias("first"), F.max("b").alias("last")).collect()
    edge = {r["r"]: r for r in edge}
    beside = [(numbers[k], *edge[numbers[j]][side]) for k in range(len(numbers)) for j, side in ((k - 1, "last"), (k + 1, "first"))
              if 0 <= j < len(numbers)]
    around = blocks.select("r", "lo", "hi", value.alias("v"))
    if beside:
        around = around.unionByName(spark.createDataFrame(beside, "r long, lo double, hi double, v double"))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("lo")
        p = left.column("p").to_numpy()
        return pa.table({"p": pa.array(p), "v": pa.array(_values(p, *[right.column(c).to_numpy() for c in ("lo", "hi", "v")]))})

    got = wanted.groupBy("r").cogroup(around.groupBy("r")).applyInArrow(work, "p double, v double")
    return target.join(got.select(F.col("p").alias("_p"), F.col("v").alias(out)), F.col(p_col).cast("double") == F.col("_p"), "left").drop("_p")
