"""Fold assignment (FO-1..FO-5).

Folds are a column, never index lists: train = ``fold <> k``,
validation = ``fold = k`` (P-13). Randomness comes from ``md5(seed|id)``,
so an assignment is repeatable whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import md5_key
from ..session import DEFAULT_BROADCAST_ROWS, materialize
from .ranking import rank_by_hash, rank_by_range

def kfold(df: DataFrame, k: int, seed: int = 42, id_col: str = "id", out: str = "fold") -> DataFrame:
    """FO-1: shuffled k-fold. Rows ranked by ``md5(seed|id)``; fold = rank mod k (sizes differ by <= 1)."""
    t = df.withColumn("_h", md5_key(F.lit(seed), id_col))
    t = rank_by_hash(t, [], "_h", id_col, out="_r")
    return t.withColumn(out, (F.col("_r") % k).cast("int")).drop("_h", "_r")


def stratified_kfold(df: DataFrame, k: int, label_col: str, seed: int = 42, id_col: str = "id",
                     out: str = "fold") -> DataFrame:
    """FO-2: stratified shuffled k-fold.

    Within each label rows are ordered by ``md5(seed|id)``; the classes are
    laid end to end in label order and dealt round-robin, so every class is
    spread over the folds with counts differing by at most one and fold
    sizes differ by at most one.
    """
    t = df.withColumn("_h", md5_key(F.lit(seed), id_col))
    t = rank_by_hash(t, [label_col], "_h", id_col, out="_r", out_global="_g")
    return t.withColumn(out, (F.col("_g") % k).cast("int")).drop("_h", "_r", "_g")


def repeated_stratified_kfold(df: DataFrame, k: int, label_col: str, seeds: Sequence[int], id_col: str = "id",
                              out: str = "fold", seed_col: str = "seed") -> DataFrame:
    """FO-4: one stratified fold assignment per seed, long form ``(.., seed, fold)``.

    The seed is part of the hashed string and of the partition key, so all
    seeds are ranked in one pass.
    """
    seeds_arr = F.array(*[F.lit(int(s)) for s in seeds])
    t = df.withColumn(seed_col, F.explode(seeds_arr))
    t = t.withColumn("_h", md5_key(F.col(seed_col), id_col))
    t = rank_by_hash(t, [seed_col, label_col], "_h", id_col, out="_r")
    # per seed: offset of each label = rows of smaller labels under the same seed
    w = Window.partitionBy(seed_col).orderBy(label_col).rowsBetween(Window.unboundedPreceding, -1)
    sizes = (t.groupBy(seed_col, label_col).agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_lo", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n"))
    t = t.join(F.broadcast(sizes), [seed_col, label_col])  # |seeds| * |labels| rows
    return t.withColumn(out, ((F.col("_r") + F.col("_lo")) % k).cast("int")).drop("_h", "_r", "_lo")


def group_kfold(df: DataFrame, k: int, group_col: str, label_col: str | None = None, seed: int = 42,
                out: str = "fold") -> DataFrame:
    """FO-3: stratified group k-fold by a snake deal over groups.

    Groups (with row and positive counts) are ordered by their majority
    label (positive groups first), then size descending, ties by
    ``md5(seed|group)``, and dealt in snake order: position ``i`` goes to
    fold ``i % k`` in even blocks ``i // k`` and ``k-1-i % k`` in odd ones.
    A group never spans folds; groups of each label, large ones first, are
    spread over all folds, so sizes and label shares come out near equal.
    Only the group table is ranked (one row per group), in ranges; rows get
    their fold by a join on the group.
    """
    pos = F.sum(F.col(label_col).cast("long")) if label_col else F.lit(0).cast("long")
    groups = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("_n"), pos.alias("_pos"))
    groups = groups.select(group_col, (-(F.col("_pos") * 2 >= F.col("_n")).cast("int")).alias("_minor"),
                           (-F.col("_n")).alias("_size"), md5_key(F.lit(seed), group_col).alias("_h"))
    ranked = rank_by_range(groups, [], ["_minor", "_size", "_h", group_col], out="_i")
    block = F.floor(F.col("_i") / k)
    at = F.col("_i") % k
    fold = F.when(block % 2 == 0, at).otherwise(F.lit(k - 1) - at).cast("int")
    mapping = materialize(ranked.select(group_col, fold.alias(out)))
    if mapping.count() <= DEFAULT_BROADCAST_ROWS:
        mapping = F.broadcast(mapping)
    return df.join(mapping, group_col, "left")


def kfold_sql(source: str, k: int, seed: int = 42, label: str | None = None, id_col: str = "id",
              out: str = "fold") -> str:
    """DuckDB oracle text for FO-1 / FO-2 over a relation ``source``."""
    order = f"{label}, _h, {id_col}" if label else f"_h, {id_col}"
    return (f"select * exclude (_h), cast((row_number() over (order by {order}) - 1) % {k} as bigint) {out} "
            f"from (select *, md5(concat('{seed}', '|', cast({id_col} as varchar))) _h from ({source}) s0) s1")
