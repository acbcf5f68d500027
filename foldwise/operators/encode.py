"""Target encoding (TE-1..TE-4; TE-5 and TE-6 are in ``nested_encode``), first-appearance codes (W-2), external encodings (TB-4).

Everything is computed in long form ``(column, key, ...)`` so that any
number of encoded columns costs one aggregate, not one job per column:
rows are unpivoted to ``(id, fold, y, column, key)`` and aggregated once by
``(column, key, fold)`` with map-side partial aggregation, which also
absorbs hot keys (a key holding a third of the rows becomes one partial
row per task).

Leave-fold-out statistics are *totals minus the fold's own part* (TE-3):
no fold is re-scanned. The automatic smoothing (TE-4) needs, for each
excluded fold, sums over all keys of the train part; keys absent from a
fold keep their full statistics, so these sums are the all-keys sums plus
corrections from the keys present in that fold.

Encoded values are attached per column by a broadcast join when that
column's mapping is small (checked count), and through one long join +
pivot by id otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import DEFAULT_BROADCAST_ROWS, materialize
from .ranking import rank_by_range



def key_expr(c: str) -> Column:
    """String key of a column value (null stays null: group-bys drop null keys)."""
    return F.col(c).cast("string")


def unpivot(df: DataFrame, cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``(keep..., column, key)``: one row per (row, column); no shuffle."""
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), key_expr(c).alias("key")) for c in cols]))
    return df.select(*keep, kv.alias("_kv")).select(*keep, "_kv.column", "_kv.key")


def _column_sizes(mapping: DataFrame) -> dict[str, int]:
    """Rows of a written ``(column, ...)`` mapping by column: one small row per column."""
    return {r["column"]: r["n"] for r in mapping.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}


def _look_up(long: DataFrame, mapping: DataFrame, on: Sequence[str], sizes: dict[str, int], bound: int) -> DataFrame:
    """Left join of unpivoted rows with a mapping, decided column by column: the columns that fit the bound together,
    smallest first, are broadcast; only the others are shuffled."""
    small, total = [], 0
    for c, n in sorted(sizes.items(), key=lambda x: (x[1], x[0])):
        if total + n > bound:
            break
        small.append(c)
        total += n
    if len(small) == len(sizes):
        return long.join(F.broadcast(mapping), list(on), "left")
    few = F.col("column").isin(small)
    return long.where(few).join(F.broadcast(mapping.where(few)), list(on), "left").unionByName(
        long.where(~few).join(mapping.where(~few), list(on), "left"))


# ---------------------------------------------------------------------------
# TE-1 / TE-2: fit on all rows, transform other rows (unsmoothed lookup)
# ---------------------------------------------------------------------------

_AGGS = {
    "mean": lambda y: F.avg(y),
    "count": lambda y: F.count(y).cast("double"),
    "sum": lambda y: F.sum(y).cast("double"),
    "std": lambda y: F.stddev_samp(y),
    "min": lambda y: F.min(y).cast("double"),
    "max": lambda y: F.max(y).cast("double"),
    "median": lambda y: F.median(y),
}


def te_fit(df: DataFrame, cols: Sequence[str], y: str, aggs: Sequence[str] = ("mean",)) -> tuple[DataFrame, DataFrame]:
    """TE-1: ``(mapping(column, key, <agg>...), globals(<agg>...))``; null keys dropped."""
    long = unpivot(df, cols, [y]).where(F.col("key").isNotNull())
    yc = F.col(y).cast("double")
    mapping = long.groupBy("column", "key").agg(*[_AGGS[a](yc).alias(a) for a in aggs])
    globals_ = df.agg(*[_AGGS[a](F.col(y).cast("double")).alias(a) for a in aggs])
    return mapping, globals_


def te_transform(df: DataFrame, mapping: DataFrame, globals_: DataFrame, cols: Sequence[str],
                 aggs: Sequence[str] = ("mean",), drop_original: bool = False, prefix: str = "TE_",
                 id_col: str = "id", max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """TE-2: ``TE_<col>_<agg>`` = mapping lookup, missing key -> the global statistic."""
    mapping = materialize(mapping)
    g = globals_.first()
    sizes = _column_sizes(mapping)
    small = sum(sizes.values()) <= max_broadcast_rows
    out = df
    if small and len(cols) <= MAX_PER_COLUMN_JOINS:
        for c in cols:
            m = mapping.where(F.col("column") == c).select(
                F.col("key").alias(f"_k_{c}"), *[F.col(a).alias(f"_v_{c}__{a}") for a in aggs])
            out = out.join(F.broadcast(m), key_expr(c) == F.col(f"_k_{c}"), "left")
    else:
        long = unpivot(df, cols, [id_col])
        looked = _look_up(long, mapping, ["column", "key"], sizes, max_broadcast_rows)
        for a in aggs:
            wide = looked.groupBy(id_col).pivot("column", list(cols)).agg(F.first(a))
            out = out.join(wide.select(id_col, *[F.col(f"`{c}`").alias(f"_v_{c}__{a}") for c in cols]), id_col, "left")
    enc_cols = [F.coalesce(F.col(f"_v_{c}__{a}"), F.lit(g[a])).alias(f"{prefix}{c}_{a}") for c in cols for a in aggs]
    keep = [c for c in df.columns if not (drop_original and c in cols)]
    return out.select(*keep, *enc_cols)


# ---------------------------------------------------------------------------
# TE-3 / TE-4: leave-fold-out, smoothed, automatic smoothing
# ---------------------------------------------------------------------------

def _var(n: Column, s: Column, ss: Column) -> Column:
    """Sample variance from count, sum, sum of squares (null when n <= 1)."""
    return F.when(n > 1, (ss - s * s / n) / (n - 1))


def oof_mapping(df: DataFrame, cols: Sequence[str], y: str, fold: str,
                smooth: str | float = "auto") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leave-fold-out encodings in long form.

    Returns ``(enc(column, key, fold, te), fold_globals(fold, g), key_stats)`` where
    ``te`` is the smoothed train-part mean of ``key`` for rows of ``fold``
    (null when the key is absent from the train part or smoothing is
    undefined) and ``g`` the train-part mean of ``y``.
    """
    yc = F.col(y).cast("double")
    long = unpivot(df.withColumn("_y", yc), cols, [fold, "_y"]).where(F.col("key").isNotNull())
    kf = long.groupBy("column", "key", fold).agg(
        F.count(F.lit(1)).alias("n_f"), F.sum("_y").alias("s_f"), F.sum(F.col("_y") * F.col("_y")).alias("ss_f"))
    # fold totals: at most k rows
    fg = df.groupBy(fold).agg(F.count(F.lit(1)).alias("fn"), F.sum(yc).alias("fs"))
    tw = Window.partitionBy()
    fg = fg.select(fold, ((F.sum("fs").over(tw) - F.col("fs")) / (F.sum("fn").over(tw) - F.col("fn"))).alias("g"))
    fg = materialize(fg)

    key_w = Window.partitionBy("column", "key")
    kw = (kf.withColumn("N", F.sum("n_f").over(key_w)).withColumn("S", F.sum("s_f").over(key_w))
            .withColumn("SS", F.sum("ss_f").over(key_w))
            .withColumn("_first", F.col(fold) == F.min(fold).over(key_w)))
    n1, s1, ss1 = F.col("N") - F.col("n_f"), F.col("S") - F.col("s_f"), F.col("SS") - F.col("ss_f")
    kw = kw.select("column", "key", fold, "N", "S", "SS", "_first",
                   n1.alias("n1"), s1.alias("s1"), ss1.alias("ss1"))
    kw = materialize(kw)  # read by three aggregates and the final projection

    full_var = _var(F.col("N"), F.col("S"), F.col("SS"))
    full_mu = F.col("S") / F.col("N")
    part_var = _var(F.col("n1"), F.col("s1"), F.col("ss1"))
    part_mu = F.when(F.col("n1") > 0, F.col("s1") / F.col("n1"))

    if smooth == "auto":
        # all-keys sums per column (one row per column)
        base = kw.where("_first").groupBy("column").agg(
            F.sum(full_var).alias("K1"), F.count(full_var).alias("C1"),
            F.count(F.lit(1)).alias("M0"), F.sum(full_mu).alias("M1"), F.sum(full_mu * full_mu).alias("M2"))
        # corrections from keys present in each fold (one row per column and fold)
        dz = lambda c: F.coalesce(c, F.lit(0.0))
        corr = kw.groupBy("column", fold).agg(
            F.sum(dz(part_var) - dz(full_var)).alias("dK1"),
            F.sum(F.when(part_var.isNotNull(), 1).otherwise(0) - F.when(full_var.isNotNull(), 1).otherwise(0)).alias("dC1"),
            F.sum(F.when(F.col("n1") > 0, 0).otherwise(-1)).alias("dM0"),
            F.sum(dz(part_mu) - full_mu).alias("dM1"),
            F.sum(dz(part_mu * part_mu) - full_mu * full_mu).alias("dM2"))
        grid = base.crossJoin(F.broadcast(fg.select(fold)))  # columns * k rows
        st = grid.join(corr, ["column", fold], "left").na.fill(0, ["dK1", "dC1", "dM0", "dM1", "dM2"])
        k1, c1 = F.col("K1") + F.col("dK1"), F.col("C1") + F.col("dC1")
        m0, m1, m2 = F.col("M0") + F.col("dM0"), F.col("M1") + F.col("dM1"), F.col("M2") + F.col("dM2")
        vw = F.when(c1 > 0, k1 / c1)
        vb = F.when(m0 > 1, (m2 - m1 * m1 / m0) / (m0 - 1))
        m = F.when(vb > 0, vw / F.greatest(vb, F.lit(1e-9))).otherwise(F.lit(0.0))
        ms = st.select("column", fold, m.alias("m"))
    else:
        ms = kw.select("column").distinct().crossJoin(F.broadcast(fg.select(fold))).withColumn("m", F.lit(float(smooth)))
    ms = ms.join(F.broadcast(fg), fold)  # columns * k rows
    te = F.when(F.col("n1") > 0, (F.col("s1") + F.col("m") * F.col("g")) / (F.col("n1") + F.col("m")))
    enc = kw.join(F.broadcast(ms), ["column", fold]).select("column", "key", fold, te.alias("te"))
    return enc, fg, kw


# Up to this many encoded columns are attached by one broadcast join each
# (no shuffle); beyond it the plan of chained joins grows too large and the
# long form (unpivot -> one join -> pivot by id -> join back) is used.
MAX_PER_COLUMN_JOINS = 12


def _attach_long(df: DataFrame, long_vals: DataFrame, cols: Sequence[str], id_col: str, value: str) -> DataFrame:
    """Pivot ``(id, column, value)`` to one column per encoded column (``_v_<c>``) and join it to ``df`` by id.

    ``id_col`` must be unique in ``df``.
    """
    wide = long_vals.groupBy(id_col).pivot("column", list(cols)).agg(F.first(value))
    wide = wide.select(id_col, *[F.col(f"`{c}`").alias(f"_v_{c}") for c in cols])
    return df.join(wide, id_col, "left")


def target_encode_oof(df: DataFrame, cols: Sequence[str], y: str, fold: str, id_col: str = "id",
                      smooth: str | float = "auto", prefix: str = "TE_", suffix: str = "_mean",
                      drop_original: bool = False, max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """TE-3: add ``TE_<col>_mean`` = leave-fold-out smoothed mean; missing -> that fold's global mean."""
    df = materialize(df)  # read by the unpivot, the fold totals and the final join
    enc, fg, kw = oof_mapping(df, cols, y, fold, smooth)
    sizes = _column_sizes(kw)  # one row per (column, key, fold) present; kw is already materialised
    small = sum(sizes.values()) <= max_broadcast_rows
    out = df.join(F.broadcast(fg.withColumnRenamed("g", "_g")), fold, "left")  # k rows
    if small and len(cols) <= MAX_PER_COLUMN_JOINS:
        for c in cols:
            m = enc.where(F.col("column") == c).select(F.col("key").alias(f"_k_{c}"), F.col(fold).alias(f"_f_{c}"),
                                                       F.col("te").alias(f"_v_{c}"))
            out = out.join(F.broadcast(m), (key_expr(c) == F.col(f"_k_{c}")) & (F.col(fold) == F.col(f"_f_{c}")), "left")
    else:
        long = unpivot(df, cols, [id_col, fold])
        looked = _look_up(long, enc, ["column", "key", fold], sizes, max_broadcast_rows)
        out = _attach_long(out, looked, cols, id_col, "te")
    enc_cols = [F.coalesce(F.col(f"_v_{c}"), F.col("_g")).alias(f"{prefix}{c}{suffix}") for c in cols]
    keep = [c for c in df.columns if not (drop_original and c in cols)]
    return out.select(*keep, *enc_cols)


# ---------------------------------------------------------------------------
# W-2: first-appearance integer codes (pandas factorize), null -> -1
# ---------------------------------------------------------------------------

def factorize(df: DataFrame, cols: Sequence[str], order_cols: Sequence[str], suffix: str = "",
              max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Codes in order of first appearance under ``order_cols`` (e.g. split rank, id).

    One aggregate over all columns: the smallest order key (a struct, so
    order columns may be of any orderable type and size) per (column,
    value), then the rank of the values by it within their column, in
    ranges (no task holds a column's values). Codes are joined back by
    broadcast when a column's value table is under the bound, else by a
    shuffle join.
    """
    long = df.select(F.struct(*order_cols).alias("_o"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), key_expr(c).alias("key")) for c in cols])).alias("_kv")
    ).select("_o", "_kv.column", "_kv.key").where(F.col("key").isNotNull())
    first = long.groupBy("column", "key").agg(F.min("_o").alias("_o"))
    # rows may tie in the order columns: the value then decides
    codes = materialize(rank_by_range(first, ["column"], ["_o", "key"], out="code").drop("_o"))
    sizes = {r["column"]: r["n"] for r in codes.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = df
    for c in cols:
        m = codes.where(F.col("column") == c).select(F.col("key").alias(f"_k_{c}"), F.col("code").alias(f"_c_{c}"))
        if sizes.get(c, 0) <= max_broadcast_rows:
            m = F.broadcast(m)
        out = out.join(m, key_expr(c) == F.col(f"_k_{c}"), "left")
    names = {f"{c}{suffix}" for c in cols}
    keep = [c for c in df.columns if c not in names]  # suffix '' replaces the original columns
    return out.select(*keep, *[F.coalesce(F.col(f"_c_{c}"), F.lit(-1)).cast("int").alias(f"{c}{suffix}")
                               for c in cols])
