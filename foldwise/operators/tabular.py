"""Tabular feature operators (TB-1..TB-6, TE-5, P-7).

All are projections (no shuffle) except the external encodings, which are
one aggregate over the external rows for all columns at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .encode import key_expr
from .rowlookup import HEAD_BYTES, look_up

# Digit columns (multiplier, width) and rounding levels of the reference.
DIGIT_SPEC = {"debt_to_income_ratio": (1000, 3), "credit_score": (None, 3), "interest_rate": (100, 4)}
ROUND_LEVELS = {"1s": 0, "10s": -1, "100s": -2, "1000s": -3}
ROUND_COLS = ["annual_income", "loan_amount"]
CREDIT_BINS = [0, 580, 640, 700, 760, 900]
CREDIT_LABELS = ["very_low", "low", "fair", "good", "excellent"]


def digit_columns(spec: Mapping[str, tuple[int | None, int]] = DIGIT_SPEC) -> list[str]:
    return [f"{c}_DIGIT_{i + 1}" for c, (_, w) in spec.items() for i in range(w)]


def digits(df: DataFrame, spec: Mapping[str, tuple[int | None, int]] = DIGIT_SPEC) -> DataFrame:
    """TB-1: round(col * mult) half-even, zero-pad to the width, one int column per digit.

    A longer number keeps its leading digits (``lpad`` truncates from the right).
    """
    cols = []
    for c, (mult, width) in spec.items():
        v = F.col(c) if mult is None else F.bround(F.col(c) * F.lit(mult), 0)
        s = F.lpad(v.cast("long").cast("string"), width, "0")
        cols += [F.substring(s, i + 1, 1).cast("int").alias(f"{c}_DIGIT_{i + 1}") for i in range(width)]
    return df.select("*", *cols)


def round_columns(cols: Sequence[str] = ROUND_COLS, levels: Mapping[str, int] = ROUND_LEVELS) -> list[str]:
    return [f"{c}_ROUND_{s}" for c in cols for s in levels]


def rounding(df: DataFrame, cols: Sequence[str] = ROUND_COLS, levels: Mapping[str, int] = ROUND_LEVELS) -> DataFrame:
    """TB-2: ``bround(x, level)`` (half-even, as the reference's numpy rounding) cast to integer."""
    return df.select("*", *[F.bround(F.col(c), lvl).cast("long").alias(f"{c}_ROUND_{s}")
                            for c in cols for s, lvl in levels.items()])


def interaction_columns(base: Sequence[str]) -> list[str]:
    return [f"{a}_{b}" for a, b in combinations(base, 2)]


def interactions(df: DataFrame, base: Sequence[str]) -> DataFrame:
    """TB-3: every pair of ``base`` as the string ``a_b`` (null -> 'nan', as the reference's str cast)."""
    def s(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("nan"))
    return df.select("*", *[F.concat(s(a), F.lit("_"), s(b)).alias(f"{a}_{b}") for a, b in combinations(base, 2)])


def external_encodings(df: DataFrame, external: DataFrame, cols: Sequence[str], y: str, id_col: str = "id",
                       max_bytes: int = HEAD_BYTES) -> DataFrame:
    """TB-4 / J-1 / J-2 / P-7: ``orig_mean_<c>`` and ``orig_count_<c>`` from an external table.

    One aggregate over the external rows for every column (long form), then
    one lookup of all columns in the row (``rowlookup``). Missing keys get
    the external global target mean in **both** columns (the reference fills
    the count columns with the mean too).
    """
    ext = external.select(F.col(y).cast("double").alias("_y"), F.posexplode(F.array(*[key_expr(c) for c in cols])).alias("column", "key"))
    stats = materialize(ext.groupBy("column", "key").agg(F.sum("_y").alias("s"), F.count("_y").alias("m"), F.count(F.lit(1)).alias("n")))
    # every row has the first column's key or null, so its rows are the table's
    g = stats.where("column = 0").agg((F.sum("s") / F.sum("m")).alias("g")).first()["g"]
    mapping = stats.where(F.col("key").isNotNull()).select("column", "key", "n", F.array(F.col("s") / F.col("m"), F.col("n").cast("double")).alias("vals"))
    out = look_up(df, [key_expr(c) for c in cols], mapping, 2, "n", id_col, out="_orig", max_bytes=max_bytes)
    value = lambda k: F.when(F.isnan(F.col("_orig")[k]), F.lit(g)).otherwise(F.col("_orig")[k])
    return out.select(*df.columns, *[value(2 * k + j).alias(f"orig_{n}_{c}") for k, c in enumerate(cols) for j, n in enumerate(("mean", "count"))])


def ratio_features(df: DataFrame) -> DataFrame:
    """TB-5: loan_to_income, log1p of income and amount, dti x interest."""
    return df.select(
        "*",
        (F.col("loan_amount") / (F.col("annual_income") + F.lit(1.0))).alias("loan_to_income"),
        F.log1p("annual_income").alias("log_annual_income"),
        F.log1p("loan_amount").alias("log_loan_amount"),
        (F.col("debt_to_income_ratio") * F.col("interest_rate")).alias("dti_x_interest"),
    )


def band(col: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """TB-6: right-closed bands, lowest edge included, outside (or null) -> null."""
    expr = None
    for i, lab in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        cond = (col >= lo) & (col <= hi) if i == 0 else (col > lo) & (col <= hi)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def credit_band(df: DataFrame) -> DataFrame:
    return df.withColumn("credit_score_band", band(F.col("credit_score"), CREDIT_BINS, CREDIT_LABELS))
