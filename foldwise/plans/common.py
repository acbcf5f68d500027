"""Output conventions shared by all registered queries.

Integers leave as ``bigint`` and floating values as ``double`` rounded to 6
decimals (sums of doubles depend on order; the oracle rounds the same way).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, ShortType

DIGITS = 6


def finish(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (IntegerType, ShortType, ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.round(c.cast("double"), digits)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def r6(expr: str) -> str:
    """DuckDB: round a double expression like ``finish`` does."""
    return f"round(cast({expr} as double), {DIGITS})"


def pvar(arr: str) -> str:
    """DuckDB: population variance of an integer list, exact as in ``functions.text.with_pop_var``."""
    n, t, q = f"len({arr})", f"list_sum({arr})", f"list_sum(list_transform({arr}, lambda q: q * q))"
    return f"(cast({n} * {q} - {t} * {t} as double) / cast({n} * {n} as double))"
