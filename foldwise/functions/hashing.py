"""Deterministic hash helpers shared by folds, search draws and permutations.

All randomness in the engine comes from ``md5`` of a string, so results are
repeatable across partitionings and agree with the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKET_HEX = 3  # first 3 hex digits -> 4096 uniform buckets


def md5_key(*parts: Column | str) -> Column:
    """md5 hex of ``'p1|p2|...'`` (all parts cast to string)."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def hex_bucket(h: Column, digits: int = BUCKET_HEX) -> Column:
    """Integer value of the first ``digits`` hex digits (uniform bucket, order preserving)."""
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("int")


def unit_uniform(h: Column) -> Column:
    """A number in [0, 1) from the first 8 hex digits of an md5."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def unit_uniform_sql(md5_expr: str) -> str:
    """DuckDB text of ``unit_uniform`` for the oracle."""
    return f"(cast(('0x'||substr({md5_expr},1,8))::BIGINT as double) / 4294967296e0)"
