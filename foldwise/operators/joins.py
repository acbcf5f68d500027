"""Join helpers (J-1..J-6).

``lookup_join`` is the one place that decides broadcast: the small side is
written, counted, and broadcast only when the count is under a bound;
beyond it the join is a plain shuffle join (AQE may still split skew).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import DEFAULT_BROADCAST_ROWS, materialize


def checked_broadcast(small: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Return ``(small', is_broadcast)``: ``small`` hinted for broadcast iff it has <= ``max_rows`` rows."""
    small = materialize(small)
    n = small.count()
    if n <= max_rows:
        return F.broadcast(small), True
    return small, False


def lookup_join(big: DataFrame, small: DataFrame, on: str | Sequence[str] | Column, how: str = "left",
                max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """J-1/J-2/J-3: join a mapping onto rows, broadcasting it only behind a size check."""
    small2, _ = checked_broadcast(small, max_rows)
    return big.join(small2, on, how)
