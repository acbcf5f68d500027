"""Applying fitted encodings to a stream (J-3 / TE-2 on Structured Streaming).

The reference has no streaming; this module only lets the batch-fitted
lookups of TE-2 run unchanged on a streaming DataFrame: each encoded column
is a stream-static left join against the (size-checked, broadcast) mapping,
then a ``coalesce`` with the global statistic. No state is kept, so any
output mode and trigger work, and a lost executor simply replays its
micro-batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.encode import MAX_PER_COLUMN_JOINS, te_transform


def encode_stream(stream: DataFrame, mapping: DataFrame, globals_: DataFrame, cols: Sequence[str],
                  aggs: Sequence[str] = ("mean",), prefix: str = "TE_") -> DataFrame:
    """TE-2 lookups on a streaming DataFrame (per-column stream-static joins)."""
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame; use operators.encode.te_transform for batch")
    if len(cols) > MAX_PER_COLUMN_JOINS:
        raise ValueError(f"at most {MAX_PER_COLUMN_JOINS} columns per stream (the long form needs a stateful pivot)")
    return te_transform(stream, mapping, globals_, cols, aggs, prefix=prefix)
