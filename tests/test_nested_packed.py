"""Nested encodings by packed exchanges: rows beyond every bound are not joined, many small blocks and ranges give the same values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import nested_encode as N

COLS = ["a", "b"]


def _df(spark):
    t = spark.range(400).select(F.when(F.col("id") % 50 != 3, F.col("id") % 390).alias("id"), (F.col("id") % 3).alias("a"),
                                F.when(F.col("id") % 7 != 0, F.concat(F.lit("u"), (F.col("id") % 150).cast("string"))).alias("b"),
                                F.pmod(F.xxhash64("id"), F.lit(10)).cast("double").alias("y"),
                                (F.col("id") % 5).cast("int").alias("outer"), F.pmod(F.hash("id"), F.lit(4)).alias("inner"))
    test = F.col("id") % 6 == 0
    return t.select("id", *COLS, F.when(F.col("y") != 9, F.col("y")).alias("y"), F.when(~test, F.col("outer")).alias("outer"),
                    F.when(~test, F.col("inner")).alias("inner")).repartition(3, "id").localCheckpoint()


def _rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_rare_keys_are_not_joined_to_rows(spark):
    plan = N.target_encode_roles(_df(spark), COLS, "y", "inner", "outer", max_bytes=0)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and plan.count("MapInArrow") == 1


@pytest.mark.parametrize("outer", ["outer", None])
def test_blocks_and_ranges_do_not_change_values(spark, monkeypatch, outer):
    df = _df(spark)
    whole = _rows(N.target_encode_roles(df, COLS, "y", "inner", outer))
    assert len(whole) == 400 * (5 if outer else 1)  # repeated and null ids are rows each
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    monkeypatch.setattr(N, "ROWS_AT_ONCE", 7)
    assert _rows(N.target_encode_roles(df, COLS, "y", "inner", outer, max_bytes=64)) == whole


def test_keys_of_one_hash_stay_apart():
    h, h2 = np.array([5, 9, 5, 5, 9], np.uint64), np.array([1, 3, 2, 1, 3], np.uint32)
    order, new = N._order(h, h2)
    runs = np.split(order, np.flatnonzero(new)[1:])
    assert sorted(sorted(r.tolist()) for r in runs) == [[0, 3], [1, 4], [2]]
    order, new = N._order(h, h2, np.array([2, 0, 1, 0, 0], np.uint16))
    assert [h2[i] for i in order] == [1, 1, 2, 3, 3] and new.tolist() == [True, False, True, True, False]
