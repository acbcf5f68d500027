"""Nested encodings against a plain re-fit per fold pair, with the lookup in the row and beyond its bound."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from foldwise.operators import nested_encode as N
from foldwise.operators import rowlookup as R

COLS = ["a", "b", "c"]


def _rows():
    rng = random.Random(4)
    out = []
    for k in range(240):
        test = k % 6 == 0
        out.append((k, rng.choice(["x", "x", "x", "y", None]), f"u{k // 2}", rng.choice([1, 2, 3, 40 + k]),
                    None if test else float(rng.random() < 0.4), None if test else rng.randrange(3), None if test else rng.randrange(4)))
    return out


def _smoothed(rows, c, key, m_of):
    y = [r[4] for r in rows]
    g = sum(y) / len(y)
    by = {}
    for r in rows:
        if r[c] is not None:
            by.setdefault(r[c], []).append(r[4])
    if m_of == "auto":
        mu = [statistics.mean(v) for v in by.values()]
        var = [statistics.variance(v) for v in by.values() if len(v) > 1]
        vb = statistics.variance(mu) if len(mu) > 1 else 0
        m = (statistics.mean(var) / max(vb, 1e-9) if var else float("nan")) if vb > 0 else 0.0
    else:
        m = m_of
    if key not in by:
        return g
    te = (sum(by[key]) + m * g) / (len(by[key]) + m)
    return g if te != te else te


def _plain_mean(rows, c, key):
    y = [r[4] for r in rows if r[c] == key and key is not None]
    return sum(y) / len(y) if y else sum(r[4] for r in rows) / len(rows)


def _expected(rows, nested, smooth="auto"):
    train = [r for r in rows if r[5] is not None]
    out = {}
    for o in (sorted({r[5] for r in train}) if nested else [None]):
        part = [r for r in train if r[5] != o]
        for r in rows:
            role = "test" if r[5] is None else "valid" if nested and r[5] == o else "train"
            vals = []
            for c in (1, 2, 3):
                if role == "train":
                    vals.append(_smoothed([q for q in part if q[6] != r[6]], c, r[c], smooth))
                else:
                    vals.append(_plain_mean(part, c, r[c]))
            out[(r[0], o, role)] = [round(v, 9) for v in vals]
    return out


@pytest.mark.parametrize("nested,max_bytes,smooth", [(True, 1 << 20, "auto"), (True, 600, "auto"), (True, 0, "auto"),
                                                     (False, 1 << 20, "auto"), (False, 0, 5.0)])
def test_against_a_refit_per_part(spark, nested, max_bytes, smooth):
    rows = _rows()
    df = spark.createDataFrame(rows, "id long, a string, b string, c int, y double, outer int, inner int")
    got = N.target_encode_roles(df, COLS, "y", "inner", "outer" if nested else None, smooth=smooth, max_bytes=max_bytes).collect()
    have = {(r["id"], r["outer_fold"] if nested else None, r["role"]): [round(r[f"TE_{c}_mean"], 9) for c in COLS] for r in got}
    assert len(have) == len(got)
    want = _expected(rows, nested, smooth)
    assert have.keys() == want.keys()
    for k in want:
        assert have[k] == pytest.approx(want[k], abs=1e-7), k


def test_own_label_never_enters_a_train_row(spark):
    rows = _rows()
    flipped = [(*r[:4], 1 - r[4], *r[5:]) if r[0] == 7 else r for r in rows]
    enc = []
    for data in (rows, flipped):
        df = spark.createDataFrame(data, "id long, a string, b string, c int, y double, outer int, inner int")
        e = N.target_encode_roles(df, COLS, "y", "inner", "outer").where("id = 7").orderBy("outer_fold")
        enc.append([tuple(r) for r in e.collect()])
    assert enc[0] == enc[1]


def test_no_fold_loop_in_the_plan(spark):
    df = spark.createDataFrame(_rows(), "id long, a string, b string, c int, y double, outer int, inner int")
    plan = N.target_encode_roles(df, COLS, "y", "inner", "outer")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan  # rows stay where they are


@pytest.mark.parametrize("max_bytes", [1 << 20, 120, 0])
def test_lookup_edges(spark, max_bytes):
    df = spark.createDataFrame([(1, "p", 9), (1, "p", 9), (2, None, 9), (None, "q", 1), (4, "zz", 1)], "id long, k string, vals int")
    m = spark.createDataFrame([(0, "p", [1.0, 2.0], 5), (0, "q", [3.0, None], 2), (1, "9", [7.0, 8.0], 3)],
                              "column int, key string, vals array<double>, n long")
    got = R.look_up(df, [F.col("k"), F.col("vals")], m, 2, "n", "id", max_bytes=max_bytes).collect()
    nan = "nan"
    clean = sorted(((r["id"], r["k"], tuple(nan if v != v else v for v in r["_found"])) for r in got), key=repr)
    assert clean == sorted([(1, "p", (1.0, 2.0, 7.0, 8.0)), (1, "p", (1.0, 2.0, 7.0, 8.0)), (2, None, (nan, nan, 7.0, 8.0)),
                            (None, "q", (3.0, nan, nan, nan)), (4, "zz", (nan,) * 4)], key=repr)
    assert R.look_up(df.limit(0), [F.col("k"), F.col("vals")], m, 2, "n", "id", max_bytes=max_bytes).count() == 0
