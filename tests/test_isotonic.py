"""Isotonic fit by ranges against one plain pass of adjacent pooling."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import isotonic as I


def _plain(rows):
    cells = {}
    for p, y, w in rows:
        if p is not None and p == p and y is not None and w and w > 0:
            s, n = cells.get(p, (0.0, 0.0))
            cells[p] = (s + y * w, n + w)
    ps = sorted(cells)
    out = []
    for p in ps:  # max over starts of the least mean: the definition, without a stack
        i = ps.index(p)
        best = None
        for a in range(i + 1):
            s = n = 0.0
            least = None
            for b in range(a, len(ps)):
                s, n = s + cells[ps[b]][0], n + cells[ps[b]][1]
                if b >= i:
                    least = s / n if least is None else min(least, s / n)
            best = least if best is None else max(best, least)
        out.append(best)
    return ps, out


def _rows(kind, n=120):
    rng = random.Random(kind)
    if kind == "noise":
        return [(round(rng.random(), 2), float(rng.random() < 0.5), 1.0) for _ in range(n)]
    if kind == "rising":
        return [(k / n, k / 7, 2.0) for k in range(n)]
    if kind == "falling":
        return [(k / n, -k / 7, 1.0) for k in range(n)]
    if kind == "hot":
        return [(0.5, float(k % 3 == 0), 1.0) for k in range(n)] + [(rng.random(), float(rng.random() < 0.3), 0.5) for _ in range(40)]
    return [(rng.random(), rng.random() ** 2 + k / n, rng.random()) for k in range(n)] + [
        (None, 1.0, 1.0), (float("nan"), 1.0, 1.0), (0.2, None, 1.0), (0.3, 9.0, 0.0), (0.4, 9.0, None)]


@pytest.mark.parametrize("kind", ["noise", "rising", "falling", "hot", "mixed"])
@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_against_the_definition(spark, kind, max_bytes):
    rows = _rows(kind)
    df = spark.createDataFrame(rows, "p double, y double, w double")
    blocks = I.fit(df, weight_col="w", ranges=30)
    ps, vs = _plain(rows)
    target = [(k, x) for k, x in enumerate([*ps, -1.0, 2.0, *[(a + b) / 2 for a, b in zip(ps, ps[1:])]])] + [(-1, None), (-2, float("nan"))]
    got = I.transform(spark.createDataFrame(target, "id long, p double"), blocks, max_bytes=max_bytes).collect()
    assert len(got) == len(target)
    for r in got:
        if r["p"] is None or r["p"] != r["p"]:
            assert r["p_iso"] is None
        else:
            assert r["p_iso"] == pytest.approx(float(np.interp(r["p"], ps, vs)), abs=1e-9)


def test_ranges_that_agree_are_not_merged(spark):
    df = spark.createDataFrame([(k / 50, float(k)) for k in range(50)], "p double, y double")
    assert I.fit(df, ranges=10).select("r").distinct().count() > 5


def test_no_rows(spark):
    df = spark.createDataFrame([(0.1, 1.0)], "p double, y double")
    blocks = I.fit(df.limit(0))
    assert blocks.count() == 0
    assert [r["p_iso"] for r in I.transform(df, blocks).collect()] == [None]
    assert I.transform(df.limit(0), I.fit(df)).count() == 0
