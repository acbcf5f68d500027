"""Blending and stacking over long score tables (BL-1..BL-10, W-1, W-3, A-9).

Scores are long: ``(id, model, [seed], [fold], y, p)``; a DataFrame has no
row order, so models are aligned by ``id`` (pivot), never by position.
Weight searches fold rows to distinct ``(scores..., label)`` cells with their
counts first; a bounded grid of weights is exploded per cell, and every AUC
comes from one distributed pass partitioned by the weight (ME-3); the argmax
is ``max_by`` over the small (weight, auc) table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .metrics import auc
from .ranking import default_buckets

EPS = 1e-12


def logit(p: Column) -> Column:
    """BL-1: ln((p + 1e-12) / (1 - p + 1e-12))."""
    return F.log((p + F.lit(EPS)) / (F.lit(1.0) - p + F.lit(EPS)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def wide_scores(scores: DataFrame, models: Sequence, id_col: str = "id", model_col: str = "model",
                p_col: str = "p", keep: Sequence[str] = ("y",)) -> DataFrame:
    """One column ``p_<model>`` per model, aligned by id (a pivot with a fixed value list)."""
    aggs = [F.first(F.col(k)).alias(k) for k in keep]
    wide = scores.groupBy(id_col).agg(*aggs, *[F.max(F.when(F.col(model_col) == m, F.col(p_col))).alias(f"p_{m}")
                                                for m in models])
    return wide


def mean_blend(scores: DataFrame, by: Sequence[str] = ("id",), p_col: str = "p") -> DataFrame:
    """BL-2 / A-9: mean probability per id (over models, folds or seeds)."""
    return scores.groupBy(*by).agg(F.avg(p_col).alias("p_mean"))


def logit_mean_blend(scores: DataFrame, by: Sequence[str] = ("id",), p_col: str = "p") -> DataFrame:
    """BL-3: sigmoid of the mean logit."""
    return scores.groupBy(*by).agg(sigmoid(F.avg(logit(F.col(p_col)))).alias("p_logit_mean"))


def score_cells(wide: DataFrame, cols: Sequence[str], label: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, label, cols..., _c)``: equal rows with their count, written (read for the bounds and by the grid)."""
    return materialize(wide.groupBy(*by, label, *cols).agg(F.count(F.lit(1)).alias("_c")))


def _bounds(cells: DataFrame, cols: Sequence[str]) -> list[float]:
    """Cuts for scores that lie between the columns of their cell: quantiles of all columns together."""
    n = default_buckets(cells)
    qs = cells.approxQuantile(list(cols), [i / n for i in range(1, n)], 1.0 / (4 * n))
    every = sorted(q for one in qs for q in one)
    return every[len(cols) // 2::len(cols)]


def _w_of(i: Column, n: int) -> Column:
    step = 1.0 / (n - 1)
    return F.when(i == n - 1, F.lit(1.0)).otherwise(i.cast("double") * F.lit(step))


def weight_search(wide: DataFrame, a: str, b: str, label: str = "y", space: str = "linear", n: int = 101,
                  by: Sequence[str] = ()) -> DataFrame:
    """BL-4 / BL-5: AUC of ``w*a + (1-w)*b`` (or the logit-space blend) for every grid weight.

    Returns ``(*by, w, auc)``. The grid (n rows) is exploded per cell, so the
    AUC pass is one shuffle partitioned by (by, w).
    """
    cells = score_cells(wide, [a, b], label, by)
    t = cells.select(*by, label, a, b, "_c", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_i"))
    w = _w_of(F.col("_i"), n)
    if space == "logit":
        s = sigmoid(w * logit(F.col(a)) + (F.lit(1.0) - w) * logit(F.col(b)))
    else:
        s = w * F.col(a) + (F.lit(1.0) - w) * F.col(b)
    t = t.select(*by, label, "_c", w.alias("w"), s.alias("_s"))
    r = auc(t, score="_s", label=label, by=[*by, "w"], weight="_c", bounds=_bounds(cells, [a, b]))
    return r.select(*by, "w", "auc")


def best_weight(grid: DataFrame, by: Sequence[str] = (), key: str = "w") -> DataFrame:
    """W-3: first argmax over ascending weights (strict ``>``): the smallest weight among equal AUCs."""
    return grid.groupBy(*by).agg(F.max_by(F.col(key), F.struct(F.col("auc"), -F.col(key))).alias(f"best_{key}"),
                                 F.max("auc").alias("best_auc"))


def simplex_points(n_models: int, step: float = 0.1) -> list[tuple[float, ...]]:
    """Non-negative weights on a grid of ``step`` summing to 1 (286 points for 4 models at 0.1)."""
    k = round(1 / step)

    def compositions(left: int, parts: int):
        if parts == 1:
            yield (left,)
            return
        for first in range(left + 1):
            for rest in compositions(left - first, parts - 1):
                yield (first, *rest)

    return [tuple(x / k for x in c) for c in compositions(k, n_models)]


def simplex_search(wide: DataFrame, cols: Sequence[str], label: str = "y", step: float = 0.1) -> DataFrame:
    """BL-6: AUC of every simplex-grid weighting of ``cols``; ``(point, w_<col>..., auc)``.

    The grid is a parameter-sized list (C(k+m-1, m-1) points), exploded per cell.
    """
    pts = simplex_points(len(cols), step)
    arr = F.array(*[F.struct(F.lit(i).alias("point"), *[F.lit(w).alias(f"w_{c}") for w, c in zip(pt, cols)])
                    for i, pt in enumerate(pts)])
    cells = score_cells(wide, cols, label)
    t = cells.select(label, *cols, "_c", F.explode(arr).alias("_g")).select(label, *cols, "_c", "_g.*")
    s = None
    for c in cols:
        term = F.col(f"w_{c}") * F.col(c)
        s = term if s is None else s + term
    t = t.withColumn("_s", s)
    r = auc(t, score="_s", label=label, by=["point", *[f"w_{c}" for c in cols]], weight="_c", bounds=_bounds(cells, cols))
    return r.select("point", *[f"w_{c}" for c in cols], "auc")


def best_simplex(grid: DataFrame, cols: Sequence[str], equal_fallback: bool = True) -> DataFrame:
    """Best simplex point (ties: the lowest point index); equal weights if every AUC is undefined."""
    best = grid.agg(F.max_by(F.struct(*[F.col(f"w_{c}") for c in cols]), F.struct(F.col("auc"), -F.col("point")))
                    .alias("_b"), F.max("auc").alias("best_auc"))
    return best.select(*[F.col(f"_b.w_{c}").alias(f"w_{c}") for c in cols], "best_auc")


def drop_worst_seed(diag: DataFrame, group: Sequence[str] = ("model", "fold"), seed: str = "seed",
                    metric: str = "val_auc") -> DataFrame:
    """W-1: per group drop the seed with the lowest metric (ties: the last listed seed); a lone seed is kept."""
    w = Window.partitionBy(*group).orderBy(F.col(metric).asc(), F.col(seed).desc())
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    return diag.withColumn("_rk", F.row_number().over(w)).withColumn("_n", n) \
        .where((F.col("_rk") > 1) | (F.col("_n") == 1)).drop("_rk", "_n")
