"""Writers (IO-4, IO-6, IO-7, IO-9, IO-10).

Every sink is a distributed write (one file per task); nothing is collected
to the driver except the one-row run metadata. Paths are caller-supplied
(shared storage on a cluster).
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.post import fixed_precision


def write_scores(df: DataFrame, path: str, id_col: str = "id", score_col: str = "score", out_name: str | None = None,
                 fixed: bool = False, mode: str = "overwrite") -> None:
    """IO-4 / IO-5: ``id, score`` CSV with a header; ``fixed`` writes ``%.10f`` after clipping to [1e-6, 1-1e-6]."""
    s = fixed_precision(F.col(score_col)) if fixed else F.col(score_col)
    df.select(F.col(id_col), s.alias(out_name or score_col)).write.mode(mode).option("header", True).csv(path)


def write_variants(df: DataFrame, base_path: str, id_col: str = "id", label: str = "is_cheating",
                   mode: str = "overwrite") -> list[str]:
    """IO-6: main / conservative / aggressive files from one scored table (``post.variants`` columns)."""
    paths = []
    for v in ("main", "conservative", "aggressive"):
        p = f"{base_path.rstrip('/')}/{v}"
        write_scores(df, p, id_col, v, out_name=label, mode=mode)
        paths.append(p)
    return paths


def write_metadata(spark: SparkSession, path: str, meta: Mapping, mode: str = "overwrite") -> None:
    """IO-7: run metadata (models, seeds, folds, chosen weights ...) as a one-row JSON table."""
    spark.read.json(spark.sparkContext.parallelize([json.dumps(dict(meta))])).coalesce(1) \
        .write.mode(mode).json(path)


def export_features(train: DataFrame, test: DataFrame | None, path: str, split_col: str = "split",
                    combined: bool = True, mode: str = "overwrite") -> list[str]:
    """IO-9: one feature table tagged by split (partitioned by it), or two tables."""
    if test is None:
        train.write.mode(mode).parquet(path)
        return [path]
    if combined:
        both = train.withColumn(split_col, F.lit("train")).unionByName(
            test.withColumn(split_col, F.lit("test")), allowMissingColumns=True)
        both.write.mode(mode).partitionBy(split_col).parquet(path)
        return [path]
    p_tr, p_te = f"{path.rstrip('/')}/train", f"{path.rstrip('/')}/test"
    train.write.mode(mode).parquet(p_tr)
    test.write.mode(mode).parquet(p_te)
    return [p_tr, p_te]


def metric_stamped_path(template: str, metrics: DataFrame, metric_col: str = "auc", digits: int = 6) -> str:
    """IO-10: format a path with a metric computed by Spark (one-row table), e.g. ``oof_cv_{auc}``."""
    v = metrics.select(metric_col).first()[0]
    return template.format(**{metric_col: f"{v:.{digits}f}"})
