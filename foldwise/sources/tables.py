"""Readers (IO-1, IO-2, IO-3, IO-8, J-4)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_table(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "csv",
               multi_line: bool = True) -> DataFrame:
    """IO-1: scan a CSV (header, quoted fields) or parquet with a declared schema.

    ``multi_line`` allows line ends inside quoted fields; a file is then one task. Without it Spark splits files.
    """
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .csv(path)
    )


def read_sources(sources: Mapping[str, DataFrame], split_col: str = "split") -> DataFrame:
    """IO-2: several aligned sources as one table tagged by ``split``.

    Features are then computed once over the union instead of once per table.
    Missing columns (test has no label) become null.
    """
    out = None
    for name, df in sources.items():
        tagged = df.withColumn(split_col, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    return out


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """IO-3: fail at plan time when a required column is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def strict_lookup(ids: DataFrame, features: DataFrame, id_col: str = "id", prefix: str = "ext_",
                  on_missing: str = "raise") -> DataFrame:
    """IO-8 / J-4: attach external per-id features; every id must be present.

    Feature columns are renamed with ``prefix``. The completeness check is a
    ``left_anti`` count (distributed); on failure either raise or return the
    ids unchanged (``on_missing='skip'``, the reference's behaviour).
    """
    feats = features.select(
        F.col(id_col), *[F.col(c).alias(f"{prefix}{c}") for c in features.columns if c != id_col]
    )
    n_missing = ids.select(id_col).join(feats.select(id_col), id_col, "left_anti").count()
    if n_missing:
        if on_missing == "skip":
            return ids
        raise ValueError(f"{n_missing} ids have no external features")
    return ids.join(feats, id_col, "inner")
