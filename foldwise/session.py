"""Spark session helpers.

The engine never hard-codes cluster settings; it reads what the session
already carries and only fills in what is missing (local tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Rows below this count may be broadcast. Every broadcast in the engine is
# guarded by an explicit count against this bound (see ``joins.lookup_join``).
DEFAULT_BROADCAST_ROWS = 2_000_000


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "foldwise") -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # checkpoint files of materialised intermediates are deleted once their DataFrame is gone
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is; a local scratch folder is only chosen when nothing is configured
    in a local session (tests and the bench). A cluster without the setting
    is refused.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        return current
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not sc.master.startswith("local"):
        # executors would each write to their own disk, and later reads would miss those files
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    scratch = tempfile.mkdtemp(prefix="foldwise-ckpt-", dir=os.environ.get("FOLDWISE_SCRATCH", "/tmp"))
    sc.setCheckpointDir(scratch)
    return scratch


def materialize(df):
    """Cut lineage at a stage boundary: a reliable checkpoint in the session's checkpoint folder.

    Used where an intermediate table is read by several branches of a plan:
    it is computed once, survives executor loss (files, not executor memory),
    and later plans start from the files instead of re-optimising the whole
    lineage. Sessions should set ``spark.cleaner.referenceTracking.cleanCheckpoints``
    so the files go once the DataFrame is no longer referenced.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
