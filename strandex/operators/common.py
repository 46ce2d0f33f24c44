"""Keeping what is used more than once."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed once into the folder that ``spark.checkpoint.dir`` names (only on a local master one is made where it is unset)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def settle_alone(df: DataFrame) -> DataFrame:
    """:func:`settle` of what is shuffled for this only: Spark removes the shuffle files as soon as it is there, not when the JVM next collects."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = conf.get(key, None)
    conf.set(key, "true")
    try:
        return settle(df.select("*"))  # planned under that setting
    finally:
        conf.unset(key) if was is None else conf.set(key, was)


def collect_garbage(spark) -> None:
    """Has the driver's JVM collect, so that Spark's cleaner removes the shuffle files of what was settled."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it comes in fewer pieces than there are (a small file of one row group); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
