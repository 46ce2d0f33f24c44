"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only on a local master, as in tests, one is made where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return named or spark.sparkContext.getCheckpointDir()


def packed(docs: DataFrame, *cols: str) -> DataFrame:
    """``docs`` as one column ``row``, beside copies of ``cols``: no name that is added can clash with one in ``docs``."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[F.col(f"`{c}`").alias(c) for c in cols])


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns that ``docs`` had, of rows from :func:`packed`."""
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


#: Has a query remove its shuffle files as it ends; read when a DataFrame is made.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the folder that the cluster shares, so a lost executor loses none of it.

    The shuffle files it took are removed at once; otherwise they stay until the driver's garbage is collected, and longer
    while a plan is referred to.
    """
    spark = df.sparkSession
    shared_folder(spark)
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


def release(spark: SparkSession) -> None:
    """Has the driver's JVM collect: Spark removes the shuffle files of plans that it then finds to be done with."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
