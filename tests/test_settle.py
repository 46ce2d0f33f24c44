"""What is shuffled once goes as soon as the result is there."""

from pathlib import Path

from pyspark.sql import functions as F

from strandex.operators.common import settle, settle_alone


def test_shuffle_files_go(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    local = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    files = lambda: {f for f in local.rglob("shuffle_*.data")}
    rows = lambda: spark.range(20000).withColumn("k", F.col("id") % 7).repartition("k").select("id", F.col("k") + 1)
    before = files()
    kept = settle(rows())
    assert files() - before and kept.count() == 20000
    before = files()
    alone = settle_alone(rows())
    assert not files() - before
    assert alone.count() == 20000 and spark.conf.get(key, None) == was
