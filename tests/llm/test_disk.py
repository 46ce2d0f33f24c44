"""What is left on disk, and what a band's row takes in a shuffle."""

import time

from pyspark.sql import functions as F

from strandex.llm import common, lines
from tests.llm.test_lines import band_keys


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_cut_leaves_no_shuffle_files(spark):
    """The plan is still referred to, so no collection of garbage can have removed them."""
    before, setting = shuffle_files(spark), spark.conf.get(common.CLEANUP, None)
    df = spark.range(5000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    kept = common.cut(df)
    for _ in range(100):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(common.CLEANUP, None) == setting
    assert sorted(kept.collect()) == sorted(df.collect()) and kept.count() == 7


def test_rows_of_bands_have_zero_bytes_at_both_ends(spark):
    texts = [f"line number {i} of some that differ" for i in range(200)]
    keys = set().union(*band_keys(spark, texts))
    assert all(k % (1 << 16) == 0 for k in keys) and len({k >> 56 for k in keys}) > 100
    handles = [r.h for r in spark.createDataFrame([(x,) for x in texts], "x string").select(lines._handle(F.col("x")).alias("h")).collect()]
    assert all(0 <= h < 1 << 48 for h in handles) and len(set(handles)) == len(texts)
