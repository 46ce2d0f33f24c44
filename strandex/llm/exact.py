"""Exact duplicates: combined locally, then in salted digest groups, then over the salts, by whole content each time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandex.llm.common import cut, table

SALTS = 16


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, a row for each row of ``docs``.

    Null text counts as empty; texts are equal when they are identical. Of equal texts the row with the largest
    doc_id stays (a null id is smaller than any; rows that repeat the id of the row that stays are marked kept too).

    Every stage groups by digest and by the text itself, so rows of one digest and different texts never meet in a
    group. Each task first combines what it has read; its winners are combined within (digest, salt), and the
    winners of the salts globally, so a group of any size gives at most one row for each task and salt. Members find
    their group by digest alone; only where a digest has several texts do the texts travel again.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    best = [F.max("doc_id").alias("keep_id"), F.count("*").alias("n")]
    local = rows.groupBy("digest", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"), "text").agg(*best)
    whole = local.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    groups = cut(whole.select("digest", "keep_id", "group_size"))
    several = cut(groups.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"))
    found = rows.select("doc_id", "digest").join(groups, "digest").select("digest", "doc_id", "keep_id", "group_size")
    if not several.isEmpty():
        clash = whole.join(several, "digest", "left_semi").drop("digest")
        members = rows.join(several, "digest", "left_semi").join(clash, "text")
        found = found.join(several, "digest", "left_anti").unionByName(members.select(*found.columns))
    return found.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op3_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
