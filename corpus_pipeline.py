"""From raw documents to shuffled shards: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandex.llm import decontaminate, mixing, quality, sharding, simhash
from strandex.llm.common import shared_folder, table

STAGES = [
    ("quality classifier", quality.good_only),
    ("simhash near-dedup", simhash.one_of_each),
    ("benchmark decontamination", decontaminate.clean_only),
    ("mixing sources", mixing.mixed),
    ("sharding", sharding.into_shards),
]

#: Scores, fingerprints, tiles and the shuffle are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage kept is in the shared folder, so a lost executor loses none of it.

    The last stage is returned as it is: the documents with size, text_crc32, law, shard, slot and grown_shard.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{n}")
            docs = spark.read.parquet(f"{folder}/{n}")
    return docs
