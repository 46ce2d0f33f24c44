"""Sharding by a two-pass external shuffle; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import MapType

from strandex.llm.common import table

SHARDS = 24
SEED = 17
#: Bytes of carried text and rows that a bucket has in the mean, and rows that are shuffled as one.
BUCKET_BYTES, BUCKET_ROWS, MOST_ROWS = 8 << 20, 512, 1024


def _best(doc_id: Column, shards: int, seed: int) -> Column:
    """The shard whose seeded hash with the id is highest: one more shard takes rows only into itself."""
    draws = [F.struct(F.xxhash64(F.lit(seed), doc_id, F.lit(s)).alias("draw"), F.lit(s).alias("shard")) for s in range(shards)]
    return (draws[0] if shards == 1 else F.greatest(*draws))["shard"].cast("int")


def _fisher_yates(n: Column, *seeds: Column) -> Column:
    """A permutation of 0 to n - 1: from the last place down, each is swapped with one drawn by a hash of the seeds and the place."""

    def swap(order: Column, i: Column) -> Column:
        drawn = F.pmod(F.xxhash64(*seeds, i), i + 1).cast("int")
        moved = lambda j: F.transform(order, lambda x, k: F.when(k == i, F.get(order, j)).when(k == j, F.get(order, i)).otherwise(x))
        return F.transform(F.array(drawn), moved)[0]

    return F.when(n > 1, F.aggregate(F.sequence(n - 1, F.lit(1), F.lit(-1)), F.sequence(F.lit(0), n - 1), swap)).otherwise(F.array(F.lit(0)))


def shard(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """``carry`` columns (all, by default) with ``size, text_crc32, law, shard, slot, grown_shard``.

    Law ``key``: the shard is decided by the id and the number of shards (highest seeded hash); grown_shard is the
    one with a shard more, which is the same or the new one. Null ids hash like a value; null text counts as empty.

    Pass one scatters the rows uniformly by seeded hash into buckets inside a shard, of about ``bucket_bytes`` of carried text or
    BUCKET_ROWS rows, whichever are less. Pass two gathers a bucket in one task, which holds no more than that, orders it by id and
    content, shuffles it by Fisher-Yates with draws hashed from seed, shard, bucket and place, and gives out its rows in that order:
    slots count through the buckets of a shard without gaps. So a slot depends on the seed and the rows alone, not on partitions
    or arrival. The hash of a bucket takes id and text, so copies under many ids spread; only rows that repeat both share a
    bucket, which is then shuffled in runs of MOST_ROWS. An empty table gives no rows; columns of ``docs`` that bear a name of
    the results are dropped; columns of maps are carried.
    """
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in made]
    maps = {f.name for f in docs.schema if isinstance(f.dataType, MapType)}  # maps have no order: their entries travel
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = F.octet_length(text) + 64 if text_col in carry else F.lit(64)
    total, n_rows = docs.agg(F.sum(held.cast("long")), F.count("*")).first()
    buckets = max(1, -(-(total or 0) // (bucket_bytes * shards)), -(-n_rows // (BUCKET_ROWS * shards)))
    key = F.col(id_col)
    rows = docs.select(
        F.struct(*[(F.map_entries(f"`{c}`") if c in maps else F.col(f"`{c}`")).alias(c) for c in carry]).alias("row"),
        key.alias("key"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        _best(key, shards, seed).alias("shard"),
        _best(key, shards + 1, seed).alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit(seed), F.lit("bucket"), key, text), F.lit(buckets)).alias("bucket"),
    )
    item = F.struct("key", "text_crc32", "size", "grown_shard", "row")
    gathered = rows.groupBy("shard", "bucket").agg(F.sort_array(F.collect_list(item)).alias("items"))
    runs = F.sequence(F.lit(0), F.floor((F.size("items") - 1) / MOST_ROWS).cast("int"))
    parts = gathered.select("shard", "bucket", "items", F.explode(runs).alias("run"))
    parts = parts.select("shard", "bucket", "run", F.slice("items", F.col("run") * MOST_ROWS + 1, F.lit(MOST_ROWS)).alias("items"))
    order = _fisher_yates(F.size("items"), F.lit(seed), F.col("shard"), F.col("bucket"), F.col("run"))
    mixed = parts.select("shard", "bucket", "run", F.transform(order, lambda p: F.get("items", p)).alias("items"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", (F.expr("sum(n) OVER (PARTITION BY shard ORDER BY bucket)") - F.col("n")).alias("before"))
    placed = mixed.select("shard", "bucket", "run", F.posexplode("items").alias("pos", "item")).join(before, ["shard", "bucket"])
    own = {c: F.col("item.row").getField(c) for c in carry}
    return placed.select(
        *[(F.map_from_entries(v) if c in maps else v).alias(c) for c, v in own.items()],
        F.col("item.size").alias("size"),
        F.col("item.text_crc32").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        (F.col("before") + F.col("run") * MOST_ROWS + F.col("pos")).cast("long").alias("slot"),
        F.col("item.grown_shard").alias("grown_shard"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes a folder a shard, its rows sorted by slot within each file."""
    n = sharded.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = sharded.repartitionByRange(int(n), "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the documents with their shard and their slot in it."""
    return shard(docs)


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
