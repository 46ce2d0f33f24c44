"""Mixing sources to target weights by Poisson replication; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandex.llm.common import table, unpacked

SEED = 29
POWER = 0.5
#: Sources whose tables (some 400 bytes each at usual rates) may be broadcast.
MOST_SOURCES = 10_000


def rates(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None, source_col: str = "source", power: float = POWER) -> DataFrame:
    """``(source, rate)``: the mean number of copies of a row of each source.

    ``weights(source, weight)`` are shares of the mix, of any scale; a source without one has weight 0. Without
    them a source weighs the power ``power`` of its size, which lifts small sources. ``total``: rows wanted in the mean (as
    many as there are, by default). A null source is a source of its own.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(float(power))))
    else:
        given = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        weighed = sizes.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0.0, ["weight"])
    sums = weighed.agg(F.sum("weight"), F.sum("n")).first()
    if not sums[0]:
        return weighed.select("source", F.lit(0.0).alias("rate"))
    wanted = sums[1] if total is None else total
    return weighed.select("source", (F.col("weight") / F.lit(float(sums[0])) * F.lit(wanted) / F.col("n")).alias("rate"))


def uniform(seed: int, *cols: Column) -> Column:
    """52 bits of an MD5 over the seed and the values, in [0, 1)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def copies(docs: DataFrame, rate: DataFrame, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``(row, copy, order)``: each row of ``docs``, as one struct, as often as its draw says; ``copy`` counts from 0.

    The number of copies inverts the Poisson distribution of the source's rate at a uniform number hashed from the
    seed and the id: it is the number of values of the cumulative distribution that don't exceed it. The table of
    these values ends where no 52-bit number is left, so nothing is cut off, whatever the rate. Rows that repeat an
    id share a draw; null ids hash like a value, a null source is a source of its own. ``order`` hashes id and copy, so a hot
    source spreads over all partitions. The tables are broadcast if there are at most ``MOST_SOURCES`` of them; beyond that they
    are joined by a shuffle. An empty table gives no rows. Columns of ``docs`` may have any names.
    """
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    step = lambda acc, k: F.struct(
        F.concat(acc["cdf"], F.array(acc["sum"])).alias("cdf"),
        (acc["term"] * F.col("rate") / k).alias("term"),
        (acc["sum"] + acc["term"] * F.col("rate") / k).alias("sum"),
    )
    # exp(-rate) underflows beyond a rate of 745: a high rate is drawn in parts of at most 500, whose draws are summed
    start = F.struct(F.array().cast("array<double>").alias("cdf"), F.exp(-F.col("rate")).alias("term"), F.exp(-F.col("rate")).alias("sum"))
    steps = F.transform(F.sequence(F.lit(1), last), lambda k: k.cast("double"))
    parts = F.greatest(F.ceil(F.col("rate") / 500.0), F.lit(1)).cast("int")
    tables = rate.where("rate > 0").select(F.col("source").alias("of"), parts.alias("parts"), (F.col("rate") / parts).alias("rate"))
    tables = tables.select("of", "parts", F.aggregate(steps, start, step)["cdf"].alias("cdf"))
    if tables.count() <= MOST_SOURCES:
        tables = F.broadcast(tables)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source")
    )
    drawn = rows.join(tables, F.col("source").eqNullSafe(F.col("of"))).withColumn("u", uniform(seed, F.col("id")))
    part = lambda i: F.size(F.filter("cdf", lambda c: c <= uniform(seed, F.col("id"), i)))
    first = F.size(F.filter("cdf", lambda c: c <= F.col("u")))
    more = F.aggregate(F.sequence(F.lit(2), F.col("parts")), F.lit(0), lambda acc, i: acc + part(i))
    drawn = drawn.withColumn("n", first + F.when(F.col("parts") > 1, more).otherwise(0)).where("n > 0")
    out = drawn.select("row", "id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    return out.select("row", "copy", F.xxhash64(F.lit(seed), F.lit("order"), "id", "copy").alias("order"))


def replicate(docs: DataFrame, rate: DataFrame, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """:func:`copies` with the columns of ``docs``, ``__copy`` and ``__order``; columns of these two names in ``docs`` are dropped."""
    names = [c for c in docs.columns if c not in ("__copy", "__order")]
    out = copies(docs, rate, seed, id_col, source_col)
    return out.select(*[F.col("row").getField(c).alias(c) for c in names], F.col("copy").alias("__copy"), F.col("order").alias("__order"))


def shuffled(rows: DataFrame, order: str = "order") -> DataFrame:
    """Scattered over all partitions by the hash in ``order`` and sorted by it: files read in turn are the shuffled corpus."""
    return rows.repartition(order).sortWithinPartitions(order)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: sources at the square root of their sizes, as many rows as before in the mean."""
    return unpacked(shuffled(copies(docs, rates(docs))), docs)


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = shuffled(copies(docs.select("doc_id", "source"), rates(docs)))
    return rows.select("row.doc_id", "row.source", F.col("copy").cast("int").alias("copy"))


SQL = """
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
sums AS (SELECT sum(sqrt(n)) AS w, sum(n) AS rows_all FROM sizes),
rates AS (SELECT source, sqrt(n) / w * rows_all / n AS rate FROM sizes, sums),
tables AS (
  SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM rates, range(0, (SELECT CAST(ceil(max(rate) + 12 * sqrt(max(rate)) + 30) AS BIGINT) FROM rates)) AS r(k)),
draws AS (
  SELECT doc_id, source,
         CAST('0x' || substr(md5('29:' || coalesce(CAST(doc_id AS VARCHAR), '~')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM documents),
counts AS (
  SELECT d.doc_id, d.source, count(*) FILTER (WHERE t.cdf <= d.u) AS n
  FROM draws d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source GROUP BY ALL)
SELECT doc_id, source, CAST(unnest(range(0, n)) AS INTEGER) AS copy FROM counts WHERE n > 0
"""
