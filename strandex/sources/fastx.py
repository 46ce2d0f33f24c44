"""FASTA and FASTQ as tables: split by Spark's own text reader, in any file system and codec that it reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_FASTQ = r"\.(?:fastq|fq)(?:\.gz)?$"


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows(file, block, id, ...)`` with ``no``, the place in the file from 0: blocks are counted, then added up."""
    per = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = per.select("file", "block", "first", F.expr("coalesce(sum(n) OVER (PARTITION BY file ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("before"))
    return rows.join(before, ["file", "block"]).withColumn("no", F.col("id") - F.col("first") + F.col("before")).drop("first", "before", "block", "id")


def _text(spark: SparkSession, paths: str | list[str], separator: str) -> DataFrame:
    lines = spark.read.option("lineSep", separator).text(paths)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")


def fasta(spark: SparkSession, paths: str | list[str], keep_empty: bool = False) -> DataFrame:
    """``(file, no, header, accession, seq)`` of each record: header is the whole line, accession its first word.

    Sequences may run over lines, of either kind of line end. Records without an id are left out, and so are empty
    sequences unless ``keep_empty``.
    """
    rows = _numbered(_text(spark, paths, "\n>").withColumn("value", F.regexp_replace("value", "\r", "")))
    rows = rows.withColumn("value", F.when(F.col("no") == 0, F.regexp_replace("value", r"^\s*>", "")).otherwise(F.col("value")))
    header = F.substring_index("value", "\n", 1)
    seq = F.regexp_replace(F.substr("value", F.length(header) + 1), r"\s", "")
    out = rows.select("file", "no", header.alias("header"), F.regexp_extract(header, r"^\s*(\S*)", 1).alias("accession"), seq.alias("seq")).where("accession <> ''")
    return out if keep_empty else out.where("seq <> ''")


def fastq(spark: SparkSession, paths: str | list[str], keep_empty: bool = False) -> DataFrame:
    """``(file, no, header, seq, quality)`` of records of four lines; empty sequences are left out unless ``keep_empty``.

    A file whose lines don't make whole records, or whose records don't begin with ``@`` and ``+``, is an error.
    """
    lines = _numbered(_text(spark, paths, "\n").withColumn("value", F.regexp_replace("value", "\r$", "")))
    lines = lines.where((F.col("value") != "") | (F.col("no") % 4 != 0))  # blank lines at the end
    part = lambda i: F.max(F.when(F.col("no") % 4 == i, F.col("value")))
    rows = lines.groupBy("file", F.floor(F.col("no") / 4).alias("no")).agg(part(0).alias("a"), part(1).alias("seq"), part(2).alias("b"), part(3).alias("quality"))
    sound = F.col("a").startswith("@") & F.col("b").startswith("+") & (F.length("seq") == F.length("quality"))
    checked = F.when(sound, F.substr("a", F.lit(2))).otherwise(F.raise_error(F.concat(F.lit("not a FASTQ record: "), F.col("file"), F.lit(" "), F.col("no"))))
    out = rows.select("file", F.col("no").cast("long").alias("no"), checked.alias("header"), "seq", "quality")
    return out if keep_empty else out.where("seq <> ''")


def reads(spark: SparkSession, path: str, second: str | None = None) -> DataFrame:
    """``(read_id, mate, header, seq)``; mates are paired by place, and files of different numbers of records are an error."""
    one = _read_file(spark, path).select(F.col("no").alias("read_id"), F.lit(1).alias("mate"), "header", "seq")
    if second is None:
        return one
    two = _read_file(spark, second).select(F.col("no").alias("read_id"), F.lit(2).alias("mate"), "header", "seq")
    n, m = one.count(), two.count()
    if n != m:
        raise ValueError(f"the mates have {n} and {m} records")
    return one.unionByName(two)


def _read_file(spark: SparkSession, path: str) -> DataFrame:
    return fastq(spark, path) if _is_fastq(path) else fasta(spark, path)


def _is_fastq(path: str) -> bool:
    import re

    return bool(re.search(_FASTQ, path))


def sample_of(name: Column) -> Column:
    """``(sample, mate)`` of a file name: what stands before ``_R1`` or ``_R2``, else before the first ``.f``."""
    sample = F.when(name.contains("_R1"), F.substring_index(name, "_R1", 1)).when(name.contains("_R2"), F.substring_index(name, "_R2", 1)).otherwise(F.substring_index(name, ".f", 1))
    return F.struct(sample.alias("sample"), F.when(~name.contains("_R1") & name.contains("_R2"), 2).otherwise(1).alias("mate"))


def samples(paths: DataFrame) -> DataFrame:
    """``(sample, r1, r2)`` by name from ``paths(path)``; files that aren't FASTQ and samples without a first mate are left out."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = paths.where(name.rlike(_FASTQ)).select("path", sample_of(name).alias("s"))
    one = lambda m: F.max(F.when(F.col("s.mate") == m, F.col("path")))
    return rows.groupBy(F.col("s.sample").alias("sample")).agg(one(1).alias("r1"), one(2).alias("r2")).where("r1 IS NOT NULL").orderBy("sample")


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """The samples of a folder, from its listing alone."""
    return samples(spark.read.format("binaryFile").load(folder).select("path"))


def write_fasta(records: DataFrame, path: str, width: int = 80) -> None:
    """Records as text, ``>header`` and lines of ``width`` bases."""
    from strandex.functions.sequence import wrap

    records.select(F.concat(F.lit(">"), "header", F.lit("\n"), wrap(F.col("seq"), width))).write.text(path)
