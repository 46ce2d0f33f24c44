"""Tables of genome archives and of reports: taxonomy dumps, accession maps, summaries, listings, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandex.constants import UNIVEC
from strandex.functions.sequence import archive_path, first_token
from strandex.operators.index import core_names


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """``(taxid, parent)`` of a nodes dump, fields parted by ``\\t|\\t``."""
    return node_rows(spark.read.text(path))


def node_rows(lines: DataFrame) -> DataFrame:
    parts = F.split("value", r"\t\|\t?")
    return lines.select(F.get(parts, F.lit(0)).try_cast("long").alias("taxid"), F.get(parts, F.lit(1)).try_cast("long").alias("parent")).where("taxid IS NOT NULL AND parent IS NOT NULL").dropDuplicates(["taxid"])


def names(spark: SparkSession, path: str, targets: DataFrame) -> DataFrame:
    """``(taxid, name)``: scientific names of the targets, and the core domains with their fixed names."""
    return name_rows(spark.read.text(path), targets)


def name_rows(lines: DataFrame, targets: DataFrame) -> DataFrame:
    parts = F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t")
    rows = lines.select(F.get(parts, F.lit(0)).try_cast("long").alias("taxid"), F.get(parts, F.lit(1)).alias("name"), F.trim(F.get(parts, F.lit(3))).alias("kind"))
    found = rows.where("kind = 'scientific name'").join(targets.select("taxid").distinct(), "taxid", "left_semi")
    return core_names(found.select("taxid", "name"))


def targets(spark: SparkSession, path: str) -> DataFrame:
    return target_rows(spark.read.text(path))


def target_rows(lines: DataFrame) -> DataFrame:
    """``(taxid)``: numbers above 1, once each; other lines are ignored."""
    return lines.select(F.trim("value").try_cast("long").alias("taxid")).where("taxid > 1").distinct()


def accession_map(spark: SparkSession, path: str) -> DataFrame:
    """``(accession, taxid)``; a header line and empty ones are skipped, and of a repeated accession the last line holds."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("no"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return accession_rows(lines.withColumn("no", F.struct("file", "block", "no")))


def accession_rows(lines: DataFrame) -> DataFrame:
    """Of ``lines(no, value)``."""
    parts = F.split("value", "\t")
    rows = lines.where("value <> '' AND NOT startswith(value, 'accession')").select("no", F.get(parts, F.lit(0)).alias("accession"), F.trim(F.get(parts, F.lit(1))).try_cast("long").alias("taxid"))
    return rows.where("taxid IS NOT NULL").groupBy("accession").agg(F.max_by("taxid", "no").alias("taxid"))


def wanted_accessions(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(accession, taxid)`` of ``rows(source, no, accession, taxid, ...)`` that are wanted: the first row of the first source holds.

    Rows without a source, number or taxid don't count (an accession that has no others keeps a null taxid); rows of the same
    source and number are ordered by what other columns there are.
    """
    kept = rows.join(wanted.select("accession").distinct(), "accession", "left_semi")
    place = F.struct("source", "no", *[c for c in rows.columns if c not in ("source", "no", "accession", "taxid")])
    counts = F.col("source").isNotNull() & F.col("no").isNotNull() & F.col("taxid").isNotNull()
    return kept.groupBy("accession").agg(F.min_by("taxid", F.when(counts, place)).alias("taxid"))


def accession2taxid(spark: SparkSession, paths: list[str], wanted: DataFrame) -> DataFrame:
    """Of tab-separated files in the order of preference: columns accession, accession.version, taxid, gi."""
    out = None
    for i, path in enumerate(paths):
        parts = F.split("value", "\t")
        rows = spark.read.text(path).where("NOT startswith(value, 'accession')").select(
            F.lit(i).alias("source"), F.monotonically_increasing_id().alias("no"), F.get(parts, F.lit(1)).alias("accession"), F.get(parts, F.lit(2)).try_cast("long").alias("taxid")
        )
        out = rows if out is None else out.unionByName(rows)
    return wanted_accessions(out.where("accession IS NOT NULL AND taxid IS NOT NULL"), wanted)


def assembly_summary(spark: SparkSession, path: str, human: bool = False) -> DataFrame:
    return assembly_rows(spark.read.text(path), human)


def assembly_rows(lines: DataFrame, human: bool = False) -> DataFrame:
    """``(assembly, taxid, path)`` of complete genomes and chromosomes with an archive folder; of the human ones only the reference."""
    parts = F.split("value", "\t")
    rows = lines.where("NOT startswith(value, '#')").select("value", parts.alias("p")).where(F.size("p") >= 20)
    field = lambda i: F.trim(F.col("p")[i])
    rows = rows.select("value", field(0).alias("assembly"), field(5).try_cast("long").alias("taxid"), field(11).alias("level"), field(19).alias("folder"))
    kept = rows.where(F.col("level").isin("Complete Genome", "Chromosome") & ~F.col("folder").isin("", "na") & F.col("taxid").isNotNull())
    if human:
        kept = kept.where(F.contains("value", F.lit("Genome Reference Consortium")))
    return kept.select("assembly", "taxid", archive_path(F.col("folder")).alias("path"))


def listing(pages: DataFrame, folder: str) -> DataFrame:
    """``(file)``: the names ``<folder>.*.genomic.fna.gz`` that ``pages(html)`` mention, once each in order; none is an error."""
    found = pages.select(F.explode(F.regexp_extract_all("html", F.lit(rf"(?<=[\"'>/]|^)({folder}\.[^\"'>/]*?\.genomic\.fna\.gz)"), F.lit(1))).alias("file")).distinct()
    if found.isEmpty():
        raise ValueError(f"no file of {folder} in the listing")
    return found.orderBy("file")


def vector_sequences(records: DataFrame) -> DataFrame:
    """``records`` of vector contamination, which have one fixed taxid."""
    return records.withColumn("taxid", F.lit(UNIVEC).cast("long"))


def with_taxids(records: DataFrame, known: DataFrame, override: DataFrame | None = None, keep_unmapped: bool = False) -> DataFrame:
    """``records(accession, ...)`` with taxids: ``override`` before ``known``; those without one go, or get 0."""
    rows = records.join(known.select("accession", F.col("taxid").alias("_known")), "accession", "left")
    if override is not None:
        rows = rows.join(override.select("accession", F.col("taxid").alias("_own")), "accession", "left")
    else:
        rows = rows.withColumn("_own", F.lit(None).cast("long"))
    rows = rows.withColumn("taxid", F.coalesce("_own", "_known")).drop("_own", "_known")
    return rows.fillna(0, ["taxid"]) if keep_unmapped else rows.where("taxid IS NOT NULL")


def genome_files(paths: DataFrame) -> DataFrame:
    """``paths(path)`` of genome files: extension ``fna``, name not beginning with ``_``."""
    name = F.element_at(F.split("path", "/"), -1)
    return paths.where(name.rlike(r"\.fna$") & ~name.startswith("_"))


def manifest(files: DataFrame) -> DataFrame:
    """``(assembly, source, taxid, bytes, sha256)`` of ``files(assembly, source, taxid, content)``."""
    return files.select("assembly", "source", "taxid", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    """Name, length and digest of each file of a folder."""
    rows = spark.read.format("binaryFile").load(folder)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("source"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def ingest_stats(records: DataFrame) -> DataFrame:
    """``(domain, records, bases, unmapped)`` of ``records(domain, seq, taxid)``."""
    return records.groupBy("domain").agg(F.count("*").alias("records"), F.sum(F.length("seq").cast("long")).alias("bases"), F.count(F.when(F.coalesce("taxid", F.lit(0)) == 0, 1)).alias("unmapped"))


# -- reports of classifiers


def clade_report(lines: DataFrame) -> DataFrame:
    """``(taxid, name, reads)`` of six tab-separated columns: percent, reads of the clade, own reads, rank, taxid, name."""
    p = F.split("value", "\t")
    rows = lines.where(F.size(p) >= 6).select(F.col("value"), F.get(p, F.lit(4)).try_cast("long").alias("taxid"), F.trim(F.get(p, F.lit(5))).alias("name"), F.trim(F.get(p, F.lit(1))).try_cast("long").alias("reads"))
    return rows.where("taxid IS NOT NULL").drop("value")


def target_report(lines: DataFrame) -> DataFrame:
    """``(taxid, reads)`` of a report of this library, of three columns or four; rows whose id isn't a number are dropped."""
    p = F.split("value", "\t")
    reads = F.when(F.size(p) >= 4, F.element_at(p, -2)).otherwise(F.get(p, F.lit(1)))
    rows = lines.select(F.get(p, F.lit(0)).try_cast("long").alias("taxid"), reads.try_cast("long").alias("reads"))
    return rows.where("taxid IS NOT NULL AND reads IS NOT NULL")


def exact_reads(lines: DataFrame) -> DataFrame:
    """``(taxid, reads)`` summed over ``lines(value)`` of reports: the reads that a taxon has itself, not those below it.

    Of six columns or more the third counts, if it is above 0 and the first is a number; of three the second, for each of
    the ids that the first lists with commas. Headings, other lines and ids that aren't numbers are left out.
    """
    p = F.split("value", "\t")
    field = lambda i: F.trim(F.get(p, F.lit(i)))
    listed, clade = F.size(p) == 3, (F.size(p) >= 6) & field(0).rlike(r"^[0-9.]*[0-9][0-9.]*$")
    ids = F.when(listed, F.split(field(0), ",")).when(clade, F.array(field(4)))
    reads = F.when(listed, field(1)).otherwise(field(2)).try_cast("long")
    rows = lines.select(F.explode(ids).alias("id"), reads.alias("reads"), listed.alias("listed")).where("reads IS NOT NULL AND (listed OR reads > 0)")
    rows = rows.select(F.trim("id").try_cast("long").alias("taxid"), "reads").where("taxid IS NOT NULL")
    return rows.groupBy("taxid").agg(F.sum("reads").alias("reads"))


def total_reads(lines: DataFrame) -> DataFrame:
    """``(sample, total_reads)`` of ``lines(sample, value)`` of per-read files: their lines that aren't blank."""
    return lines.where(F.col("value").rlike(r"\S")).groupBy("sample").agg(F.count("*").alias("total_reads"))


def per_read_output(lines: DataFrame) -> DataFrame:
    """``(status, read_id, taxid, length, pattern)`` of per-read lines; the id is the first word of the header."""
    p = F.split("value", "\t")
    rows = lines.where(F.size(p) >= 5)
    return rows.select(F.get(p, F.lit(0)).alias("status"), first_token(F.get(p, F.lit(1))).alias("read_id"), F.get(p, F.lit(2)).alias("taxid"), F.get(p, F.lit(3)).alias("length"), F.get(p, F.lit(4)).alias("pattern"))


def concentration(name):
    """``D<digits>`` after an underscore, else ``N/A``."""
    found = F.regexp_extract(name, r"_(D\d+)", 1)
    return F.when(found == "", "N/A").otherwise(found)


def is_control(name):
    """Whether a sample's name has the part ``NC``."""
    return name.rlike(r"(?i)(?:^|_)NC(?:_|$)")


def clean_name(path, tools: tuple[str, ...] = ()):
    """A file's name without folders, report extensions and tool suffixes, however many follow each other."""
    name = F.element_at(F.split(path, "/"), -1)
    suffix = r"\.(?:report|kreport|txt|tsv|csv)" + "".join(rf"|[._-]{t}" for t in tools)
    return F.regexp_replace(name, rf"(?i)(?:{suffix})+$", "")


def expected_taxon(name, aliases: dict[str, int]):
    """The taxid of the longest alias that a sample's name has in it."""
    out = F.lit(None).cast("long")
    for alias in sorted(aliases, key=len):
        out = F.when(F.contains(F.lower(name), F.lit(alias.lower())), F.lit(aliases[alias])).otherwise(out)
    return F.when(is_control(name), F.lit(None)).otherwise(out)

