"""Building the index: LCA of the targets' minimizers, challenged by everything that isn't a target."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strandex.constants import CORE_DOMAINS, HUMAN, K, L
from strandex.operators import taxonomy
from strandex.operators.minimizers import distinct_minimizers


def placed(acc_taxid: DataFrame, paths: DataFrame) -> DataFrame:
    """``(accession, taxid)`` of accessions whose taxid is in the tree."""
    return acc_taxid.join(paths.select("taxid"), "taxid", "left_semi").select("accession", "taxid")


def target_accessions(acc_taxid: DataFrame, rolled: DataFrame) -> DataFrame:
    """``(accession, taxid, target)`` of accessions at or below a target."""
    return acc_taxid.join(rolled, "taxid").select("accession", "taxid", "target")


def split_by_targets(records: DataFrame, targets: DataFrame) -> DataFrame:
    """``records(accession, ...)`` with ``is_target``: whether the accession is a target's."""
    known = targets.select("accession", F.lit(True).alias("is_target")).distinct()
    return records.join(known, "accession", "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))


def lca_minimizers(target_records: DataFrame, tree: DataFrame, k: int = K, l: int = L) -> DataFrame:
    """``(minimizer, taxid)``: the LCA of the taxa of ``target_records(taxid, seq)`` that have the minimizer."""
    return taxonomy.lca_aggregate(distinct_minimizers(target_records, "taxid", k=k, l=l), ["minimizer"], tree)


def challenge(minimizers: DataFrame, background: DataFrame, k: int = K, l: int = L) -> DataFrame:
    """``minimizers(minimizer, ...)`` without those that occur in ``background(seq)``."""
    return minimizers.join(distinct_minimizers(background, k=k, l=l), "minimizer", "left_anti")


def build(
    records: DataFrame, acc_taxid: DataFrame, nodes: DataFrame, targets: DataFrame, genomes: DataFrame | None = None, k: int = K, l: int = L, challenged: bool = True
) -> DataFrame:
    """``(minimizer, taxid)`` from ``records(accession, seq)``.

    Records of target accessions give minimizers, labelled by the LCA of their taxa in the whole tree; those that
    occur in a record of any other accession (also one without a taxid) go; so do those whose LCA is neither a target
    nor below one; what stays is reported under the nearest target. ``genomes(accession, seq)`` is what challenges
    (``records`` itself by default). Records are told apart before they are scanned.
    """
    paths = taxonomy.lineages(nodes)
    tree = taxonomy.numbered(paths)
    rolled = taxonomy.rollup(paths, targets)
    own = target_accessions(acc_taxid, rolled)
    labels = own.select("accession", "taxid") if genomes is None else placed(acc_taxid, paths)
    kept = lca_minimizers(records.join(labels, "accession").select("taxid", "seq"), tree, k, l)
    if challenged:
        others = (records if genomes is None else genomes).join(own, "accession", "left_anti").select("seq")
        kept = challenge(kept, others, k, l)
    return kept.join(rolled, "taxid").select("minimizer", F.col("target").alias("taxid"))


def accession_ids(own: DataFrame, paths: DataFrame) -> DataFrame:
    """``(acc_id, accession)``: target accessions in the order of the lineages that report them, then by name.

    Accessions of the human taxid are not tracked. Numbers are given from 0, in ranges: no task sorts them all.
    """
    tracked = own.where(F.col("taxid") != HUMAN).select("accession", F.col("target").alias("taxid")).distinct()
    return _row_numbers(tracked.join(paths, "taxid"), ["lineage", "accession"], "acc_id").select("acc_id", "accession")


def _row_numbers(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Consecutive numbers in a global order: counted for each first key, then added up over the keys."""
    first = order[0]
    counts = rows.groupBy(first).agg(F.count("*").alias("n"))
    before = counts.select(first, (F.sum("n").over(Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    within = F.row_number().over(Window.partitionBy(first).orderBy(*order[1:]))
    numbered = rows.withColumn("_within", within).join(before, first)
    return numbered.withColumn(name, (F.coalesce("before", F.lit(0)) + F.col("_within") - 1).cast("int")).drop("_within", "before")


def accession_sets(target_records: DataFrame, index: DataFrame, ids: DataFrame, k: int = K, l: int = L) -> DataFrame:
    """``(minimizer, acc_ids)``: the sorted ids of the accessions of ``target_records(accession, seq)`` with each minimizer of the index."""
    found = distinct_minimizers(target_records.join(ids, "accession").select("acc_id", "seq"), "acc_id", k=k, l=l)
    kept = found.join(index.select("minimizer"), "minimizer", "left_semi")
    return kept.groupBy("minimizer").agg(F.array_sort(F.collect_set("acc_id")).alias("acc_ids"))


def equivalence_classes(sets: DataFrame) -> DataFrame:
    """``(class_id, acc_ids, minimizers)``: the different sets, numbered from 1 by their ids (0 is the empty set)."""
    counts = sets.groupBy("acc_ids").agg(F.count("*").alias("minimizers"))
    first = counts.withColumn("first", F.col("acc_ids")[0])
    return _row_numbers(first, ["first", "acc_ids"], "n").select((F.col("n") + 1).alias("class_id"), "acc_ids", "minimizers")


def save(index: DataFrame, path: str, k: int = K, l: int = L) -> None:
    """The index as Parquet, beside a table of one row with its parameters."""
    index.write.mode("overwrite").parquet(f"{path}/index")
    index.sparkSession.sql(f"SELECT {int(k)} AS k, {int(l)} AS l").write.mode("overwrite").parquet(f"{path}/meta")


def load(spark, path: str) -> tuple[DataFrame, int, int]:
    """The index and its parameters; an index without a minimizer is an error."""
    meta = spark.read.parquet(f"{path}/meta").first()
    index = spark.read.parquet(f"{path}/index")
    if index.isEmpty():
        raise ValueError("the index has no minimizers")
    return index, meta.k, meta.l


def inspect(index: DataFrame, names: DataFrame) -> DataFrame:
    """``(taxid, name, minimizers, ratio)``: the composition of an index, by number of minimizers."""
    counts = index.groupBy("taxid").agg(F.count("*").alias("minimizers"))
    shares = counts.withColumn("total", F.sum("minimizers").over(Window.partitionBy()))  # a row a taxon
    return shares.join(names, "taxid", "left").select("taxid", F.coalesce("name", F.lit("Unknown")).alias("name"), "minimizers", (F.col("minimizers") / F.col("total")).alias("ratio"))


def with_total(composition: DataFrame) -> DataFrame:
    """The lines of an inspection file: the totals, then the taxa."""
    total = composition.agg(F.sum("minimizers").alias("n")).select(F.lit("Total").alias("TaxID"), F.lit("").alias("Name"), F.coalesce("n", F.lit(0)).alias("Minimizer_Count"), F.lit("1").alias("Ratio"))
    rows = composition.orderBy(F.desc("minimizers"), "taxid").select(
        F.col("taxid").cast("string").alias("TaxID"), F.col("name").alias("Name"), F.col("minimizers").alias("Minimizer_Count"), F.format_string("%.4f", "ratio").alias("Ratio")
    )
    return total.unionByName(rows)


def core_names(names: DataFrame) -> DataFrame:
    """``names(taxid, name)`` with the core domains, whose names are fixed."""
    from strandex.constants import CORE_NAMES

    pairs = F.array(*[F.struct(F.lit(t).cast("long").alias("taxid"), F.lit(CORE_NAMES[t]).alias("name")) for t in CORE_DOMAINS])
    core = names.sparkSession.range(1).select(F.inline(pairs))
    return names.select("taxid", "name").join(core, "taxid", "left_anti").unionByName(core)
