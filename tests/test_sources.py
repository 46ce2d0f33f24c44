"""Readers and writers over files, some of them compressed or split into many blocks."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from strandex.sources import archives, fastx


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_fasta(spark, tmp_path):
    text = ">a1 first one\nACGT\nAC\r\nGT\n>  \nAAAA\n>b2\n\n>c3 x\nTTTT\n"
    (tmp_path / "one.fna").write_text(text)
    with gzip.open(tmp_path / "two.fna.gz", "wt") as f:
        f.write(">z\nGG\nGG")
    rows = fastx.fasta(spark, [str(tmp_path / "one.fna"), str(tmp_path / "two.fna.gz")]).collect()
    got = {r.accession: (r.header, r.seq, r.no) for r in rows}
    assert got == {"a1": ("a1 first one", "ACGTACGT", 0), "c3": ("c3 x", "TTTT", 3), "z": ("z", "GGGG", 0)}
    assert fastx.fasta(spark, str(tmp_path / "one.fna"), keep_empty=True).count() == 3


def test_fasta_over_many_blocks(spark, tmp_path):
    records = [(f"r{i} t", "ACGT" * (1 + i % 50)) for i in range(2000)]
    frame = spark.createDataFrame(records, "header string, seq string").coalesce(1)
    fastx.write_fasta(frame, str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*"))
    assert max(map(len, part.read_text().split("\n"))) <= 80
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = fastx.fasta(spark, str(part))
        assert got.rdd.getNumPartitions() > 1
        assert [(r.header, r.seq) for r in got.orderBy("no").collect()] == records
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def fastq_text(n, seq="ACGT"):
    return "".join(f"@r{i} x\n{seq}\n+\n{'@' * len(seq)}\n" for i in range(n))


def test_fastq(spark, tmp_path):
    (tmp_path / "s_R1.fastq").write_text(fastq_text(1500) + "@empty\n\n+\n\n")
    rows = fastx.fastq(spark, str(tmp_path / "s_R1.fastq")).orderBy("no").collect()
    assert [r.header for r in rows] == [f"r{i} x" for i in range(1500)] and rows[0].quality == "@@@@"
    assert fastx.fastq(spark, str(tmp_path / "s_R1.fastq"), keep_empty=True).count() == 1501
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        again = fastx.fastq(spark, str(tmp_path / "s_R1.fastq"))
        assert again.orderBy("no").collect() == rows
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "bad.fastq").write_text("@a\nACGT\nx\nIIII\n")
    with pytest.raises(Exception, match="not a FASTQ record"):
        fastx.fastq(spark, str(tmp_path / "bad.fastq")).collect()


def test_mates_and_samples(spark, tmp_path):
    (tmp_path / "s_R1.fastq").write_text(fastq_text(5))
    with gzip.open(tmp_path / "s_R2.fastq.gz", "wt") as f:
        f.write(fastq_text(5, "GGGG"))
    (tmp_path / "t.fq").write_text(fastq_text(2))
    (tmp_path / "u_R2.fq").write_text(fastq_text(2))
    (tmp_path / "notes.txt").write_text("x")
    found = [(r.sample, r.r1 and r.r1.split("/")[-1], r.r2 and r.r2.split("/")[-1]) for r in fastx.discover(spark, str(tmp_path)).collect()]
    assert found == [("s", "s_R1.fastq", "s_R2.fastq.gz"), ("t", "t.fq", None)]
    pairs = fastx.reads(spark, str(tmp_path / "s_R1.fastq"), str(tmp_path / "s_R2.fastq.gz"))
    assert sorted((r.read_id, r.mate, r.seq) for r in pairs.collect()) == sorted((i, m, s) for i in range(5) for m, s in ((1, "ACGT"), (2, "GGGG")))
    with pytest.raises(ValueError, match="5 and 2"):
        fastx.reads(spark, str(tmp_path / "s_R1.fastq"), str(tmp_path / "t.fq"))


def test_taxonomy_dumps(spark, tmp_path):
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n20\t|\t2\t|\tx\t|\nbad\n")
    (tmp_path / "names.dmp").write_text("20\t|\tTwenty\t|\t\t|\tscientific name\t|\n20\t|\tother\t|\t\t|\tsynonym\t|\n30\t|\tThirty\t|\t\t|\tscientific name\t|\n")
    (tmp_path / "targets.txt").write_text(" 20 \n1\nx\n20\n40")
    targets = archives.targets(spark, str(tmp_path / "targets.txt"))
    assert sorted(r.taxid for r in targets.collect()) == [20, 40]
    assert sorted(tuple(r) for r in archives.nodes(spark, str(tmp_path / "nodes.dmp")).collect()) == [(1, 1), (20, 2)]
    names = {r.taxid: r.name for r in archives.names(spark, str(tmp_path / "names.dmp"), targets).collect()}
    assert names[20] == "Twenty" and 30 not in names and names[2] == "Bacteria" and len(names) == 7


def test_accessions(spark, tmp_path):
    (tmp_path / "map.txt").write_text("accession\ttaxid\na\t1\n\nb\t2\na\t3\n")
    assert {r.accession: r.taxid for r in archives.accession_map(spark, str(tmp_path / "map.txt")).collect()} == {"a": 3, "b": 2}
    (tmp_path / "gb").write_text("accession\taccession.version\ttaxid\tgi\na\ta.1\t5\t0\nc\tc.1\t9\t0\n")
    (tmp_path / "wgs").write_text("accession\taccession.version\ttaxid\tgi\na\ta.1\t6\t0\nb\tb.1\t7\t0\nb\tb.1\t8\t0\n")
    wanted = spark.createDataFrame([("a.1",), ("b.1",), ("x",)], "accession string")
    got = archives.accession2taxid(spark, [str(tmp_path / "gb"), str(tmp_path / "wgs")], wanted)
    assert {r.accession: r.taxid for r in got.collect()} == {"a.1": 5, "b.1": 7}


def test_assemblies_and_listing(spark):
    def row(acc, level, folder, submitter="x", taxid="7"):
        cols = ["."] * 20
        cols[0], cols[5], cols[11], cols[16], cols[19] = acc, taxid, level, submitter, folder
        return "\t".join(cols)

    rows = lines(
        spark, "# head", row("A", "Complete Genome", "https://h/x/A_1"), row("B", "Scaffold", "https://h/x/B"), row("C", "Chromosome", "na"), row("D", "Chromosome", "https://h/D", "Genome Reference Consortium"),
        row("E", "Chromosome", "https://h/E", taxid="?"), "short",
    )
    assert sorted((r.assembly, r.taxid, r.path) for r in archives.assembly_rows(rows).collect()) == [("A", 7, "/x/A_1/A_1_genomic.fna.gz"), ("D", 7, "/D/D_genomic.fna.gz")]
    assert [r.assembly for r in archives.assembly_rows(rows, human=True).collect()] == ["D"]
    page = spark.createDataFrame([('<a href="viral.2.1.genomic.fna.gz">viral.2.1.genomic.fna.gz</a> <a href="/x/viral.1.genomic.fna.gz"> <a href="other.1.genomic.fna.gz">',)], "html string")
    assert [r.file for r in archives.listing(page, "viral").collect()] == ["viral.1.genomic.fna.gz", "viral.2.1.genomic.fna.gz"]
    with pytest.raises(ValueError):
        archives.listing(page, "plasmid")


def test_taxids_files_and_manifest(spark, tmp_path):
    records = spark.createDataFrame([("a", "AC"), ("b", "G"), ("c", "T")], "accession string, seq string")
    known = spark.createDataFrame([("a", 1), ("b", 2)], "accession string, taxid long")
    own = spark.createDataFrame([("b", 9)], "accession string, taxid long")
    assert {r.accession: r.taxid for r in archives.with_taxids(records, known, own).collect()} == {"a": 1, "b": 9}
    assert {r.accession: r.taxid for r in archives.with_taxids(records, known, keep_unmapped=True).collect()} == {"a": 1, "b": 2, "c": 0}
    assert archives.vector_sequences(records).first().taxid == 28384
    paths = spark.createDataFrame([("/x/a.fna",), ("/x/_b.fna",), ("/x/c.txt",)], "path string")
    assert [r.path for r in archives.genome_files(paths).collect()] == ["/x/a.fna"]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "one").write_bytes(b"abc")
    got = archives.manifest_of(spark, str(tmp_path / "f")).first()
    assert (got.source, got.bytes, got.sha256) == ("one", 3, hashlib.sha256(b"abc").hexdigest())


def test_reports(spark):
    clade = lines(spark, "50.0\t10\t3\tS\t77\t  Name x", "bad", "1\tx\t1\tS\t78\tn")
    assert [tuple(r) for r in archives.clade_report(clade).collect()] == [(77, "Name x", 10), (78, "n", None)]
    ours = lines(spark, "Target_TaxID\tName\tRead_Count\tRatio", "5\tFive\t12\t0.5", "Ambiguous\t\t\t3\t0.1", "6\t7\t0.2")
    assert sorted(tuple(r) for r in archives.target_report(ours).collect()) == [(5, 12), (6, 7)]
    out = archives.per_read_output(lines(spark, "C\tr1 x\t5\t50|40\t5:1 |:| 0:3 ", "short")).collect()
    assert [(r.status, r.read_id, r.taxid) for r in out] == [("C", "r1", "5")]


def test_sample_names(spark):
    rows = spark.createDataFrame([("/d/Flu_A_D3_kraken2.report.txt",), ("x_NC_1.tsv",), ("NCx.csv",)], "p string")
    clean = archives.clean_name(F.col("p"), ("kraken2?",))
    got = rows.select(clean.alias("n"), archives.concentration(F.col("p")).alias("c"), archives.is_control(clean).alias("nc"), archives.expected_taxon(clean, {"flu": 1, "flu_a": 2}).alias("t")).collect()
    assert [tuple(r) for r in got] == [("Flu_A_D3", "D3", False, 2), ("x_NC_1", "N/A", True, None), ("NCx", "N/A", False, None)]


def test_exact_reads_of_both_kinds_of_report(spark):
    lines = ["Target_TaxID\tReads\tx", "5,6\t3\tx", " 6 \t4\tx", "7\tno\tx", "a,8\t2\tx", "", "1.5\t90\t2\tS\t5\t  name", "1\t90\t0\tS\t9\tn", "%\t90\t2\tS\t9\tn"]
    got = archives.exact_reads(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {(r.taxid, r.reads) for r in got.collect()} == {(5, 5), (6, 7), (8, 2)}


def test_total_reads_count_lines_that_are_not_blank(spark):
    rows = [("a", "C\tr1"), ("a", ""), ("a", " \t"), ("a", "U\tr2"), ("b", None), ("b", "C")]
    got = archives.total_reads(spark.createDataFrame(rows, "sample string, value string"))
    assert {(r.sample, r.total_reads) for r in got.collect()} == {("a", 2), ("b", 1)}
