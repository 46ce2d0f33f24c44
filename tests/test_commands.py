"""The commands end to end on files, and masking against its definition."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandex.operators import masking
from strandex.plans import commands
from strandex.sources import sinks


def read(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*"))).splitlines()


@pytest.fixture(scope="module")
def sample():
    rnd = random.Random(5)
    one = "".join(rnd.choice("ACGT") for _ in range(982))
    two = "".join(rnd.choice("ACGT") for _ in range(400))
    return one, two, "".join(rnd.choice("ACGT") for _ in range(50))


def test_commands(spark, sample, tmp_path):
    one, two, noise = sample
    nodes = spark.createDataFrame([(1, 1), (10239, 1), (200, 10239), (300, 200), (400, 10239)], "taxid long, parent long")
    targets = spark.createDataFrame([(200,)], "taxid long")
    names = spark.createDataFrame([(200, "H subtype")], "taxid long, name string")
    records = spark.createDataFrame([("viral", "N1", "N1 a record", one), ("viral", "N2", "N2 other", two), ("viral", "N3", "N3", two)], "domain string, accession string, header string, seq string")
    known = spark.createDataFrame([("N1", 300), ("N2", 400)], "accession string, taxid long")
    made = commands.prepare(records, known, nodes, targets, str(tmp_path / "prep"), mask=False)
    assert {(r.accession, r.taxid, r.is_target) for r in made.collect()} == {("N1", 300, True), ("N2", 400, False)}
    assert commands.prepare(records.limit(0), known, nodes, targets, str(tmp_path / "prep")).count() == 2  # made already
    assert commands.prepare(records, known, nodes, targets.where("false"), str(tmp_path / "prep"), keep_unmapped=True).where("is_target").count() == 0
    db = str(tmp_path / "db")
    built = commands.build(spark.createDataFrame([("N1", 300, one), ("N2", 400, two)], "accession string, taxid long, seq string"), nodes, targets, db, accessions=True)
    assert {r.taxid for r in built.collect()} == {200}
    (tmp_path / "s_R1.fastq").write_text(f"@r1 x\n{one[100:150]}\n+\n{'I' * 50}\n@r2\n{noise}\n+\n{'I' * 50}\n")
    out = commands.query(spark, db, str(tmp_path / "s_R1.fastq"), str(tmp_path / "res"), nodes, names, accessions=True, strains=True)
    assert {r.read_id: (r.status, r.taxid) for r in out.collect()} == {0: ("C", 200), 1: ("U", None)}
    assert read(tmp_path / "res.report") == ["Target_TaxID\tName\tRead_Count\tRatio", "200\tH subtype\t1\t0.500"]
    strain = read(tmp_path / "res.strain")
    assert strain[0] == "Accession\tTotal_Hits\tUnique_Hits" and strain[1].split("\t")[0] == "N1" and strain[1].split("\t")[1] == strain[1].split("\t")[2]
    assert sorted(read(tmp_path / "res.output")) == ["C\tr1 x\t200\t50\t200-{N1}:16 ", "U\tr2\t0\t50\t0:16 "]
    assert read_inspect(spark, db, names, tmp_path)[1].startswith("Total\t\t")
    for bad in ({"strains": True}, {"accessions": True, "output": False}):
        with pytest.raises(ValueError):
            commands.query(spark, db, "x", "y", nodes, names, **bad)
    found = commands.build_domains(records.withColumn("domain", F.when(F.col("accession") == "N1", "bacteria").otherwise("viral")), str(tmp_path / "dom"))
    assert {r.domain for r in found.select("domain").distinct().collect()} == {"bacteria", "viral"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a_R1.fastq").write_text(f"@q\n{two[20:90]}\n+\n{'I' * 70}\n")
    many = commands.query_folder(spark, db, str(tmp_path / "in"), str(tmp_path / "all"), nodes, names, domain_path=str(tmp_path / "dom"), output=False)
    assert [(r.status, r.taxid) for r in many["a"].collect()] == [("C", 10239)]


def read_inspect(spark, db, names, tmp_path):
    commands.inspect(spark, db, names, str(tmp_path / "inspect"))
    return read(tmp_path / "inspect")


def test_records_by_domain(spark, tmp_path):
    rows = spark.createDataFrame([("viral", True, "a", "AC"), ("fungi", False, "b", "GT")], "domain string, is_target boolean, accession string, seq string")
    sinks.write_records(rows, str(tmp_path / "r"))
    assert (tmp_path / "r" / "domain=viral" / "is_target=true").is_dir() and spark.read.parquet(str(tmp_path / "r")).count() == 2


def plain_mask(seq, window, level):
    low = [False] * len(seq)
    size = min(window, len(seq))
    for i in range(len(seq) - size + 1 if size > 3 else 0):
        part = seq[i : i + size].upper()
        triplets = [part[j : j + 3] for j in range(size - 2) if set(part[j : j + 3]) <= set("ACGT")]
        pairs = sum(n * (n - 1) // 2 for n in (triplets.count(t) for t in set(triplets)))
        if 10 * pairs > level * (size - 3):
            low[i : i + size] = [True] * size
    return low


def test_masking(spark):
    rnd = random.Random(7)
    seqs = ["", "AC", "A" * 10, "A" * 100, "ACGTN" * 30]
    for _ in range(30):
        a, b, c = ("".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 90))) for _ in range(3))
        seqs.append(a + rnd.choice(["A", "AC", "AT", "ACG"]) * rnd.randint(1, 40) + b + "N" + c.lower())
    frame = spark.createDataFrame([(i, s) for i, s in enumerate([*seqs, None])], "i int, s string")
    got = {r.i: r.m for r in frame.select("i", masking.mask_low_complexity(F.col("s")).alias("m")).collect()}
    assert got.pop(len(seqs)) is None
    for i, s in enumerate(seqs):
        low = plain_mask(s, 64, 20)
        assert np.array_equal(masking.low_complexity(s), low)
        assert got[i] == "".join(c.lower() if m else c.upper() for c, m in zip(s, low))
