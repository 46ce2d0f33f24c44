"""Minimizers, hashes and sequence functions against plain models."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandex.constants import seed_mask, toggle_of
from strandex.functions import hashing, sequence
from strandex.operators import minimizers

CODE = {c: i for i, c in enumerate("ACGT")}


def plain(seq, k, l):
    """One value for each window, straight from the definition."""
    seq, out = seq.upper(), []
    for i in range(k - 1, len(seq)):
        run = 0
        while run <= i and seq[i - run] in CODE:
            run += 1
        best = None
        if run >= k - 1 and seq[i] in CODE:
            for p in range(max(i + 1 - k, i + 1 - run), i + 2 - l):
                f = r = 0
                for j, c in enumerate(seq[p : p + l]):
                    f = f << 2 | CODE[c]
                    r |= (3 - CODE[c]) << 2 * j
                v = (min(f, r) & seed_mask()) ^ toggle_of(l)
                best = v if best is None else min(best, v)
        out.append(None if best is None else best ^ toggle_of(l))
    return out


def plain_runs(values):
    out = []
    for v in values:
        if out and out[-1][0] == v:
            out[-1][1] += 1
        else:
            out.append([v, 1])
    return [tuple(x) for x in out]


def sequences(k):
    rnd = random.Random(k)
    made = ["", "A", "A" * (k - 1), "C" * k, "ACGT" * k, "N" * k, "N" + "G" * (k - 1), "g" * (k - 1) + "N", "T" * k + "N" + "T" * (k - 1), "x" * 3 + "ACGT" * 20]
    for _ in range(40):
        made.append("".join(rnd.choice("ACGTacgt" + "N" * (rnd.random() < 0.4)) for _ in range(rnd.choice([k - 1, k, k + 1, 60, 300]))))
    return made


@pytest.mark.parametrize(("k", "l"), [(35, 31), (15, 11), (5, 5), (7, 3), (31, 31), (40, 16), (12, 1)])
def test_runs_against_definition(spark, k, l):
    seqs = sequences(k)
    frame = spark.createDataFrame([(i, s) for i, s in enumerate([*seqs, None])], "id int, s string").repartition(3)
    got = {r.id: [tuple(x) for x in r.r] for r in frame.select("id", minimizers.runs("s", k, l).alias("r")).collect()}
    assert got == {i: plain_runs(plain(s or "", k, l)) for i, s in enumerate([*seqs, None])}


def test_array_functions_agree(spark):
    seqs = [s for s in sequences(15) if len(s) < 80]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "id int, s string")
    got = {r.id: r.w for r in frame.select("id", sequence.windows(F.col("s"), 15, 11).alias("w")).collect()}
    assert got == {i: plain(s, 15, 11) for i, s in enumerate(seqs)}


def test_segments_lose_and_repeat_nothing(spark):
    rnd = random.Random(1)
    seqs = ["".join(rnd.choice("ACGT") for _ in range(n)) for n in (0, 10, 14, 15, 16, 29, 30, 31, 100, 999)]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "id int, seq string")
    cut = frame.select("id", F.inline(sequence.segments(F.col("seq"), 15, 30)))
    pieces = {}
    for r in cut.orderBy("id", "start").collect():
        pieces.setdefault(r.id, []).append(plain(r.bases, 15, 11))
    assert {i: sum(p, []) for i, p in pieces.items()} == {i: plain(s, 15, 11) for i, s in enumerate(seqs)}
    whole = {tuple(r) for r in minimizers.distinct_minimizers(frame, "id", k=15, l=11).collect()}
    assert whole == {tuple(r) for r in minimizers.distinct_minimizers(frame, "id", k=15, l=11, segment=40).collect()}


def test_reverse_complement_gives_reversed_values():
    rnd = random.Random(2)
    seq = "".join(rnd.choice("ACGT") for _ in range(200))
    other = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    run = lambda s: minimizers.window_values(np.frombuffer(s.encode(), dtype=np.uint8)).tolist()
    assert run(seq) == run(other)[::-1]


def test_hashes(spark):
    rnd = random.Random(3)
    xs = [0, 1, 2**62 - 1, 2**63 - 1, -1, -(2**63)] + [rnd.getrandbits(64) - 2**63 for _ in range(200)]
    m = 2**64

    def fold(x, n):
        return x ^ (x >> n)

    def fmix(x):
        return fold(fold(fold(x, 33) * hashing.FIRST % m, 33) * hashing.SECOND % m, 33)

    def second(x):
        return fold(fold(fold(x, 31) * hashing.SMALL_FIRST % m, 13) * hashing.SMALL_SECOND % m, 16) | 1

    one, two = hashing.bloom_pair(F.col("x"))
    frame = spark.createDataFrame([(x,) for x in xs], "x long")
    rows = frame.select("x", hashing.fingerprint(F.col("x")).alias("a"), hashing.fingerprint(F.col("x"), 32).alias("b"), one.alias("c"), two.alias("d")).collect()
    for r in rows:
        x = r.x % m
        short = fold(fold(x, 33) * hashing.FIRST % m, 33)
        assert (r.a, r.b, r.c % m, r.d % m) == (short % 2**16, short % 2**32, fmix(x), second(x))
    bits = hashing.bloom_positions(frame.distinct(), "x", 1009, 5).groupBy("x").agg(F.collect_list("p").alias("p")).collect()
    for r in bits:
        assert sorted(r.p) == sorted((fmix(r.x % m) % 1009 + i * (second(r.x % m) % 1009)) % 1009 for i in range(5))


def test_bloom_size():
    assert hashing.bloom_size(1000, 0.0001) == (19171, 13)


def test_small_functions(spark):
    row = spark.createDataFrame([("acGTx", ">id", "  id two", "kraken:taxid|77|x", "A" * 161)], "s string, h string, t string, k string, w string").select(
        sequence.base_codes(F.col("s")).alias("codes"), sequence.mask_lower(F.col("s")).alias("masked"), sequence.first_token(F.col("t")).alias("token"),
        sequence.header_taxid(F.col("k")).alias("taxid"), sequence.wrap(F.col("w")).alias("wrapped"), hashing.vbyte(F.array(F.lit(3), F.lit(3 + 127), F.lit(3 + 127 + 300))).alias("v"),
        sequence.archive_path(F.lit("https://h.x/a/b/C_1/")).alias("path"),
    ).first()
    assert row.codes == "0123." and row.masked == "xxGTx" and row.token == "id" and row.taxid == 77
    assert row.wrapped == "A" * 80 + "\n" + "A" * 80 + "\nA" and row.path == "/a/b/C_1/C_1_genomic.fna.gz"
    assert bytes.fromhex(row.v) == bytes([3, 3, 127, 0xAC, 0x02])
