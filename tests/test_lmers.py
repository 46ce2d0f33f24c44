"""The codes of all l-mers of whole records against brute force."""

import os
from functools import reduce
from operator import xor

import pytest

from strandex.constants import seed_mask, toggle_of
from strandex.plans import registry, tables

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_lmer_codes_of_whole_records(spark):
    want = {}
    for r in tables.dna(spark, FOLDER).select("read_id", "seq").collect():
        codes = ["ACGT".find(c) for c in r.seq.upper()]
        found = []
        for i in range(len(codes) - 30):
            part = codes[i : i + 31]
            pair = part, [3 - c for c in reversed(part)]
            found.append(None if -1 in part else min(reduce(lambda x, c: x * 4 + c, p, 0) for p in pair))
        if found:
            valid = [x for x in found if x is not None]
            seen = [x & seed_mask() ^ toggle_of(31) for x in valid]
            ends = [v for some in (valid, seen) for v in ((min(some), max(some), reduce(xor, some)) if some else (None,) * 3)]
            want[r.read_id] = (len(found), len(valid), *ends)
    got = {r.read_id: tuple(r)[1:] for r in registry.queries()["lmer_codes"](spark, FOLDER).collect()}
    assert got == want and max(v[0] for v in want.values()) > 10_000


def test_lmer_summary_against_column_functions(spark):
    from pyspark.sql import functions as F

    from strandex.functions import sequence
    from strandex.operators import minimizers

    rows = [(1, "ACGTTGCAACGTAGCTNAGCATCGATCGACTAGCATcagCATCGACTACG"), (2, "N" * 50), (3, "ACG"), (4, None), (5, ""), (6, "T" * 31), (7, "acgtNNNNacgtacgtgcatt")]
    frame = spark.createDataFrame(rows, "id long, seq string")
    for l in (1, 11, 31):
        got = {r.id: tuple(r)[1:] for r in frame.select("id", minimizers.lmer_summary("seq", l).alias("s")).select("id", "s.*").collect()}
        each = frame.where(f"length(seq) >= {l}").select("id", F.explode(F.sequence(F.lit(1), F.length("seq") - l + 1)).alias("p"), "seq")
        each = each.select("id", F.substr("seq", "p", F.lit(l)).alias("m")).select("id", sequence.canonical(F.col("m")).alias("a"), sequence.candidate(F.col("m"), l).alias("b"))
        want = each.groupBy("id").agg(F.count("*"), F.count("a"), *[f(c) for c in "ab" for f in (F.min, F.max, F.bit_xor)])
        want = {r[0]: tuple(r)[1:] for r in want.collect()}
        assert got == {i: want.get(i, (0, 0) + (None,) * 6) for i, _ in rows}


def test_lmer_codes_make_no_row_an_lmer(spark):
    plan = registry.queries()["lmer_codes"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "lmer_summary" in plan or "ArrowEvalPython" in plan
