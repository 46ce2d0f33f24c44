"""Blocks of the scan, summaries of records, and minimizers shuffled as packed differences."""

import random
import tracemalloc
from collections import defaultdict

import pyarrow as pa

from strandex.operators import domains, minimizers


def test_scan_of_a_batch_takes_bounded_memory():
    rnd = random.Random(3)
    one = "".join(rnd.choice("ACGT") for _ in range(30_000))
    batch = pa.array([one, None, "", "ACGTN"] * 100)
    tracemalloc.start()
    lists = minimizers._run_lists(batch, 35, 31)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(one) * 100  # a scan of the whole batch at once takes more than 100 bytes a base
    assert len(lists) == len(batch) and lists[0] == lists[396] and len(lists[1]) == len(lists[2]) == len(lists[3]) == 0
    assert lists[0] == minimizers._run_lists(pa.array([one]), 35, 31)[0]


def test_key_sets(spark, monkeypatch):
    monkeypatch.setattr(minimizers, "HELD", 50)
    rnd = random.Random(4)
    rows = [(rnd.choice(["viral", "fungi", "other", None]), "".join(rnd.choice("ACGTN" if i % 5 == 0 else "ACGT") for _ in range(rnd.choice([0, 20, 60, 300])))) for i in range(60)]
    rows += [("bacteria", rows[7][1]), ("fungi", rows[11][1]), ("other", rows[13][1]), (None, None)]
    frame = spark.createDataFrame(rows, "domain string, seq string")
    pairs = domains.domain_minimizers(frame).cache()
    want = defaultdict(set)
    for r in pairs.collect():
        want[r.minimizer].add(r.domain)
    sets = domains.domain_sets(frame).cache()
    got = sets.collect()
    assert len(got) == len(want) and all(r.domains == sorted(want[r.minimizer], key=lambda x: (x is None, x)) for r in got)
    for new, old in ((domains.exclusive_of(sets), domains.exclusive(pairs)), (domains.fallback_of(sets), domains.fallback(pairs))):
        assert sorted(map(tuple, new.select(*old.columns).collect())) == sorted(map(tuple, old.collect()))


def test_summary_counts_each_record(spark):
    frame = spark.createDataFrame([(1, "ACGTTGCAACGTAGCTAGCATCGATCGACTAGCATCAGCATCGACTACG" * 2), (2, "N" * 50), (3, "ACG"), (4, None)], "id long, seq string")
    got = {r.id: r for r in frame.select("id", minimizers.summary("seq").alias("s")).select("id", "s.*").collect()}
    runs = {r.id: r.r for r in frame.select("id", minimizers.runs("seq").alias("r")).collect()}
    for i, r in got.items():
        some = [x.minimizer for x in runs[i] or [] for _ in range(x.len) if x.minimizer is not None]
        mixed = None
        for x in some:
            mixed = x ^ (mixed or 0)
        assert (r.windows, r.with_one, r.different) == (sum(x.len for x in runs[i] or []), len(some), len(set(some)))
        assert (r.least, r.greatest, r.mixed) == (min(some, default=None), max(some, default=None), mixed)


def test_scan_counts_records_of_one_id_together(spark, tmp_path):
    from strandex.plans import registry

    rnd = random.Random(6)
    text = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    shared = text(200)
    rows = [(1, shared, "en", "s"), (2, text(90), "en", "s"), (2, shared, "de", "s"), (3, "short", "en", "s"), (4, None, "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0,)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r.read_id: r for r in registry.queries()["minimizer_scan"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2} and got[2].different > got[1].different and got[2].windows > got[1].windows
