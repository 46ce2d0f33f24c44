"""Reads looked up by packed shuffles against the lookup by rows."""

import pytest

from strandex.operators import classify, domains, minimizers, packed, taxonomy
from tests.test_engine import KK, LL, TARGETS, built, tree, world  # noqa: F401


def rows(frame, columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("fallback", [False, True])
def test_packed_lookup(spark, tree, built, fallback, monkeypatch):  # noqa: F811
    records, taxa, _ = world()
    monkeypatch.setattr(packed, "HELD", 60)
    monkeypatch.setattr(packed, "BATCH", 200)
    frame = spark.createDataFrame([(taxa.get(a), ["bacteria", "viral", "fungi", "other", None][i % 5], s) for i, (a, s) in enumerate(records)] + [(None, None, None)], "taxid long, domain string, seq string")
    rolled = taxonomy.rollup(tree[1], built[2])
    reads = built[4].unionByName(spark.createDataFrame([(900, 1, "h", None), (901, 2, "h", "ACG"), (902, 1, "h", "N" * 40)], built[4].schema))
    assert packed.simple(tree[1])
    taxa_found, given = packed.found(reads, frame, tree[1], rolled, fallback, True, KK, LL)
    other = domains.fallback(domains.domain_minimizers(frame.select("domain", "seq"), KK, LL)) if fallback else None
    found = classify.lookup(minimizers.read_runs(reads, KK, LL), built[3], other).cache()
    assert rows(taxa_found, ["taxid"]) == rows(built[3].select("taxid").distinct(), ["taxid"])
    columns = ["read_id", "taxid", "weight", "groups", "background_groups"]
    want = rows(classify.hit_weights(found), columns)
    assert rows(packed.hit_weights(given), columns) == want and len({r[1] for r in want}) > 2
    assert rows(packed.patterns(given), ["read_id", "pattern"]) == rows(classify.patterns(found), ["read_id", "pattern"])


def test_mixed_numbers_come_back():
    import numpy as np

    from strandex.constants import seed_mask

    for l in (5, 11, 31):
        values = np.random.default_rng(1).integers(0, 1 << 62, 1000, dtype=np.uint64) & np.uint64(seed_mask() & ((1 << 2 * l) - 1))
        mixed = minimizers.mixed_of(values, l)
        assert (minimizers.unmixed(mixed, l) == values).all() and int(mixed.max()) < 1 << minimizers.mixed_bits(l)


def test_taxid_of_domains(spark):
    from pyspark.sql import functions as F

    from strandex.constants import DOMAIN_GROUPS

    sets = [(m, sorted(t for i, t in enumerate(DOMAIN_GROUPS.values()) if m >> i & 1)) for m in range(1, 16)]
    got = spark.createDataFrame(sets, "m int, t array<long>").select("m", taxonomy.domain_lca(F.col("t")).alias("x")).collect()
    assert {r.m: r.x for r in got} == {m: packed._taxid_of_mask(m) for m, _ in sets}
