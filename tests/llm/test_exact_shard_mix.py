"""Exact duplicates, sharding and mixing on small tables with nulls, ties and repeats."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandex.llm import exact, mixing, sharding

SCHEMA = "doc_id long, text string, source string, size string, digest string, rate string"
ROWS = [
    (1, "a", "s", "x", "y", "z"), (2, "a", "s", None, None, None), (2, "a", "s", None, None, None), (9, None, None, None, None, None),
    (4, "", "t", None, None, None), (None, "b", "t", None, None, None), (None, None, "t", None, None, None), (7, "A", "s", None, None, None), (8, "é" * 40000, "s", None, None, None),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def test_exact(spark):
    got = exact.exact_duplicates(frame(spark)).collect()
    groups = defaultdict(list)
    for r in ROWS:
        groups[r[1] or ""].append(r[0])
    want = []
    for r in ROWS:
        ids = groups[r[1] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert Counter(map(tuple, got)) == Counter(want)
    assert exact.exact_duplicates(frame(spark, [])).count() == 0


def test_exact_keeps_texts_of_one_digest_apart(spark, monkeypatch):
    real = exact.F.sha2
    monkeypatch.setattr(exact.F, "sha2", lambda c, n: F.substring(real(c, n), 1, 1) if n == 256 else real(c, n))
    monkeypatch.setattr(exact.F, "unhex", lambda c: c)
    monkeypatch.setattr(exact.F, "hex", lambda c: c)
    rows = [(i, f"t{i % 40}", None, None, None, None) for i in range(120)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_duplicates(frame(spark, rows)).collect()}
    assert got == {i: (80 + i % 40, 3) for i in range(120)}


def test_shards(spark):
    rows = ROWS + [(100 + i, f"text {i}" * 30, "s", None, None, None) for i in range(400)]
    out = sharding.shard(frame(spark, rows), bucket_bytes=200, carry=["doc_id", "text", "digest"]).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw)) and r.grown_shard in (r.shard, 24)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(24))
    by_id = defaultdict(set)
    for r in out:
        by_id[r.doc_id].add((r.shard, r.grown_shard))
    assert all(len(v) == 1 for v in by_id.values())
    one = [r.doc_id for r in sorted(out, key=lambda r: r.slot) if r.shard == 3]
    assert one != sorted(one, key=lambda x: x or 0)
    again = {(r.doc_id, r.text): r.slot for r in sharding.shard(frame(spark, rows), bucket_bytes=200, carry=["doc_id", "text"]).collect()}
    assert again == {(r.doc_id, r.text): r.slot for r in out}
    assert sharding.shard(frame(spark, [])).count() == 0


def test_write_shards(spark, tmp_path):
    out = sharding.shard(frame(spark), carry=["doc_id", "text"])
    sharding.write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(ROWS)


@pytest.mark.parametrize("rate", [0.3, 2.0, 1200.0])
def test_replicas_invert_poisson(spark, rate):
    ids = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(1).alias("__u2"))
    rates = spark.createDataFrame([("s", rate), ("none", 0.0)], "source string, rate double")
    got = Counter(r.doc_id for r in mixing.replicate(ids, rates).collect())
    mean = sum(got.values()) / 300
    assert abs(mean - rate) < 5 * math.sqrt(rate / 300)
    if rate < 100:
        for i in range(300):
            u = int(hashlib.md5(f"29:{i}".encode()).hexdigest()[:13], 16) / 2**52
            n, term, total = 0, math.exp(-rate), math.exp(-rate)
            while total <= u:
                n += 1
                term *= rate / n
                total += term
            assert got[i] == n


def test_rates_and_weights(spark):
    docs = frame(spark)
    weights = spark.createDataFrame([("s", 3.0), (None, 1.0)], "source string, weight double")
    got = {r.source: r.rate for r in mixing.rates(docs, weights, total=90).collect()}
    assert got == {"s": pytest.approx(90 * 0.75 / 5), None: pytest.approx(90 * 0.25), "t": 0.0}
    assert mixing.mixed(spark, docs, "").columns == docs.columns
    assert mixing.mixed(spark, frame(spark, []), "").count() == 0


def many(spark, parts):
    rows = [(i % 2900, f"text {i % 2900} " * (i % 7), {"k": i % 5}) for i in range(3000)]  # some rows repeat
    return spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>").repartition(parts)


def slots(spark, parts, **conf):
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        return Counter((r.doc_id, r.text, r.tags["k"], r.shard, r.slot) for r in sharding.shard(many(spark, parts), shards=3, seed=5).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_slots_depend_on_seed_and_rows_alone(spark):
    base = slots(spark, 4)
    assert sum(base.values()) == 3000
    assert slots(spark, 16, **{"spark.sql.shuffle.partitions": "16"}) == base
    assert slots(spark, 3, **{"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "7"}) == base


def test_slots_against_plain_fisher_yates(spark):
    """Buckets gathered, sorted and shuffled in Python, with the same draws."""
    docs, seed, shards = many(spark, 4).drop("tags"), 5, 3
    total = docs.count()
    buckets = -(-total // (sharding.BUCKET_ROWS * shards))
    rows = docs.select(
        "doc_id", "text", sharding._best(F.col("doc_id"), shards, seed).alias("s"),
        F.pmod(F.xxhash64(F.lit(seed), F.lit("bucket"), "doc_id", "text"), F.lit(buckets)).alias("b"),
    ).collect()
    draws = {
        (r.s, r.b, r.i): r.d
        for r in spark.range(shards).selectExpr("CAST(id AS INT) AS s").crossJoin(spark.range(buckets).selectExpr("id AS b")).crossJoin(spark.range(1, 1024).selectExpr("CAST(id AS INT) AS i"))
        .select("s", "b", "i", F.pmod(F.xxhash64(F.lit(seed), "s", "b", F.lit(0), "i"), F.col("i") + 1).alias("d")).collect()
    }
    want = Counter()
    for s in range(shards):
        at = 0
        for b in range(buckets):
            own = sorted((r.doc_id, zlib.crc32(r.text.encode()), r.text) for r in rows if (r.s, r.b) == (s, b))
            for i in range(len(own) - 1, 0, -1):
                j = draws[s, b, i]
                own[i], own[j] = own[j], own[i]
            want += Counter((x[0], s, at + k) for k, x in enumerate(own))
            at += len(own)
    got = Counter((r.doc_id, r.shard, r.slot) for r in sharding.shard(docs, shards=shards, seed=seed).collect())
    assert got == want


def test_rows_that_repeat_too_often_for_a_bucket(spark):
    docs = spark.range(5000).selectExpr("1L AS doc_id", "'same' AS text")
    out = sharding.shard(docs, shards=2).collect()
    assert sorted(r.slot for r in out) == list(range(5000)) and len({r.shard for r in out}) == 1


def test_mixing_keeps_columns_of_any_name(spark):
    names = ["doc_id", "source", "text", "row", "copy", "order", "n", "u", "of", "parts", "cdf", "id", "__copy", "__n"]
    docs = spark.createDataFrame([(i, "s", "t", *[i] * 11) for i in range(50)], ", ".join(f"{c} {'string' if c in ('source', 'text') else 'long'}" for c in names))
    out = mixing.mixed(spark, docs, "")
    assert out.columns == names
    assert all(r["__n"] == r.doc_id and r.copy == r.doc_id for r in out.collect()) and out.count() > 20
    assert mixing.mixed(spark, docs.limit(0), "").count() == 0
