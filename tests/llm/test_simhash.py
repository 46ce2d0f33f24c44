"""SimHash: fingerprints, bit-sliced links and components against brute force."""

import random
import re

import numpy as np
import pyspark.sql.types as T
import xxhash

from strandex.llm import simhash

SCHEMA = "doc_id long, text string, lang string, fp string"


def plain(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def texts():
    rnd = random.Random(5)
    vocab = ["Alpha", "béta", "GAMMA", "delta,", "eps", "zêta", "eta", "theta"]
    out = [None, "", " \t\n", "one", "One", "one two three", "one two three", "x " * 30, "ÀB cd\x0bef"]
    for _ in range(60):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([5, 40, 400]))]
        out.append(" ".join(base))
        for _ in range(rnd.randrange(4)):
            copy = list(base)
            copy[rnd.randrange(len(copy))] = "edited"
            out.append("  ".join(copy))
    return out + out[9:15]


def test_fingerprints_and_components(spark):
    rows = texts()
    got = simhash.near_duplicates(spark.createDataFrame([(i, t, "en", "clash") for i, t in enumerate(rows)], SCHEMA)).collect()
    want = [plain(t) for t in rows]
    assert {r.doc_id: r.fp % 2**64 for r in got} == dict(enumerate(want))
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(brute(want)))


def test_links_with_refined_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "REFINE", 8)
    rnd = random.Random(3)
    centre = [rnd.getrandbits(64) for _ in range(6)]
    fps = list({c ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(7))) & (2**64 - 1) for c in centre for _ in range(80)})
    label = np.arange(len(fps))
    values = np.array(fps, dtype="<u8")
    for mask in simhash._tables(6, 4):
        label = simhash._link(values, values & np.uint64(mask), mask, 4, label, np.arange(len(fps)))
    want = brute(fps)
    assert [[want[i] for i in range(len(fps)) if label[i] == g] for g in set(label)] == [[want[g]] * int((label == g).sum()) for g in set(label)]
    assert len(set(label)) == len(set(want))


def test_empty_null_ids_and_repeats(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0
    rows = [(None, "a b", "en", None), (None, "a b", "en", None), (3, "a b", None, None), (3, "a b", None, None), (None, "q r s t u", None, None)]
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 0), (0, 3), (0, 3), (3, 3), (3, 3)]


def test_stage_keeps_columns(spark):
    docs = spark.createDataFrame([(2, "a b c d e", "en", "s"), (1, "A B c d e", "fr", "s"), (5, "other words here now then", "en", "t")], SCHEMA)
    out = simhash.one_of_each(spark, docs, "")
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 5]
    assert isinstance(out.schema["doc_id"].dataType, T.LongType)
