"""Near duplicates by five-word Jaccard: the stage against brute force on pairs close to 0.8."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from strandex.llm import decontaminate, mixing, near, simhash
from tests.llm.test_pipeline import folder  # noqa: F401

DOCS = "doc_id long, text string, lang string, source string"


def plain(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def roots(texts, least=0.8):
    sets = [plain(t) for t in texts]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= least:
                new, old = sorted((root[i], root[j]))
                root = [new if r == old else r for r in root]
    return root


def texts():
    rnd = random.Random(7)
    vocab = ["".join(rnd.choice("abcdefgéß") for _ in range(rnd.randint(2, 7))) for _ in range(500)]
    out = [None, "", " \t\n", "one", "One", "one two three", "ONE  two\x0bthree", "one two", "x " * 30, "x " * 50]
    for n in (40, 100, 300):
        for _ in range(40):
            base = [rnd.choice(vocab) for _ in range(n)]
            out.append(" ".join(base))
            copy = list(base)
            for at in rnd.sample(range(n), max(1, round(n * rnd.uniform(0.01, 0.035)))):
                copy[at] = "edited"
            out.append("  ".join(copy).upper() if rnd.random() < 0.3 else " ".join(copy))
    return out


def test_stage_finds_all_pairs_at_the_threshold(spark):
    rows = texts()
    want = roots(rows)
    sets = [plain(t) for t in rows]
    close = [similarity(sets[i], sets[i + 1]) for i in range(10, len(rows), 2)]
    assert sum(0.8 <= x < 0.88 for x in close) >= 10 and sum(0.7 < x < 0.8 for x in close) >= 10
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(rows)], DOCS)
    assert sorted(r.doc_id for r in simhash.one_of_each(spark, docs, "").collect()) == sorted(set(want))


def test_sets_and_jaccard_against_plain():
    rows = texts()
    sets, hashed = [plain(t) for t in rows], [near.shingle_set(t) for t in rows]
    for i in range(len(rows) - 1):
        assert len(sets[i]) == len(hashed[i]) and near.jaccard(hashed[i], hashed[i + 1]) == similarity(sets[i], sets[i + 1])


def test_recall_of_the_bands_at_the_threshold():
    rnd = np.random.default_rng(3)
    missed, pairs = 0, 2000
    for _ in range(pairs):
        h = rnd.integers(0, 2**64, 100, dtype=np.uint64)  # 80 shared, 10 of each side's own
        keys = near.band_keys(np.concatenate([h[:90], h[:80], h[90:]]), np.array([0, 90]))
        missed += not (keys[0] == keys[1]).any()
    assert missed <= 1


def test_pipeline_from_the_stage_on(spark, folder):
    path, rows, bench = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], path).cache())
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    good = [r for r in rows if r[0] in ids(out[1])]
    kept = [good[i] for i in sorted(set(roots([r[1] for r in good])))]
    assert len(kept) < len(good) and ids(out[2]) == Counter(r[0] for r in kept)
    index = decontaminate.Index(bench)
    free = [r for r in kept if all(c < 0.8 for _, c, _ in decontaminate.coverages(r[1], index))]
    assert ids(out[3]) == Counter(r[0] for r in free) and 0 < len(kept) - len(free) < 20
    assert ids(out[4]) == ids(out[5]) == ids(mixing.replicate(out[3], mixing.rates(out[3])))


def test_one_row_of_each_class_with_null_and_repeated_ids(spark):
    a, b, c = "one two three four five six", "other words that stand here now", "some more words of a third kind"
    rows = [
        (1, a, "en", "s"), (1, a, "en", "s"), (1, a, "fr", "s"), (2, a, "en", "s"),  # repeats of an id, equal in all columns or not
        (1, b, "en", "s"), (0, b, "en", "s"),  # 1 is kept above, not here
        (None, c, "en", "s"), (None, c, "en", "s"), (None, c.upper(), "en", "s"),  # null ids only
        (None, a, "en", "t"), (7, None, "en", "s"), (7, "", "en", "s"),
    ]
    out = simhash.one_of_each(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert len(out) == 4 and all(tuple(r) in rows for r in out)
    assert Counter((r.doc_id, (r.text or "").lower()) for r in out) == Counter([(1, a), (0, b), (None, c), (7, "")])


@pytest.mark.parametrize("n, size, kept, spread", [(40, 30, 0.85, 0.15), (150, 120, 0.86, 0.1), (150, 200, 0.85, 0.0), (60, 3000, 0.88, 0.06), (60, 1, 0.5, 0.0)])
def test_a_large_bucket_is_linked_as_all_its_pairs_are(n, size, kept, spread):
    rng = np.random.default_rng(n + size)
    base, rows = rng.integers(0, 2**64, size, dtype=np.uint64), []
    for i in range(n):
        k = int(size * (kept + spread * rng.random()))
        rows.append((i.to_bytes(4, "big"), np.unique(np.concatenate([rng.permutation(base)[:k], rng.integers(0, 2**64, size - k, dtype=np.uint64)]))))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1] * n), pa.array([d for d, _ in rows], pa.binary()), pa.array([s.view(np.int64) for _, s in rows], pa.list_(pa.int64()))], names=["key", "handle", "shingles"]
    )
    root = {d: d for d, _ in rows}

    def joined(pairs):
        found = dict(root)
        for a, b in pairs:
            a, b = found[a], found[b]
            found = {d: min(a, b) if r in (a, b) else r for d, r in found.items()}
        return found

    got = [e for out in near._verified(0.8)([batch]) for e in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
    want = [(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[:i] if near.jaccard(x, y) >= 0.8]
    assert joined(got) == joined(want)
