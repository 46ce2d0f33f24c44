"""The pipeline against plain versions of its stages, on a small folder of tables."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from strandex.llm import decontaminate, mixing, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randint(2, 8)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    bench = [(i, " ".join(sentence(12) for _ in range(2))) for i in range(4)]
    rows = []
    for i in range(300):
        text = " ".join(sentence(rnd.randint(6, 14)) for _ in range(8))
        if i % 7 == 3:
            text = " ".join([word()] * 40 + [word()] * 40)
        elif i % 7 == 4 and i > 20:
            text = rows[i - 7 * rnd.randint(1, 2) - 4][1] + rnd.choice(["", " End."])
        elif i % 29 == 5:
            text = f"{text} {rnd.choice(bench)[1]} {sentence(5)}"
        rows.append((i, text, "en", f"s{min(i % 5, 2)}", len(text)))
    rows += [(300, None, None, None, None), (301, "", None, None, 0), (302, " ".join(sentence(9) for _ in range(900)), "en", "s0", None)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, DOCS).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 7 != 3), 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), rows, bench


def shingles(text):
    """The set of runs of five words, lower-cased; fewer words are one run."""
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def test_stages(spark, folder):
    path, rows, bench = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], path).cache())
        assert set(docs.columns) <= set(out[-1].columns)
    model = quality.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    score = dict(zip([r[0] for r in rows], model.score(np.array([quality.features(r[1]) for r in rows]))))
    good = [r for r in rows if score[r[0]] >= 0.7]
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    assert ids(out[1]) == Counter(r[0] for r in good)
    clean = [i for i in range(300) if i % 7 != 3]
    assert len(set(clean) & set(ids(out[1]))) >= 0.97 * len(clean) and len({r[0] for r in good if r[0] % 7 == 3}) <= 2

    sets = [shingles(r[1]) for r in good]
    kept = []
    group = list(range(len(good)))
    for i in range(len(good)):
        for j in range(i):
            if near(sets[i], sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    kept = [r for i, r in enumerate(good) if group[i] == i]
    assert ids(out[2]) == Counter(r[0] for r in kept)

    index = decontaminate.Index(bench)
    free = [r for r in kept if all(c < 0.8 for _, c, _ in decontaminate.coverages(r[1], index))]
    assert ids(out[3]) == Counter(r[0] for r in free) and 0 < len(kept) - len(free) < 20

    copies = ids(mixing.replicate(out[3], mixing.rates(out[3])))
    assert ids(out[4]) == copies
    last = out[5].collect()
    assert Counter(r.doc_id for r in last) == copies
    slots = defaultdict(list)
    for r in last:
        slots[r.shard].append(r.slot)
        assert r.text_crc32 == zlib.crc32((r.text or "").encode())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_run(spark, folder):
    path, _, _ = folder
    out = corpus_pipeline.run(spark, path)
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns) and out.count() > 100
