"""The quality model on tables that are partitioned in other ways."""

import random
import zlib

import numpy as np

from strandex.llm import quality


def test_scores_do_not_hang_on_partitions(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randint(2, 8)))
    rows = []
    for i in range(quality.BATCH + 1500):
        rows.append((i, " ".join(word() for _ in range(rnd.randint(5, 40))).capitalize() + ("." if i % 4 else " !!! ### " * rnd.randint(1, 9))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, len(rows), 3)], "doc_id long, quality int")
    a = quality.train(docs.repartition(3), labels)
    b = quality.train(docs.repartition(7, "text"), labels.repartition(5))
    x = np.array([quality.features(t) for _, t in rows])
    assert np.abs(a.score(x) - b.score(x)).max() < 1e-9
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    right = (a.score(x[held]) >= quality.THRESHOLD) == np.array([i % 4 != 0 for i in held])
    assert right.mean() > 0.95
