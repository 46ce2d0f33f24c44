"""Bands of lines at the threshold itself."""

import random

from strandex.llm import lines
from tests.llm.test_lines import band_keys


def test_recall_of_the_bands_at_the_threshold(spark):
    rnd = random.Random(8)
    line = lambda n: "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(n))
    pairs = []
    for _ in range(2000):
        both = line(187)  # 180 shingles in both and 22 or 23 of each alone
        pairs.append((both + line(22), both + line(23)))
    shares = [lines.jaccard(lines.shingles(a), lines.shingles(b)) for a, b in pairs]
    assert all(0.8 <= x < 0.802 for x in shares)
    keys = band_keys(spark, [x for p in pairs for x in p])
    assert sum(not a & b for a, b in zip(keys[::2], keys[1::2])) <= 4
