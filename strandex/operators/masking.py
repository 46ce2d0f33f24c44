"""Low-complexity masking: windows whose triplets repeat too much, scored in numpy over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

WINDOW, LEVEL = 64, 20


def low_complexity(seq: str, window: int = WINDOW, level: int = LEVEL) -> np.ndarray:
    """Which bases lie in a window of ``window`` bases whose triplet score is above ``level``.

    The score of a window is ten times the number of pairs of equal triplets, by its number of triplets less one; triplets with
    an invalid base don't count. A shorter sequence is one window.
    """
    codes = np.full(256, 4, dtype=np.int64)
    for i, pair in enumerate(("Aa", "Cc", "Gg", "Tt")):
        codes[[ord(c) for c in pair]] = i
    raw = codes[np.frombuffer(seq.encode("latin-1", "replace"), dtype=np.uint8)]
    out = np.zeros(len(raw), dtype=bool)
    n = min(window, len(raw)) - 2
    if n < 2:
        return out
    triplets = np.where((raw[:-2] > 3) | (raw[1:-1] > 3) | (raw[2:] > 3), -1, raw[:-2] * 16 + raw[1:-1] * 4 + raw[2:])
    pairs = np.zeros(len(triplets) - n + 1, dtype=np.int64)
    for t in np.unique(triplets[triplets >= 0]):
        counts = np.concatenate([[0], np.cumsum(triplets == t)])
        c = counts[n:] - counts[:-n]
        pairs += c * (c - 1) // 2
    hot = 10 * pairs > level * (n - 1)
    edges = np.zeros(len(raw) + 1, dtype=np.int64)
    at = np.flatnonzero(hot)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + n + 2, -1)
    return np.cumsum(edges[:-1]) > 0


def mask_low_complexity(seq: Column, window: int = WINDOW, level: int = LEVEL) -> Column:
    """``seq`` with its low-complexity bases in lower case, the others in upper case; null stays null."""

    def run(seqs: pa.Array) -> pa.Array:
        out = []
        for s in seqs.to_pylist():
            if s is None:
                out.append(None)
                continue
            raw = np.frombuffer(s.upper().encode("latin-1", "replace"), dtype=np.uint8).copy()
            low = low_complexity(s, window, level)
            raw[low & (raw >= 65) & (raw <= 90)] += 32
            out.append(raw.tobytes().decode("latin-1"))
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(seq)
