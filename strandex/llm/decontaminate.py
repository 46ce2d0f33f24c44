"""Benchmark decontamination by greedy string tiling over running Karp-Rabin hashes."""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandex.llm.common import cut, packed, table, unpacked

MIN_MATCH = 5
COVERAGE = 0.8
#: Characters of benchmark items in a block, and blocks that a task holds at once.
BLOCK_CHARS, BLOCKS = 4 << 20, 8
_LEAKS = "array<struct<item_id:long,coverage:double,tiles:int>>"
_TOKEN = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    """Runs of letters and digits, lower-cased."""
    return _TOKEN.findall((text or "").lower())


def rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``length`` ids, modulo 2**64."""
    n = len(ids) - length + 1
    out = np.zeros(max(0, n), dtype=np.uint64)
    for j in range(length if n > 0 else 0):
        out *= _BASE
        out += ids[j : j + n]
    return out


class Index:
    """The windows of the shortest match, of min_match tokens, of a block of benchmark items; and the shorter items."""

    def __init__(self, items: list[tuple[int, str]], min_match: int = MIN_MATCH):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        self.brief: dict[tuple[str, ...], list[int]] = {}  # items of fewer tokens than a match has
        seeds = defaultdict(list)
        for item_id, text in items:
            words = tokens(text)
            if len(words) < min_match:
                if words:
                    self.brief.setdefault(tuple(words), []).append(item_id)
                continue
            ids = np.array([self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in words], dtype=np.uint64)
            if len(ids):
                length = min_match
                seeds[length] += [(h, len(self.items), p) for p, h in enumerate(rolling(ids, length).tolist())]
                self.items.append((item_id, ids))
        self.seeds = {}
        for length, rows in seeds.items():
            rows.sort()
            h = np.array([r[0] for r in rows], dtype=np.uint64)
            flags = np.zeros(1 << 16, dtype=bool)
            flags[h >> np.uint64(48)] = True
            self.seeds[length] = (h, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), flags)

    def matches(self, ids: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(item, positions in it, positions in the text)`` of equal windows, checked token by token."""
        hashes, item, position, flags = self.seeds[length]
        runs = rolling(ids, length)
        at = np.flatnonzero(flags[runs >> np.uint64(48)])
        low, high = np.searchsorted(hashes, runs[at], "left"), np.searchsorted(hashes, runs[at], "right")
        n = high - low
        if not n.sum():
            return
        t = np.repeat(at, n)
        row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        for k in np.unique(item[row]):
            here = item[row] == k
            p, q = position[row[here]], t[here]
            same = np.ones(len(p), dtype=bool)
            for j in range(length):
                same &= self.items[k][1][p + j] == ids[q + j]
            if same.any():
                yield int(k), p[same], q[same]


def tile(p: np.ndarray, t: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(position in the item, position in the text, tokens)`` from equal windows of ``length`` tokens.

    Again and again the longest match of tokens that no tile has yet is marked; of equally long ones the one that is
    first in the item, then in the text. What a mark leaves of another match goes on if it is long enough.
    """
    order = np.lexsort((p, t - p))
    p, t = p[order], t[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(t - p) != 0) | (np.diff(p) != 1)]))
    size = np.diff(np.append(first, len(p))) + length - 1
    heap = [(-int(n), int(a), int(b)) for n, a, b in zip(size, p[first], t[first])]
    heapq.heapify(heap)
    in_item, in_text, out = set(), set(), []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        free = [a + j not in in_item and b + j not in in_text for j in range(n)]
        if all(free):
            in_item.update(range(a, a + n))
            in_text.update(range(b, b + n))
            out.append((a, b, n))
            continue
        start = None
        for j in range(n + 1):
            if j < n and free[j]:
                start = j if start is None else start
            elif start is not None:
                if j - start >= length:
                    heapq.heappush(heap, (start - j, a + start, b + start))
                start = None
    return out


def coverages(text: str | None, index: Index) -> list[tuple[int, float, int]]:
    """``(item_id, covered share of the item's tokens, tiles)`` for each item that shares a window with the text, or is all of it."""
    get = index.vocabulary.get
    words = tokens(text)
    ids = np.fromiter((get(w, 0) for w in words), dtype=np.uint64, count=len(words))
    out = [(k, 1.0, 1) for k in index.brief.get(tuple(words), [])] if words else []
    for length in index.seeds:
        for k, p, t in index.matches(ids, length):
            tiles = tile(p, t, length)
            out.append((index.items[k][0], sum(n for _, _, n in tiles) / len(index.items[k][1]), len(tiles)))
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, *x[1:]))


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, one at a time on the driver."""
    block, held = [], 0
    for row in benchmark.where("text IS NOT NULL").select("item_id", "text").toLocalIterator():
        block.append((row.item_id, row.text))
        held += len(row.text)
        if held >= BLOCK_CHARS:
            yield block
            block, held = [], 0
    if block:
        yield block


def _finder(index: Broadcast, coverage: float):
    def leaks(texts: pd.Series) -> pd.Series:
        own = Index([])
        own.__dict__.update(index.value)
        found = ([x for x in coverages(t, own) if x[1] >= coverage] for t in texts)
        return pd.Series([[{"item_id": i, "coverage": c, "tiles": n} for i, c, n in x] for x in found], dtype=object)

    return F.pandas_udf(leaks, _LEAKS)


def contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, out: str = "leaks"
) -> DataFrame:
    """``docs`` with ``out``: an array of ``(item_id, coverage, tiles)``, the items of ``benchmark(item_id, text)``
    of which tiles of at least ``min_match`` tokens cover ``coverage`` or more, in any order; empty if there are none.

    Texts are lower-cased and cut into runs of letters and digits. An item of fewer than ``min_match`` tokens is too
    short to tell a leak from common words: it is found only where it is the whole text. One without tokens matches nothing, nor
    does a null or empty text. Rows that repeat are judged each, an empty table gives no rows, and a column of ``docs`` named
    like ``out`` is replaced. Nothing is shuffled: items are
    taken in blocks of BLOCK_CHARS, each sent to all tasks, and after every BLOCKS of them the rows are kept in the
    shared folder, so a benchmark of any size is matched with bounded memory.
    """
    rows = docs.withColumn(out, F.array().cast(_LEAKS))
    for n, block in enumerate(_blocks(benchmark)):
        index = docs.sparkSession.sparkContext.broadcast(vars(Index(block, min_match)))  # bounded by BLOCK_CHARS
        rows = rows.withColumn(out, F.concat(out, _finder(index, coverage)(F.col(text_col))))
        if n % BLOCKS == BLOCKS - 1:
            rows = cut(rows)
    return rows


def clean_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go; the others stay whole."""
    found = contamination(packed(docs, "text"), table(spark, sf_dir, "benchmark"))
    return unpacked(found.where(F.size("leaks") == 0), docs)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.array_sort(F.transform("leaks", lambda x: x["item_id"])).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("leaks", lambda x: x["coverage"])), F.lit(0.0)).alias("coverage"),
    )
