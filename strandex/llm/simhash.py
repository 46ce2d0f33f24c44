"""Near-duplicate documents by SimHash, compared in bit slices."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandex.llm import near
from strandex.llm.common import cut, table
from strandex.llm.components import connected_components

WORDS = 4
RADIUS = 4
BLOCKS = 6
SEED = 42
#: Rows that are compared at once, and the size from which a bucket is split by more of its bits.
CHUNK, REFINE = 1 << 18, 2048


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The signed 64-bit fingerprint of one text; 0 for a text without words (null, empty, only white space)."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    if len(parts) <= words:
        starts, stops = [0], [len(line)]
    else:
        starts, stops = [0, *(ends[: len(parts) - words] + 1).tolist()], ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[i:j], SEED) for i, j in zip(starts, stops)], dtype="<u8")
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``(doc_id, fp)``, a row for each row of ``docs``; whole texts, one pass, no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(x.as_py(), words) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["doc_id", "fp"])

    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return ids.mapInArrow(run, "doc_id long, fp long")


# -- comparison in bit slices ---------------------------------------------------------------------------------------


def _planes(fps: np.ndarray) -> np.ndarray:
    """64 rows of words; bit i of row b is bit b of fingerprint i. Two words more than needed, for shifts."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    packed = np.packbits(bits, axis=1, bitorder="little")
    out = np.zeros((64, (packed.shape[1] + 7) // 8 * 8 + 16), dtype=np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view("<u8")


def _words(flags: np.ndarray) -> np.ndarray:
    packed = np.packbits(flags, bitorder="little")
    return np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view("<u8")


def _beyond(one, two, four, over, radius: int) -> np.ndarray:
    """Lanes whose count, in three bit slices with a sticky overflow, is above ``radius`` (at most 7)."""
    above, same = over.copy(), ~over
    for plane, bit in ((four, 4), (two, 2), (one, 1)):
        if radius & bit:
            same = same & plane
        else:
            above |= same & plane
            same = same & ~plane
    return above


def _near(fps: np.ndarray, left: np.ndarray, radius: int, order: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs at most ``radius`` bits apart. ``left[i]``: how many rows after i are in the same bucket.

    For each offset d all lanes (i, i + d) are compared at once: carry-save counters add one bit plane after the
    other to 64 distances a word, and words of which every lane is beyond the radius are given up.
    """
    planes = _planes(fps)
    for d in range(1, int(left.max(initial=0)) + 1):
        valid = _words(left >= d)
        at = np.flatnonzero(valid)
        q, s = divmod(d, 64)
        one, two, four, over = (np.zeros(len(at), dtype=np.uint64) for _ in range(4))
        for n, b in enumerate(order):
            row = planes[b]
            other = row[at + q] >> np.uint64(s)
            if s:
                other |= row[at + q + 1] << np.uint64(64 - s)
            x = other ^ row[at]
            carry = one & x
            one ^= x
            again = two & carry
            two ^= carry
            over |= four & again
            four ^= again
            if n % 6 == 5:
                alive = (valid[at] & ~_beyond(one, two, four, over, radius)) != 0
                if not alive.all():
                    at, one, two, four, over = at[alive], one[alive], two[alive], four[alive], over[alive]
                    if not len(at):
                        break
        if len(at):
            hit = valid[at] & ~_beyond(one, two, four, over, radius)
            lanes = np.unpackbits(hit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, bit = np.nonzero(lanes)
            i = at[row] * 64 + bit
            yield i, i + d


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the sets of a[i] and b[i]; ``label`` holds for each index the least index of its set."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def _bits(mask: int) -> list[int]:
    return [b for b in range(64) if mask >> b & 1]


def _blocks(positions: list[int], n: int) -> list[int]:
    """``positions`` in n blocks of near equal width, as masks."""
    cuts = [round(i * len(positions) / n) for i in range(n + 1)]
    return [sum(1 << b for b in positions[i:j]) for i, j in zip(cuts, cuts[1:])]


def _link(fps: np.ndarray, key: np.ndarray, known: int, radius: int, label: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Unites in ``label`` what is near within equal ``key``; ``known``: mask of the bits that equal keys share.

    A bucket of more than REFINE rows is dealt by each of radius + 1 blocks of its other bits: two fingerprints
    within the radius agree in one of them, so no link is lost.
    """
    order = np.argsort(key, kind="stable")
    fps, key, index = fps[order], key[order], index[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    sizes = np.repeat(size, size)
    left = np.repeat(first + size, size) - np.arange(len(key)) - 1
    free = _bits(~known & (1 << 64) - 1)
    split = (sizes > REFINE) & (len(free) > radius)
    small = (sizes > 1) & ~split
    if small.any():
        where = index[small]
        a, b, held = [], [], 0
        for i, j in _near(fps[small], left[small], radius, free):
            a.append(where[i])
            b.append(where[j])
            held += len(i)
            if held > 1 << 20:
                label, held = _merge(label, np.concatenate(a), np.concatenate(b)), 0
                a, b = [], []
        if a:
            label = _merge(label, np.concatenate(a), np.concatenate(b))
    for i, m in zip(first[size > REFINE], size[size > REFINE]) if split.any() else ():
        part, where = fps[i : i + m], index[i : i + m]
        for mask in _blocks(free, radius + 1):
            label = _link(part, part & np.uint64(mask), known | mask, radius, label, where)
    return label


def _tables(blocks: int, radius: int) -> list[int]:
    """The masks of all choices of ``blocks - radius`` blocks: within the radius, two fingerprints agree on one."""
    parts = _blocks(list(range(64)), blocks)
    return [sum(x) for x in combinations(parts, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Edges ``(a, b)`` that connect just what chains of distances of at most ``radius`` bits connect, in ``fps(fp)``.

    Every fingerprint goes to a bucket for each choice of ``blocks - radius`` of ``blocks`` bit blocks; buckets are
    compared in bit slices, and a bucket gives a star for each of its connected sets, never its pairs. More blocks
    make more copies and smaller buckets (a larger corpus wants 7 or 8).
    """
    if not 0 <= radius <= 7 or blocks <= radius:
        raise ValueError("radius has to be 0 to 7 and below blocks")
    masks = _tables(blocks, radius)

    def compare(t: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        label = np.arange(len(fp))
        fp = fp.view("<u8")
        for n in np.unique(t):
            here = np.flatnonzero(t == n)
            label = _link(fp[here], fp[here] & np.uint64(masks[n]), masks[n], radius, label, here)
        moved = np.flatnonzero(label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved].view("<i8")), pa.array(fp[label[moved]].view("<i8"))], names=["a", "b"]) if len(moved) else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append([np.asarray(c) for c in batch.columns])
            n += batch.num_rows
            if n < CHUNK:
                continue
            t, key, fp = (np.concatenate(c) for c in zip(*held))
            end = _last_start(t, key)
            if end:
                if (out := compare(t[:end], fp[:end])) is not None:
                    yield out
                held, n = [[t[end:], key[end:], fp[end:]]], len(t) - end
            else:
                held = [[t, key, fp]]
        if held:
            t, _, fp = (np.concatenate(c) for c in zip(*held))
            if (out := compare(t, fp)) is not None:
                yield out

    fp = F.col("fp")
    keys = F.array(*[F.struct(F.lit(i).alias("t"), fp.bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    rows = fps.select("fp", F.explode(keys).alias("k")).select(F.col("k.t").alias("t"), F.col("k.key").alias("key"), "fp")
    return rows.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(run, "a long, b long").distinct()


def _last_start(t: np.ndarray, key: np.ndarray) -> int:
    """Where the last bucket begins."""
    change = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1]))
    return int(change[-1]) + 1 if len(change) else 0


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, blocks: int = BLOCKS
) -> DataFrame:
    """``(doc_id, fp, component_id)``, a row for each row of ``docs``.

    Texts are lower-cased in A-Z, cut into words at ASCII white space and into shingles of ``words`` words, repeats
    included. component_id is the least doc_id that links of at most ``radius`` differing bits reach. Equal
    fingerprints are one node, so copies never meet in pairs. Null and empty texts have fingerprint 0 and link like
    any other; a row without an id keeps its row and doesn't name a component (null if no row of it has an id).
    """
    own = cut(fingerprints(docs, id_col, text_col, words))
    nodes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(nodes, radius, blocks)).withColumnRenamed("node", "fp")
    linked = cut(roots.join(nodes, "fp"))
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("named")), "root").select("fp", "named")
    classes = nodes.join(named, "fp", "left").select("fp", F.when(F.col("named").isNull(), F.col("least")).otherwise(F.col("named")).alias("component_id"))
    return own.join(classes, "fp").select("doc_id", "fp", "component_id")


def _united(pairs: DataFrame) -> DataFrame:
    """``(root, _joined)``: the class of each root of ``pairs(root, _fp)`` that a fingerprint class shares with another root."""
    ends = pairs.groupBy("_fp").agg(F.min("root").alias("b"), F.max("root").alias("_most")).where("b <> _most").drop("_most")
    edges = pairs.join(ends, "_fp").where("root <> b").select(F.col("root").alias("a"), "b")
    return connected_components(edges).select(F.col("node").alias("root"), F.col("root").alias("_joined"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates one row stays, with all its columns.

    Near are texts whose fingerprints link, as in :func:`near_duplicates`, and beside them texts whose sets of five-word
    shingles have a Jaccard similarity of 0.8 or more (:mod:`strandex.llm.near`), as edits in a short text move more bits;
    chains of both kinds are one group.
    It is the row of the least doc_id, null last, and of rows that share it that of the least hash of all columns. Rows
    that are equal in every column are alike, so any one of them stays.
    """
    content = F.xxhash64(*[F.col(f"`{n}`") for n in docs.columns])
    marked = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_row": content})
    prints = cut(fingerprints(marked, "_row").select(F.col("doc_id").alias("_row"), "fp").distinct())
    linked = connected_components(links(prints.select("fp").distinct())).select(F.col("node").alias("fp"), F.col("root").alias("_linked"))
    prints = prints.join(linked, "fp", "left").select("_row", F.coalesce("_linked", "fp").alias("_fp"))
    classes = cut(near.near_classes(marked, keys=("_id", "_row")).groupBy("root", "_id", "_row").agg(F.count("*").alias("_n")))
    classes = classes.join(_united(classes.join(prints, "_row").select("root", "_fp").distinct()), "root", "left").withColumn("root", F.coalesce("_joined", "root"))
    first = classes.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row", "_n")).alias("k"))
    keep = cut(first.select(F.col("k._id").alias("_keep"), F.col("k._row").alias("_kept"), F.col("k._n").alias("_n")))
    same = marked["_id"].eqNullSafe(keep["_keep"]) & (marked["_row"] == keep["_kept"])
    once = marked.join(keep.where("_n = 1"), same, "left_semi")
    again = marked.join(keep.where("_n > 1"), same, "left_semi").dropDuplicates(["_id", "_row"])
    return once.unionByName(again).select(*[f"`{n}`" for n in docs.columns])


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
