"""Near-duplicate documents by the Jaccard similarity of word shingles: MinHash bands, verified exactly, union-find.

Of 64 SimHash bits a pair at Jaccard 0.8 differs in some 10 with a deviation of 3; a radius that loses few of them
leaves no blocks to search by. So candidates come from bands, and the fingerprints of op1_simhash aren't used here.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from strandex.llm.common import cut
from strandex.llm.components import connected_components

#: Words of a shingle; rows of a band and bands (a pair at 0.8 is missed with probability 3.2e-6); least Jaccard.
WORDS, ROWS, BANDS, JACCARD = 5, 4, 24, 0.8
SEED = 29
#: Words that are hashed at once, words whose hash is kept, and digests that may be broadcast (some 40 bytes each).
CHUNK, KNOWN, MOST = 1 << 16, 1 << 20, 1_000_000
#: Members of a bucket up to which bit maps aren't worth making; results don't depend on it.
FEW = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased in A-Z and cut at ASCII white space, as for fingerprints."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _hashes(docs: list[list[bytes]], known: dict[bytes, int], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every shingle of documents that have words, and where each document's begin.

    A document of fewer words is one shingle, filled up with zeros.
    """
    words = [w for d in docs for w in d]
    if len(known) > KNOWN:
        known.clear()
    known.update((w, xxhash.xxh64_intdigest(w, SEED)) for w in set(words).difference(known))
    held = np.array([len(d) for d in docs])
    lengths = np.maximum(held, size)
    begin = np.cumsum(lengths) - lengths
    codes = np.zeros(lengths.sum(), dtype=np.uint64)
    codes[np.arange(len(words)) + np.repeat(begin - (np.cumsum(held) - held), held)] = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    runs = np.zeros(len(codes) - size + 1, dtype=np.uint64)
    for j in range(size):
        runs *= _MIX
        runs += codes[j : j + len(runs)]
    counts = lengths - size + 1
    first = np.cumsum(counts) - counts
    h = runs[np.arange(counts.sum()) + np.repeat(begin - first, counts)]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h, first


def shingle_set(text: str | None, known: dict[bytes, int] | None = None) -> np.ndarray:
    """The hashes of the distinct shingles of a text, in order."""
    words = words_of(text)
    return np.unique(_hashes([words], {} if known is None else known)[0]) if words else np.zeros(0, dtype=np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets of :func:`shingle_set`; texts without words are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def band_keys(h: np.ndarray, first: np.ndarray, rows: int = ROWS, bands: int = BANDS, seed: int = SEED) -> np.ndarray:
    """A key for each document and band, from the least hashes of ``rows`` hash functions."""
    rnd = np.random.default_rng(seed)
    factors = rnd.integers(0, 1 << 31, rows * bands, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    offsets = rnd.integers(0, 1 << 32, rows * bands, dtype=np.uint32)
    h = (h >> np.uint64(32)).astype(np.uint32)
    mixed = np.empty_like(h)
    out = np.zeros((len(first), bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(len(first), b + 1, dtype=np.uint64)
        for j in range(b * rows, (b + 1) * rows):
            np.multiply(h, factors[j], out=mixed)
            np.add(mixed, offsets[j], out=mixed)
            key = (key ^ np.minimum.reduceat(mixed, first).astype(np.uint64)) * _MIX
            key ^= key >> np.uint64(31)
        out[:, b] = key
    return out.view(np.int64)


def _digest(words: list[bytes]) -> bytes:
    return xxhash.xxh128_digest(b" ".join(words))


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text, which is the last column, gives way to its digest and band keys (none without words)."""
    known: dict[bytes, int] = {}
    for batch in batches:
        docs, digests, held, begin = [], [], 0, 0
        texts = batch.column(batch.num_columns - 1)
        for i, text in enumerate(texts):
            docs.append(words_of(text.as_py()))
            digests.append(_digest(docs[-1]))
            held += len(docs[-1])
            if held < CHUNK and i < len(texts) - 1:
                continue
            some = [d for d in docs if d]
            keys = band_keys(*_hashes(some, known)) if some else np.zeros((0, BANDS), dtype=np.int64)
            ends = np.cumsum([0] + [BANDS * bool(d) for d in docs])
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel()))
            columns = [c.slice(begin, len(docs)) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.binary()), bands], names=[*batch.schema.names[:-1], "digest", "bands"])
            docs, digests, held, begin = [], [], 0, i + 1


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [_digest(words_of(x.as_py())) for x in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), batch.column(0)], names=["digest", "text"])


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, int] = {}
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            sets = [shingle_set(x.as_py(), known).view(np.int64) for x in part.column(1)]
            ends = np.cumsum([0] + [len(x) for x in sets])
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([part.column(0), column], names=["handle", "shingles"])


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those that aren't alone with theirs; a row waits for the next to tell."""
    last, waiting, told = None, None, True  # the key of the row before, that row, and whether it is out already
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.asarray(batch.column(0))
        same = key[1:] == key[:-1]
        head = last is not None and key[0] == last
        if head and not told:
            yield waiting
        keep = np.concatenate([[head], same]) | np.concatenate([same, [False]])
        if keep.any():
            yield batch.filter(pa.array(keep))
        last, waiting, told = key[-1], batch.slice(batch.num_rows - 1), bool(keep[-1])


def _different(shared: DataFrame) -> DataFrame:
    """``shared(key, handle)`` without buckets that have just the members of another one: close lines meet in most bands."""
    mixes = [F.bit_xor(F.xxhash64("handle", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    sets = shared.groupBy("key").agg(F.count("*").alias("n"), F.min("handle").alias("least"), *mixes)
    first = sets.groupBy("n", "least", "x1", "x2").agg(F.min("key").alias("key")).select("key")
    return cut(shared.join(first, "key", "left_semi"))


def _maps(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A bit map of each set, some eight bits to a hash of a usual one, and how many bits are set."""
    width = min(1 << 15, 1 << int(8 * np.median([len(x) for x in sets]) + 64).bit_length())
    out = np.empty((len(sets), width // 64), dtype=np.uint64)
    for i, x in enumerate(sets):
        bits = np.zeros(width, dtype=bool)
        bits[(x & np.uint64(width - 1)).astype(np.int64)] = True
        out[i] = np.packbits(bits).view(np.uint64)
    return out, np.bitwise_count(out).sum(axis=1, dtype=np.int64)


def _may_meet(maps: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, i: int, others: np.ndarray, least: float) -> np.ndarray:
    """Which of ``others`` the maps leave a similarity of ``least`` to row ``i``.

    A bit of one map only stands for at least one hash of one set only, so no pair that is near is ruled out.
    """
    bits, held = maps
    step = max(1, (1 << 19) // bits.shape[1])
    parts = [np.bitwise_count(bits[others[k : k + step]] & bits[i]).sum(axis=1, dtype=np.int64) for k in range(0, len(others), step)]
    both = np.concatenate(parts)
    own, theirs = held[i] - both, held[others] - both  # bits that only one of the two has
    shared = np.minimum(sizes[i] - own, sizes[others] - theirs)
    return shared >= least * np.maximum(sizes[i] + theirs, sizes[others] + own) - 1e-6


def _verified(least: float):
    """Edges between documents of a bucket: stars of what chains of pairs at ``least`` or more connect in it."""

    def bucket(rows: list[tuple[bytes, np.ndarray]]) -> list[tuple[bytes, bytes]]:
        n = len(rows)
        sets = [x for _, x in rows]
        sizes = np.array([len(x) for x in sets])
        maps = _maps(sets) if n > FEW else None
        label, counts, lead = np.arange(n), np.ones(n, dtype=np.int64), 0  # the first row of each row's group; rows of a group; the largest
        for i in range(1, n):

            def meets(j: int) -> bool:
                small, large = sorted((sizes[i], sizes[j]))
                return small >= least * large and jaccard(sets[i], sets[j]) >= least

            def join(j: int) -> None:
                nonlocal lead
                into, other = sorted((label[i], label[j]))
                label[: i + 1][label[: i + 1] == other] = into
                counts[into] += counts[other]
                lead = into if counts[into] > counts[lead] or lead == other else lead

            if lead != i and meets(lead):  # most rows of a large group end here
                join(lead)
            apart = np.flatnonzero(label[:i] != label[i])
            if maps is not None and len(apart):
                apart = apart[_may_meet(maps, sizes, i, apart, least)]
            for j in apart:
                if label[j] != label[i] and meets(j):
                    join(j)
        return [(rows[i][0], rows[label[i]][0]) for i in range(n) if label[i] != i]

    def edges(out: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            for value, digest, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if value != key:
                    out += bucket(held)
                    key, held = value, []
                held.append((digest, np.array(shingles.values).view(np.uint64)))
            if out:
                yield edges(out)
                out = []
        if out := bucket(held):
            yield edges(out)

    return run


def near_classes(docs: DataFrame, text_col: str = "text", keys: tuple[str, ...] = (), least: float = JACCARD) -> DataFrame:
    """``(keys..., digest, root)``, a row for each row of ``docs``; rows of one ``root`` are near duplicates.

    Texts are lower-cased in A-Z, cut into words at ASCII white space and into the set of their shingles of five words
    (fewer words are one shingle). Equal texts are one node, so copies never meet in pairs, and null or empty ones are
    equal. Nodes that share a band are compared by the Jaccard similarity of their sets, as 64-bit hashes; chains of
    pairs at ``least`` or more are a class, and ``root`` is its least digest.
    """
    rows = docs.select(*keys, F.col(text_col).alias("text"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1])
    own = cut(rows.mapInArrow(_sign, ", ".join(filter(None, [kinds, "digest binary, bands array<long>"]))))
    nodes = own.groupBy("digest").agg(F.any_value("bands").alias("bands"))
    banded = nodes.select(F.explode("bands").alias("key"), F.col("digest").alias("handle")).repartition("key").sortWithinPartitions("key")
    shared = _different(cut(banded.mapInArrow(_shared, "key long, handle binary")))
    wanted = cut(shared.select(F.col("handle").alias("digest")).distinct())
    if wanted.count() <= MOST:
        wanted = F.broadcast(wanted)
    texts = rows.select("text").where("text IS NOT NULL").mapInArrow(_digests, "digest binary, text string")
    texts = texts.join(wanted, "digest", "left_semi").dropDuplicates(["digest"])
    members = shared.join(texts.mapInArrow(_sets, "handle binary, shingles array<long>"), "handle").select("key", "handle", "shingles")
    edges = members.repartition("key").sortWithinPartitions("key", "handle").mapInArrow(_verified(least), "a binary, b binary")
    roots = connected_components(edges).withColumnRenamed("node", "digest")
    return own.drop("bands").join(roots, "digest", "left").select(*keys, "digest", F.coalesce("root", "digest").alias("root"))
