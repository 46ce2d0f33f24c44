"""Minimizers of sequences: vectorised over Arrow batches, as runs of equal values."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandex.constants import K, L, SEGMENT, seed_mask, toggle_of
from strandex.functions import sequence

_CODES = np.full(256, 255, dtype=np.uint8)
for _i, _pair in enumerate(("Aa", "Cc", "Gg", "Tt")):
    _CODES[[ord(c) for c in _pair]] = _i
_NONE = np.uint64(2**64 - 1)
RUNS = "array<struct<minimizer:long,len:int>>"
_SUMMARY = ["windows", "with_one", "different", "least", "greatest", "mixed"]
_LMERS = ["lmers", "valid", "least", "greatest", "mixed", "least_candidate", "greatest_candidate", "mixed_candidates"]
#: Bases that are scanned at once, minimizers that are packed at once, and the odd factor (with its inverse) that deals them to 2**BUCKET_BITS buckets.
BLOCK, HELD, BUCKET_BITS = 1 << 17, 1 << 22, 12
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def _lmers(codes: np.ndarray, l: int) -> tuple[np.ndarray, np.ndarray]:
    """Forward and reverse-complement codes of all l-mers, put together from halves."""
    have, forward, backward = 0, None, None
    size, f, r = 1, codes, np.uint64(3) - codes
    while size <= l:
        if l & size:
            if forward is None:
                have, forward, backward = size, f, r
            else:
                n = len(codes) - have - size + 1
                forward = (forward[:n] << np.uint64(2 * size)) | f[have : have + n]
                backward = backward[:n] | (r[have : have + n] << np.uint64(2 * have))
                have += size
        if 2 * size <= l:
            n = len(f) - size
            f, r = (f[:n] << np.uint64(2 * size)) | f[size:], r[:n] | (r[size:] << np.uint64(2 * size))
        size *= 2
    return forward, backward


def window_values(raw: np.ndarray, k: int = K, l: int = L) -> np.ndarray:
    """The minimizer of the window that starts at each byte of ``raw`` (all ones if it has none), len - k + 1 of them."""
    n = len(raw) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    codes = _CODES[raw]
    bad = np.concatenate([[0], np.cumsum(codes > 3)])
    forward, backward = _lmers(np.where(codes > 3, 0, codes).astype(np.uint64), l)
    toggle = np.uint64(toggle_of(l))
    values = (np.minimum(forward, backward) & np.uint64(seed_mask())) ^ toggle
    values[bad[l:] != bad[: len(bad) - l]] = _NONE
    least = values[:n].copy()
    for i in range(1, k - l + 1):
        np.minimum(least, values[i : i + n], out=least)
    none = (least == _NONE) | (bad[k : k + n] != bad[1 : 1 + n])
    out = least ^ toggle
    out[none] = _NONE
    return out


def _blocks(seqs: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bases and offsets of some sequences at once: of BLOCK bases, or of one sequence that has more.

    A batch has ten thousand sequences of any length, and the scan takes some hundred bytes a base.
    """
    seqs = seqs.cast(pa.large_binary())
    if seqs.null_count:
        seqs = seqs.fill_null(b"")
    offsets = np.frombuffer(seqs.buffers()[1], dtype=np.int64)[seqs.offset : seqs.offset + len(seqs) + 1] if len(seqs) else np.zeros(1, dtype=np.int64)
    data = seqs.buffers()[2] if len(seqs) else None
    i = 0
    while i < len(seqs):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, side="right")) - 1)
        yield np.frombuffer(data, dtype=np.uint8)[offsets[i] : offsets[j]] if data else np.zeros(0, dtype=np.uint8), offsets[i : j + 1] - offsets[i]
        i = j


def _runs_of(raw: np.ndarray, offsets: np.ndarray, k: int, l: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimizers (all ones: none) and lengths of the runs of a block, and where the runs of each sequence begin and end."""
    begin = offsets[:-1]
    counts = np.maximum(np.diff(offsets) - k + 1, 0)
    first = np.cumsum(counts) - counts
    at = np.arange(counts.sum()) + np.repeat(begin - first, counts)
    values = window_values(raw, k, l)[at]
    change = np.ones(len(values), dtype=bool)
    change[1:] = values[1:] != values[:-1]
    change[first[counts > 0]] = True
    starts = np.flatnonzero(change)
    lens = np.diff(np.append(starts, len(values))).astype(np.int32)
    return values[starts], lens, np.searchsorted(starts, np.append(first, len(values)))


def _run_lists(seqs: pa.Array, k: int, l: int) -> pa.ListArray:
    """The runs of each sequence of a batch, without a Python object for any of them."""
    parts = [_runs_of(raw, offsets, k, l) for raw, offsets in _blocks(seqs)]
    found = np.concatenate([np.zeros(0, dtype=np.uint64), *(p[0] for p in parts)])
    lens = np.concatenate([np.zeros(0, dtype=np.int32), *(p[1] for p in parts)])
    counts = np.concatenate([np.zeros(1, dtype=np.int64), *(np.diff(p[2]) for p in parts)])
    items = pa.StructArray.from_arrays([pa.array(found.view(np.int64), mask=found == _NONE), pa.array(lens)], names=["minimizer", "len"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(counts).astype(np.int32)), items)


def _summaries(seqs: pa.Array, k: int, l: int) -> pa.StructArray:
    out = []
    for raw, offsets in _blocks(seqs):
        found, lens, ends = _runs_of(raw, offsets, k, l)
        who = np.repeat(np.arange(len(offsets) - 1), np.diff(ends))
        total = lambda at, w: np.bincount(at, w, len(offsets) - 1).astype(np.int64)
        has = found != _NONE
        values, odd, owner = found[has].view(np.int64), lens[has] % 2 == 1, who[has]
        order = np.lexsort((values, owner))
        values, odd, owner = values[order], odd[order], owner[order]
        head = np.flatnonzero(np.diff(owner, prepend=-1))
        new = np.ones(len(values), dtype=bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        some = np.full((3, len(offsets) - 1), 0, dtype=np.int64)
        if len(head):
            for row, f, v in zip(some, (np.minimum, np.maximum, np.bitwise_xor), (values, values, np.where(odd, values, 0))):
                row[owner[head]] = f.reduceat(v, head)
        none = total(owner, None) == 0
        out.append(pa.StructArray.from_arrays(
            [*map(pa.array, (total(who, lens), total(who[has], lens[has]), total(owner, new))), *(pa.array(row, mask=none) for row in some)], names=_SUMMARY
        ))
    return pa.concat_arrays(out) if out else pa.array([], pa.struct([(n, pa.int64()) for n in _SUMMARY]))


def summary(seq: Column | str, k: int = K, l: int = L) -> Column:
    """A struct of a sequence's windows, those with a minimizer, its different minimizers, their least, greatest and xor over windows."""
    return F.arrow_udf(lambda seqs: _summaries(seqs, k, l), "struct<" + ",".join(f"{n}:long" for n in _SUMMARY) + ">")(F.col(seq) if isinstance(seq, str) else seq)


def _lmer_summaries(seqs: pa.Array, l: int) -> pa.StructArray:
    out = []
    for raw, offsets in _blocks(seqs):
        counts = np.maximum(np.diff(offsets) - l + 1, 0)
        has = counts > 0
        valid, some = np.zeros(len(counts), dtype=np.int64), np.zeros((6, len(counts)), dtype=np.int64)
        if has.any():
            codes = _CODES[raw]
            bad = np.concatenate([[0], np.cumsum(codes > 3)])
            code = np.minimum(*_lmers(np.where(codes > 3, 0, codes).astype(np.uint64), l)).view(np.int64)
            first = np.cumsum(counts) - counts
            at = np.arange(counts.sum()) + np.repeat(offsets[:-1] - first, counts)
            code, good, head = code[at], (bad[l:] == bad[: len(bad) - l])[at], first[has]
            valid[has] = np.add.reduceat(good, head, dtype=np.int64)
            for i, x in enumerate((code, code & np.int64(seed_mask()) ^ np.int64(toggle_of(l)))):
                for j, (f, other) in enumerate(((np.minimum, np.iinfo(np.int64).max), (np.maximum, -1), (np.bitwise_xor, 0))):
                    some[3 * i + j, has] = f.reduceat(np.where(good, x, other), head)
        none = valid == 0
        out.append(pa.StructArray.from_arrays([pa.array(counts), pa.array(valid), *(pa.array(row, mask=none) for row in some)], names=_LMERS))
    return pa.concat_arrays(out) if out else pa.array([], pa.struct([(n, pa.int64()) for n in _LMERS]))


def lmer_summary(seq: Column | str, l: int = L) -> Column:
    """A struct of a sequence's l-mers, those of valid bases, and least, greatest and xor of their canonical codes and of the candidates."""
    if not 0 < l <= 31:
        raise ValueError("l has to be 1 to 31")
    return F.arrow_udf(lambda seqs: _lmer_summaries(seqs, l), "struct<" + ",".join(f"{n}:long" for n in _LMERS) + ">")(F.col(seq) if isinstance(seq, str) else seq)


def runs(seq: Column | str, k: int = K, l: int = L) -> Column:
    """Runs of equal window minimizers of a sequence, in order: ``array<struct<minimizer, len>>``.

    A null minimizer is a run of windows without one. A sequence shorter than k (or null) has no runs.
    """
    if not 0 < l <= min(31, k):
        raise ValueError("l has to be 1 to 31 and at most k")

    def scan(seqs: pa.Array) -> pa.Array:
        return _run_lists(seqs, k, l)

    return F.arrow_udf(scan, RUNS)(F.col(seq) if isinstance(seq, str) else seq)


def read_runs(reads: DataFrame, k: int = K, l: int = L) -> DataFrame:
    """``(read_id, mate, run_no, minimizer, len)`` of ``reads(read_id, mate, seq)``: runs, not windows, leave the scan."""
    scanned = reads.select("read_id", "mate", F.posexplode(runs("seq", k, l)).alias("run_no", "run"))
    return scanned.select("read_id", "mate", "run_no", "run.minimizer", "run.len")


def distinct_minimizers(records: DataFrame, *keys: str, k: int = K, l: int = L, segment: int = SEGMENT) -> DataFrame:
    """Distinct ``(keys..., minimizer)`` of ``records(keys..., seq)``; long sequences are cut first, so a batch stays small."""
    pieces = records.select(*keys, F.explode(sequence.segments(F.col("seq"), k, segment)).alias("piece"))
    found = pieces.select(*keys, F.explode(F.array_distinct(runs("piece.bases", k, l)["minimizer"])).alias("minimizer"))
    return found.where("minimizer IS NOT NULL").distinct()


def keyed_minimizers(records: DataFrame, key: str, k: int = K, l: int = L, segment: int = SEGMENT) -> DataFrame:
    """``(key, minimizer)`` of ``records(key, seq)``, as often as blocks of the scan have it: for what doesn't count repeats."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(0), 0
            for raw, offsets in _blocks(batch.column(1)):
                values, _, ends = _runs_of(raw, offsets, k, l)
                own = texts.slice(at, len(offsets) - 1)
                at += len(own)
                coded = own.dictionary_encode()
                who = np.repeat(coded.indices.fill_null(-1).to_numpy(), np.diff(ends))
                for i in np.unique(who).tolist():
                    part = distinct(values[(who == i) & (values != _NONE)]).view(np.int64)
                    name = None if i < 0 else coded.dictionary[i].as_py()
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()).take(pa.array(np.zeros(len(part), dtype=np.int32))), pa.array(part)], names=[key, "minimizer"])

    pieces = records.select(F.col(key).cast("string").alias("key"), F.explode(sequence.segments(F.col("seq"), k, segment)).alias("piece")).select("key", "piece.bases")
    return pieces.mapInArrow(scan, f"{key} string, minimizer long")


# -- sets of keys of each minimizer, by a shuffle of packed numbers


@lru_cache
def _kept(l: int) -> list[tuple[int, int, int]]:
    """The spans of bits that the seed keeps of an l-mer: where they begin, where they go, how many they are."""
    mask, out, to, i = seed_mask() & ((1 << 2 * l) - 1), [], 0, 0
    while mask >> i:
        n = 0
        while mask >> (i + n) & 1:
            n += 1
        if n:
            out.append((i, to, n))
            to += n
        i += n or 1
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """Each value once, in order. By sorting: numpy's own ``unique`` hashes, which takes many times longer on millions."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def mixed_bits(l: int = L) -> int:
    return sum(n for _, _, n in _kept(l))


def mixed_of(minimizers: np.ndarray, l: int = L) -> np.ndarray:
    """Minimizers without the bits that the seed drops, times an odd factor: numbers of :func:`mixed_bits` bits that are even over their range."""
    out = np.zeros(len(minimizers), dtype=np.uint64)
    for i, to, n in _kept(l):
        out |= ((minimizers >> np.uint64(i)) & np.uint64((1 << n) - 1)) << np.uint64(to)
    out *= np.uint64(_FACTOR)
    return out & np.uint64((1 << mixed_bits(l)) - 1)


def unmixed(mixed: np.ndarray, l: int = L) -> np.ndarray:
    dense = (mixed * np.uint64(_INVERSE)) & np.uint64((1 << mixed_bits(l)) - 1)
    out = np.zeros(len(mixed), dtype=np.uint64)
    for i, to, n in _kept(l):
        out |= ((dense >> np.uint64(to)) & np.uint64((1 << n) - 1)) << np.uint64(i)
    return out


def pack_steps(first: np.ndarray, steps: np.ndarray) -> tuple[int, bytes]:
    """The width of the differences in bytes, and the first number whole before them."""
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return width, first.tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_steps(width: int, packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, dtype=np.uint8)
    out = np.zeros(((len(raw) - 8) // width + 1, 8), dtype=np.uint8)
    out[0] = raw[:8]
    out[1:, :width] = raw[8:].reshape(-1, width)
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def _pack(found: dict[str | None, list[np.ndarray]], l: int) -> pa.RecordBatch:
    """A row for each key and bucket: the sorted products of its minimizers, the first whole, then differences of ``width`` bytes."""
    rows: list[tuple] = []
    for key, parts in found.items():
        mixed = distinct(mixed_of(np.concatenate(parts), l))
        bucket = (mixed >> np.uint64(max(0, mixed_bits(l) - BUCKET_BITS))).astype(np.int32)
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        steps = np.diff(mixed, prepend=np.uint64(0))
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(mixed)]):
            rows.append((int(bucket[i]), key, *pack_steps(mixed[i : i + 1], steps[i + 1 : j])))
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["bucket", "key", "width", "packed"])


def _sets_of(found: dict[str | None, list[np.ndarray]], l: int) -> Iterator[pa.RecordBatch]:
    """The minimizers of one bucket with the keys that have them, some thousand at once."""
    keys = sorted(found, key=lambda x: (x is None, x))
    each = [distinct(np.concatenate(found[x])) for x in keys]
    values = np.concatenate(each)
    order = np.argsort(values, kind="stable")  # keys stay in order
    values, own = values[order], np.repeat(np.arange(len(keys), dtype=np.int32), [len(x) for x in each])[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    minimizers = unmixed(values[starts], l).view(np.int64)
    names, ends = pa.array(keys, pa.string()), np.append(starts, len(values))
    for i in range(0, len(starts), 1 << 14):
        j = min(i + (1 << 14), len(starts))
        lists = pa.ListArray.from_arrays(pa.array((ends[i : j + 1] - ends[i]).astype(np.int32)), names.take(pa.array(own[ends[i] : ends[j]])))
        yield pa.RecordBatch.from_arrays([pa.array(minimizers[i:j]), lists], names=["minimizer", "keys"])


def key_sets(records: DataFrame, key: str, k: int = K, l: int = L, segment: int = SEGMENT) -> DataFrame:
    """``(minimizer, keys)``: each minimizer of ``records(key, seq)`` once, with the sorted texts of the few keys that have it."""
    return by_bucket(records, key, lambda found: _sets_of(found, l), "minimizer long, keys array<string>", k, l, segment)


def by_bucket(records: DataFrame, key: str, finish: Callable, schema: str, k: int = K, l: int = L, segment: int = SEGMENT) -> DataFrame:
    """What ``finish`` makes of each bucket of the minimizers of ``records(key, seq)``, a list of arrays of :func:`mixed_of` numbers for each key.

    Sorted runs of minimizers are shuffled as differences, some four bytes each where a row would take three times that or more, and
    come together in buckets that one task after the other unpacks. Buckets follow a product of the minimizer, so they are even.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = {}, 0
        for batch in batches:
            texts, at = batch.column(0).to_pylist(), 0
            for raw, offsets in _blocks(batch.column(1)):
                values, _, ends = _runs_of(raw, offsets, k, l)
                owners = texts[at : at + len(offsets) - 1]
                at += len(owners)
                names = list(dict.fromkeys(owners))
                who = np.repeat(np.array([names.index(x) for x in owners]), np.diff(ends))
                for i, name in enumerate(names):
                    part = values[(who == i) & (values != _NONE)]
                    if len(part):
                        part = distinct(part)
                        found.setdefault(name, []).append(part)
                        held += len(part)
                if held >= HELD:
                    yield _pack(found, l)
                    found, held = {}, 0
        if found:
            yield _pack(found, l)

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, now = {}, None
        for batch in batches:
            for bucket, name, width, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    if found:
                        yield from finish(found)
                    found, now = {}, bucket
                found.setdefault(name, []).append(unpack_steps(width, packed))
        if found:
            yield from finish(found)

    pieces = records.select(F.col(key).cast("string").alias("key"), F.explode(sequence.segments(F.col("seq"), k, segment)).alias("piece")).select("key", "piece.bases")
    packed = pieces.mapInArrow(scan, "bucket int, key string, width int, packed binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(gather, schema)
