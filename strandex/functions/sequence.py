"""Column functions over nucleotide sequences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from strandex.constants import K, L, SEGMENT, seed_mask, toggle_of


def base_codes(seq: Column) -> Column:
    """A, C, G, T of either case as the digits 0 to 3, every other character as ``.``."""
    digits = F.translate(F.upper(seq), "ACGT", "0123")
    return F.regexp_replace(digits, "[^0123]", ".")


def lmer_code(lmer: Column) -> Column:
    """Two bits a base, the first base highest; null if a base is invalid. At most 31 bases."""
    codes = base_codes(lmer)
    return F.when(~F.contains(codes, F.lit(".")), F.conv(codes, 4, 10).cast("long"))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(F.upper(seq), "ACGT", "TGCA"))


def canonical(lmer: Column) -> Column:
    """The lesser code of an l-mer and its reverse complement; null if a base is invalid."""
    forward, backward = lmer_code(lmer), lmer_code(reverse_complement(lmer))
    return F.when(forward.isNotNull() & backward.isNotNull(), F.least(forward, backward))


def candidate(lmer: Column, l: int = L) -> Column:
    """What a window takes the minimum of: the canonical code through the spaced seed, with the toggle flipped."""
    return canonical(lmer).bitwiseAND(F.lit(seed_mask())).bitwiseXOR(F.lit(toggle_of(l)))


def windows(seq: Column, k: int = K, l: int = L) -> Column:
    """The minimizer of every window of k bases, by array functions alone; null where a window has none.

    A window ends at a valid base after at least k - 1 valid ones in a row, so its first base may be invalid. Meant
    for short sequences and for checking :func:`strandex.operators.minimizers.runs`, which is much faster.
    """
    count = F.length(seq) - k + 1
    lmers = F.transform(F.sequence(F.lit(1), F.greatest(F.length(seq) - l + 1, F.lit(1))), lambda p: candidate(F.substr(seq, p, F.lit(l)), l))

    def window(i: Column) -> Column:  # i: first base, from 1
        tail = base_codes(F.substr(seq, i + 1, F.lit(k - 1)))
        least = F.array_min(F.slice(lmers, i, k - l + 1))
        return F.when(~F.contains(tail, F.lit(".")), least.bitwiseXOR(F.lit(toggle_of(l))))

    out = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), window)
    return F.when(count >= 1, out).otherwise(F.array().cast("array<long>"))


def segments(seq: Column, k: int = K, target: int = SEGMENT) -> Column:
    """``(start, bases)`` pieces of at most ``target`` bases that overlap by k - 1, so that no window is lost or repeated."""
    step = max(1, target - (k - 1))
    last = F.greatest(F.length(seq) - k, F.lit(0))
    starts = F.sequence(F.lit(0), F.floor(last / step).cast("int"))
    return F.transform(starts, lambda i: F.struct((i * step).alias("start"), F.substr(seq, i * step + 1, F.lit(target)).alias("bases")))


def mask_lower(seq: Column) -> Column:
    """Soft-masked (lower-case) bases as ``x``."""
    return F.regexp_replace(seq, "[a-z]", "x")


def wrap(seq: Column, width: int = 80) -> Column:
    """Lines of ``width`` characters."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def first_token(header: Column) -> Column:
    """What stands before the first white space of a header."""
    return F.regexp_extract(header, r"^\s*(\S*)", 1)


def header_taxid(token: Column) -> Column:
    """The taxid that a header carries itself, as in ``kraken:taxid|N|...`` (a fixed format); else null."""
    return F.regexp_extract(token, r"^kraken:taxid\|(\d+)(?:\||$)", 1).try_cast("long")


def archive_path(path: Column) -> Column:
    """The path of the genome in an archive folder, from the folder's address: host removed, file name added."""
    folder = F.regexp_replace(F.regexp_replace(path, r"^(?:https?|ftp)://[^/]*", ""), r"/+$", "")
    return F.concat(folder, F.lit("/"), F.element_at(F.split(folder, "/"), -1), F.lit("_genomic.fna.gz"))
