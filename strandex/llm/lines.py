"""Near-duplicate lines by MinHash over character shingles, verified exactly, one line kept of each component.

DataFrame functions only, from the split into lines to the components.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strandex.llm.common import cut, release, table
from strandex.llm.components import connected_components

#: Characters of a shingle; rows of a band, values of a row and bands; least Jaccard.
SHINGLE, ROWS, VALUES, BANDS, JACCARD = 8, 4, 8, 18, 0.8
SEED = 23
#: Shingles that a row of the signing aggregation takes.
STEP = 16
#: Lines with a neighbour in a band whose handles may be broadcast (some 24 bytes each).
MOST_HANDLES = 1_000_000
#: Members up to which the pairs of a bucket are compared as they are; larger buckets are dealt by rare shingles first.
SMALL = 32
#: What is trimmed: white space as Unicode has it.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: 64-bit words of a line's bit map, and lines whose maps (some 300 bytes each) may be broadcast.
MAP_WORDS, MOST_MAPS = 32, 100_000


def shingles(line: str, size: int = SHINGLE) -> set[str]:
    """The distinct runs of ``size`` characters; a shorter line is one shingle. (The plain model, for tests.)"""
    return {line[i : i + size] for i in range(max(1, len(line) - size + 1))}


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


# -- lines, shingles, signatures ------------------------------------------------------------------------------------


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often lambdas in it refer to it."""
    return F.transform(F.array(value), body)[0]


def _handle(line: Column) -> Column:
    """48 bits of a line's hash: the two highest bytes are zero, as the bytes after them in a shuffled row are, so they compress to nothing."""
    return F.shiftrightunsigned(F.xxhash64(line), 16)


def _units(line: Column) -> Column:
    return F.encode(line, "UTF-16BE")


def _last(units: Column) -> Column:
    """Where the last shingle begins."""
    return F.greatest(F.shiftright(F.octet_length(units), 1) - SHINGLE, F.lit(0))


def _hash(units: Column, at: Column) -> Column:
    return F.xxhash64(F.substring(units, at * 2 + 1, F.lit(2 * SHINGLE)))


def _all_hashes(line: Column) -> Column:
    """The 64-bit hashes of the shingles of a line, repeats included. The lambda isn't compiled, so it does no arithmetic."""
    return _let(_units(line), lambda u: F.transform(F.sequence(F.lit(1), _last(u) * 2 + 1, F.lit(2)), lambda i: F.xxhash64(F.substring(u, i, F.lit(2 * SHINGLE)))))


def shingle_hashes(line: Column) -> Column:
    """The 64-bit hashes of the distinct shingles of a line."""
    return F.array_distinct(_all_hashes(line))


def _similarity(a: Column, b: Column) -> Column:
    """Jaccard of the sets of two arrays of hashes."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, line_no, line)`` of every line that isn't blank, trimmed of outer white space.

    A line whose first and last byte are ASCII and above the space has nothing to trim, which spares most the slower search.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    code = F.col("line").cast("binary")
    bare = F.lit(True)
    for at in (1, -1):
        end = F.substring(code, F.lit(at), F.lit(1))
        bare = bare & (end > F.lit(b" ")) & (end < F.lit(b"\x80"))
    trimmed = F.btrim("line", F.lit(WHITE))
    return rows.where(bare | (trimmed != "")).select("doc_id", "line_no", F.when(bare, F.col("line")).otherwise(trimmed).alias("line"))


def signatures(lines: DataFrame) -> DataFrame:
    """``(digest, handle, m0, m1, ...)`` for ``lines(digest, line, handle)``, a row for each digest and partitioned by it.

    Value q of row r is the least of all shingles' hashes, turned by 16 r bits, each in exclusive or with a constant: the hash
    that is next to a random point of an order of its own for each row. Shingles are hashed STEP to a row and their
    least values found there, so the aggregation sees a sixteenth of the rows.
    """
    rnd = random.Random(SEED)
    points = [[rnd.getrandbits(64) - (1 << 63) for _ in range(VALUES)] for _ in range(ROWS)]
    units = lines.select("digest", "handle", _units(F.col("line")).alias("u")).withColumn("last", _last(F.col("u")))
    places = units.select("digest", "handle", "u", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(STEP))).alias("i"))
    hashed = places.select("digest", "handle", *[_hash(F.col("u"), F.least(F.col("i") + k, F.col("last"))).alias(f"h{k}") for k in range(STEP)])

    def turned(h: Column, r: int) -> Column:
        return h if r == 0 else F.shiftleft(h, 16 * r).bitwiseOR(F.shiftrightunsigned(h, 64 - 16 * r))

    def least(r: int, point: int) -> Column:
        return F.min(F.least(*[turned(F.col(f"h{k}"), r).bitwiseXOR(F.lit(point)) for k in range(STEP)]))

    return hashed.groupBy("digest", "handle").agg(*[least(r, p).alias(f"m{r * VALUES + q}") for r, row in enumerate(points) for q, p in enumerate(row)])


def band_keys(bands: int = BANDS) -> list[Column]:
    """Of columns m0, m1, ...: a key for each band. Band (t, a) takes value a + r t of row r: no two share more than one.

    A key has 48 bits; the two lowest bytes are zero, as the bytes before them in a shuffled row are. Lines that share a key by chance are told
    apart as those that share a band for little likeness are, by their sets of shingles.
    """
    picks = [[r * VALUES + (b % VALUES + r * (b // VALUES)) % VALUES for r in range(ROWS)] for b in range(bands)]
    return [F.xxhash64(*[F.col(f"m{i}") for i in pick], F.lit(b)).bitwiseAND(F.lit(-1 << 16)) for b, pick in enumerate(picks)]


# -- verification -----------------------------------------------------------------------------------------------------


def _ends(pairs: DataFrame, lines: DataFrame, name: str) -> DataFrame:
    """``pairs(a, b)`` of handles with the columns of ``lines(handle, ...)``, as ``a_...`` or ``b_...``."""
    end = lines.select(F.col("handle").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in lines.columns if c != "handle"])
    return pairs.join(end, name)


def _near(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Edges ``(a, b)`` between digests: the ``pairs(a, b)`` of handles whose lines are alike; ``texts(handle, digest, line)``."""
    both = _ends(_ends(pairs, texts, "a"), texts, "b").where("a_digest <> b_digest")
    # a filter isn't moved below a column that isn't deterministic; moved, it would make the hashes anew wherever it names them
    once = F.monotonically_increasing_id().alias("once")
    sets = both.select("a_digest", "b_digest", _all_hashes(F.col("a_line")).alias("sa"), _all_hashes(F.col("b_line")).alias("sb"), once)
    near = sets.where((F.col("once") >= 0) & (_similarity(F.col("sa"), F.col("sb")) >= least))
    return near.select(F.col("a_digest").alias("a"), F.col("b_digest").alias("b"))


def _possible(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The ``pairs(a, b)`` that bit maps of their shingles don't rule out.

    A bit that is set in one map only stands for at least one shingle that is in one set only. With x and y such bits and
    n places of shingles, the similarity is at most (n - x) / (n + y), so nothing that could be near is lost.
    """
    some = pairs.select(F.col("a").alias("handle")).union(pairs.select(F.col("b").alias("handle"))).distinct()
    units = texts.join(some, "handle", "left_semi").select("handle", "digest", _units(F.col("line")).alias("u")).withColumn("last", _last(F.col("u")))
    places = units.select("handle", "digest", "u", "last", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("i"))
    hashed = places.select("handle", "digest", "last", _hash(F.col("u"), F.col("i")).alias("h"))
    one = F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 58) AS int))")
    words = hashed.groupBy("handle", "digest", "last", F.col("h").bitwiseAND(F.lit(MAP_WORDS - 1)).alias("w")).agg(F.bit_or(one).alias("bits"))
    maps = words.groupBy("handle", "digest").agg((F.max("last") + 1).alias("n"), *[F.coalesce(F.max(F.when(F.col("w") == k, F.col("bits"))), F.lit(0)).alias(f"m{k}") for k in range(MAP_WORDS)])
    maps = cut(maps.drop("digest"))
    if maps.count() <= MOST_MAPS:
        maps = F.broadcast(maps)
    both = _ends(_ends(pairs, maps, "a"), maps, "b")
    alone = {
        (x, y): sum((F.bit_count(F.col(f"{x}_m{k}").bitwiseAND(F.bitwise_not(F.col(f"{y}_m{k}")))) for k in range(MAP_WORDS)), F.lit(0)) for x, y in ("ab", "ba")
    }
    both = both.select("a", "b", "a_n", "b_n", alone["a", "b"].alias("x"), alone["b", "a"].alias("y"))
    return both.where((F.col("a_n") - F.col("x") >= least * (F.col("a_n") + F.col("y"))) & (F.col("b_n") - F.col("y") >= least * (F.col("b_n") + F.col("x")))).select("a", "b").distinct()


def _with_pivots(buckets: DataFrame) -> DataFrame:
    """``(key, handle, pivot)`` of the buckets with several lines: the pivot is the line that meets most others in all its buckets."""
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = buckets.join(sizes, "key")
    scores = met.groupBy("handle").agg(F.sum("n").alias("score"))
    scored = cut(met.join(scores, "handle"))
    pivots = scored.groupBy("key").agg(F.max(F.struct("score", "handle"))["handle"].alias("pivot"))
    return scored.select("key", "handle").join(pivots, "key")


def _stars(buckets: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: each member of ``buckets(key, handle, pivot)`` with the pivot of its bucket."""
    return buckets.where("handle <> pivot").select(F.least("pivot", "handle").alias("a"), F.greatest("pivot", "handle").alias("b")).distinct()


def _open(buckets: DataFrame, texts: DataFrame, edges: DataFrame) -> DataFrame:
    """``buckets`` with ``root`` and ``n``, where members are of several components; of buckets with the same members, one.

    Where there are ``place``s, that one is the bucket of the rarest shingle, which bounds the similarity of its pairs least.
    """
    roots = connected_components(edges).withColumnRenamed("node", "digest")
    labels = texts.select("handle", "digest").join(roots, "digest", "left").select("handle", F.coalesce("root", "digest").alias("root"))
    members = buckets.join(labels, "handle")
    at = F.sum("place") if "place" in buckets.columns else F.lit(0)
    mixes = [F.bit_xor(F.xxhash64("handle", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    sets = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), *mixes, at.alias("at"))
    left = sets.where("n > 2 AND low <> high").groupBy("n", "x1", "x2").agg(F.min(F.struct("at", "key"))["key"].alias("key")).select("key", "n")
    return cut(members.join(left, "key"))


def _across(members: DataFrame, more: Column | None = None) -> DataFrame:
    """``(a, b)``: the pairs of handles of a bucket that are of different components."""
    left = members.select("key", *[F.col(c).alias(f"a_{c}") for c in members.columns if c != "key"])
    right = members.select("key", *[F.col(c).alias(f"b_{c}") for c in members.columns if c != "key"])
    pairs = left.join(right, (left["key"] == right["key"]) & F.expr("a_handle < b_handle AND a_root <> b_root") & (F.lit(True) if more is None else more))
    return pairs.select(F.col("a_handle").alias("a"), F.col("b_handle").alias("b")).distinct()


def _by_rare_shingles(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """``(key, handle, size, place)``: the lines of ``members`` in a bucket for each of their rarest shingles.

    Two sets whose Jaccard similarity is ``least`` share one of the rarest n - ceil(least n) + 1 of each set's n, in any
    order that is the same for all; so no link is lost, and what many unlike lines have in common isn't among these.
    """
    sets = texts.join(members.select("handle").distinct(), "handle", "left_semi").select("handle", shingle_hashes(F.col("line")).alias("s"))
    tokens = cut(sets.select("handle", F.size("s").alias("size"), F.explode("s").alias("key")))
    ranked = tokens.join(tokens.groupBy("key").agg(F.count("*").alias("df")), "key")
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("handle").orderBy("df", "key")))
    rare = ranked.where((F.col("df") > 1) & (F.col("place") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1))
    return cut(rare.select("key", "handle", "size", "place"))


def _may_be_near(a: str, b: str, least: float) -> Column:
    """Whether two sets can be near if the shingle at ``place`` of ``size`` in their orders is the first they share: a near pair passes in that one's bucket."""
    both = F.least(F.expr(f"{a}size - {a}place"), F.expr(f"{b}size - {b}place")) + 1
    return both >= F.expr(f"{a}size + {b}size") * (least / (1 + least)) - 1e-6


def links(shared: DataFrame, texts: DataFrame, least: float, twos: DataFrame | None = None) -> DataFrame:
    """Edges ``(a, b)`` between digests that connect what pairs at ``least`` or more connect within buckets of ``shared(key, handle)``.

    ``twos(a, b)``, a < b, are the handles of buckets with just two members: a pair each, with no pivot to choose. First every member of a bucket is compared with the bucket's pivot. Then only buckets of which the members are still in
    several components matter, and in them only pairs across components: in buckets of up to SMALL members those that bit maps
    don't rule out; larger buckets are dealt anew by their rarest shingles, where the places of a shared shingle in
    both sets bound the similarity. So no pair of a bucket that could connect anything is left out, a large bucket of lines that
    are alike costs its size, and so does one of lines that are not.
    """
    buckets = cut(_with_pivots(shared))
    stars = _stars(buckets)
    if twos is not None:
        stars = cut(stars.unionByName(twos).distinct())
    edges = cut(_near(stars, texts, least))
    left = _open(buckets.select("key", "handle"), texts, edges)
    release(texts.sparkSession)
    pairs = _across(left.where(F.col("n") <= SMALL))
    large = left.where(F.col("n") > SMALL)
    if not large.isEmpty():
        rare = _by_rare_shingles(large, texts, least)
        again = cut(_with_pivots(rare.select("key", "handle")))
        edges = cut(edges.unionByName(_near(_stars(again).join(stars, ["a", "b"], "left_anti"), texts, least)).distinct())
        places = _open(rare, texts, edges)
        pairs = pairs.unionByName(_across(places, _may_be_near("a_", "b_", least))).distinct()
    pairs = cut(pairs.join(stars, ["a", "b"], "left_anti"))
    release(texts.sparkSession)
    return edges.unionByName(_near(_possible(pairs, texts, least), texts, least))


# -- the operator -----------------------------------------------------------------------------------------------------


def _classes(docs: DataFrame, id_col: str, text_col: str, least: float) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, line_no, digest)`` of every line that isn't blank, and ``(digest, keep)`` of those that occur or are linked with another: the occurrence kept.

    Lines are cut at newlines, numbered from 0 and trimmed of white space. Equal lines are one node (by a 128-bit digest), so a line that is
    everywhere never meets itself; each task combines its copies before any shuffle. A shingle is a run of SHINGLE
    characters (UTF-16 units), a shorter line is one shingle. Lines that share a band are compared by the exact Jaccard similarity of
    their sets of shingles, of which 64-bit hashes stand for the shingles; components of pairs at ``least`` or more keep the occurrence with the least
    (doc_id, line_no), null ids first. Banding finds a pair at 0.8 with probability 0.999 and closer ones with more.

    Null, empty and blank texts have no lines; an empty table gives no rows; rows that repeat give their occurrences
    again; other columns of ``docs``, whatever their names, aren't read.
    """
    rows = _lines(docs, id_col, text_col)
    digest = F.unhex(F.md5("line")).alias("digest")
    # in the buckets a line is a 48-bit handle; lines that share one are told apart by digest
    handle = _handle(F.col("line")).alias("handle")
    lines = rows.select(digest, "line").groupBy("digest").agg(F.any_value("line").alias("line"))
    signed = signatures(lines.select("digest", "line", handle))
    banded = signed.select(F.explode(F.array(*band_keys())).alias("key"), "handle")
    bucket = Window.partitionBy("key")
    sizes = [F.max("handle").over(bucket).alias("high"), F.min("handle").over(bucket).alias("low"), F.count("*").over(bucket).alias("n")]
    shared = cut(banded.select("key", "handle", *sizes).where("low <> high").drop("low"))
    release(docs.sparkSession)
    wanted = cut(shared.select("handle").distinct())
    if wanted.count() <= MOST_HANDLES:
        wanted = F.broadcast(wanted)
    # one scan for both: where every line is, and the texts of those that share a bucket
    found = rows.select("doc_id", "line_no", digest, "line", handle).join(wanted.withColumn("shares", F.lit(True)), "handle", "left")
    found = cut(found.select("doc_id", "line_no", "digest", F.when(F.col("shares"), F.col("handle")).alias("handle"), F.when(F.col("shares"), F.col("line")).alias("line")))
    texts = cut(found.where("handle IS NOT NULL").groupBy("handle", "digest").agg(F.any_value("line").alias("line")))
    twos = shared.where("n = 2 AND handle < high").select(F.col("handle").alias("a"), F.col("high").alias("b"))
    edges = links(shared.where("n > 2").select("key", "handle"), texts, least, twos)
    roots = connected_components(edges).withColumnRenamed("node", "digest")
    found = found.select("doc_id", "line_no", "digest")
    firsts = found.groupBy("digest").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n"))
    several = cut(firsts.join(roots, "digest", "left").where("n > 1 OR root IS NOT NULL").select("digest", "first", "root"))
    keeps = several.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("keep"))
    classes = several.join(keeps, "root", "left").select("digest", F.when(F.col("keep").isNull(), F.col("first")).otherwise(F.col("keep")).alias("keep"))
    return found, classes


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = JACCARD) -> DataFrame:
    """``(doc_id, line_no, keep_doc, keep_line)`` of every line that isn't blank: the occurrence that its class keeps (:func:`_classes`)."""
    found, classes = _classes(docs, id_col, text_col, least)
    keep = [F.when(F.col("keep").isNull(), F.col(own)).otherwise(F.col(f"keep.{own}")).alias(name) for own, name in (("doc_id", "keep_doc"), ("line_no", "keep_line"))]
    return found.join(classes, "digest", "left").select("doc_id", "line_no", *keep)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = JACCARD) -> DataFrame:
    """``(doc_id, dropped)``: for each id with lines that go, their numbers in order."""
    found, classes = _classes(docs, id_col, text_col, least)
    gone = found.join(classes, "digest").where(~(F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("line_no") == F.col("keep.line_no"))))
    return gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with their dropped lines taken out of the text; rows that share an id lose the same numbers."""
    gone = dropped.select(F.col("doc_id").alias("__doc"), F.col("dropped").alias("__gone"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    joined = whole.join(gone, F.col("__row")[id_col].eqNullSafe(F.col("__doc")), "left")
    kept = F.filter(F.split(F.col("__row")[text_col], "\n"), lambda _, i: ~F.array_contains("__gone", i))
    text = F.when(F.col("__gone").isNull(), F.col("__row")[text_col]).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[(text if c == text_col else F.col("__row")[c]).alias(c) for c in docs.columns])


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    gone = dropped_lines(docs).withColumnRenamed("doc_id", "__doc")
    breaks = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    counts = docs.select("doc_id", (F.coalesce(breaks, F.lit(0)) + 1).alias("n_lines"))
    out = counts.join(gone, counts["doc_id"].eqNullSafe(gone["__doc"]), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", dropped.alias("dropped"), (F.col("n_lines") - F.size(dropped)).alias("n_kept"))
