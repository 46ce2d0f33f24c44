"""Line deduplication against brute force over all pairs of lines."""

import random

from pyspark.sql import functions as F

from strandex.llm import lines

DOCS = "doc_id long, text string, digest string, band string"


def brute(docs):
    occurrences = [(i, n, x.strip()) for i, t in docs for n, x in enumerate((t or "").split("\n")) if x.strip()]
    texts = sorted({x for _, _, x in occurrences})
    sets = [lines.shingles(x) for x in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if lines.jaccard(sets[i], sets[j]) >= lines.JACCARD:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    at = {x: find(i) for i, x in enumerate(texts)}
    least = {}
    for i, n, x in occurrences:
        least[at[x]] = min(least.get(at[x], (i, n)), (i, n))
    return {(i, n): least[at[x]] for i, n, x in occurrences}


def test_lines_against_brute_force(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 9)))
    pool = [" ".join(word() for _ in range(rnd.choice([1, 3, 30, 60]))) for _ in range(60)]
    docs = []
    for i in range(80):
        own = [rnd.choice(pool) for _ in range(rnd.randint(0, 5))]
        for k, line in enumerate(own):
            if len(line) > 100 and rnd.random() < 0.5:
                at = rnd.randrange(len(line))
                own[k] = line[:at] + rnd.choice(["x", "", "yy"]) + line[at + 1 :]
        docs.append((i, "\n".join(own + rnd.choice([[], ["", "  "], ["  common line here \t"]]))))
    docs += [(80, None), (81, ""), (82, docs[0][1]), (83, "long " * 40000 + "\nlast"), (84, "long " * 40000 + "!")]
    got = lines.line_classes(spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS)).collect()
    assert {(r.doc_id, r.line_no): (r.keep_doc, r.keep_line) for r in got} == brute(docs)


def test_texts_without_dropped_lines(spark):
    rows = [(1, "a first line\nsame\n\nsame", "x", "y"), (2, "same\nother", None, None), (2, "same\nother", None, None), (3, None, None, None), (None, "same", None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    out = lines.without(docs, lines.dropped_lines(docs))
    assert out.columns == docs.columns
    got = sorted(((r.doc_id or 0), r.text or "") for r in out.collect())
    assert got == [(0, "same"), (1, "a first line\n"), (2, "other"), (2, "other"), (3, "")]
    assert lines.dropped_lines(docs.limit(0)).count() == 0


def band_keys(spark, texts):
    """The band keys of each line, in their order."""
    frame = spark.createDataFrame([(i.to_bytes(4, "big"), x, i) for i, x in enumerate(texts)], "digest binary, line string, handle long")
    rows = lines.signatures(frame).select("handle", F.array(*lines.band_keys()).alias("keys")).collect()
    return [set(r.keys) for r in sorted(rows, key=lambda r: r.handle)]


def test_recall_of_the_bands(spark):
    rnd = random.Random(9)
    pairs = []
    for _ in range(300):
        line = "".join(rnd.choice("abcdefgh ") for _ in range(200))
        other = list(line)
        other[rnd.randrange(20, 180)] = "#"
        other = "".join(other)
        if lines.jaccard(lines.shingles(line), lines.shingles(other)) >= lines.JACCARD:
            pairs += [line, other]
    keys = band_keys(spark, pairs)
    assert len(pairs) > 400
    assert sum(bool(a & b) for a, b in zip(keys[::2], keys[1::2])) >= 0.98 * len(pairs) / 2


def test_recall_by_length(spark):
    """Pairs at 0.80 to 0.85 of lines of 16 to 300 characters."""
    rnd = random.Random(10)
    line = lambda n: "".join(rnd.choice("abcdefgh ijklmnop") for _ in range(n))
    for n in (16, 24, 40, 90, 300):
        pairs = []
        while len(pairs) < 800:
            a = line(n)
            b = a[: n - rnd.randint(0, n // 6)] + line(rnd.randint(0, n // 6))
            if 0.8 <= lines.jaccard(lines.shingles(a), lines.shingles(b)) < 0.85:
                pairs += [a, b]
        keys = band_keys(spark, pairs)
        assert sum(bool(a & b) for a, b in zip(keys[::2], keys[1::2])) >= 0.985 * len(pairs) / 2


def linked(edges):
    """The components of edges, as sets."""
    at = {}
    for a, b in edges:
        joined = at.get(a, {a}) | at.get(b, {b})
        for x in joined:
            at[x] = joined
    return {frozenset(x) for x in at.values()}


def test_large_buckets_lose_no_link(spark):
    """All lines in one bucket: chains, variants of one line, and lines that have only a template in common."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(60)]
    texts = []
    for _ in range(120):  # variants with one to nine of sixty words changed
        own = list(base)
        for at in rnd.sample(range(60), rnd.randint(1, 9)):
            own[at] = word()
        texts.append(" ".join(own))
    chain = [word() for _ in range(90)]
    texts += [" ".join(chain[i : i + 60]) for i in range(0, 30, 2)]
    template = " ".join(word() for _ in range(30))
    texts += [template + " " + " ".join(word() for _ in range(30)) for _ in range(100)]
    texts = sorted(set(texts))
    rows = [(i, i.to_bytes(4, "big"), x) for i, x in enumerate(texts)]
    frame = spark.createDataFrame(rows, "handle long, digest binary, line string")
    shared = spark.createDataFrame([(b, i) for i in range(len(texts)) for b in (1, 2)] + [(3, 0), (3, 1)], "key long, handle long")
    got = linked((int.from_bytes(e.a, "big"), int.from_bytes(e.b, "big")) for e in lines.links(shared, frame, lines.JACCARD).collect())
    sets = [lines.shingles(x) for x in texts]
    want = linked((i, j) for i in range(len(texts)) for j in range(i) if lines.jaccard(sets[i], sets[j]) >= lines.JACCARD)
    assert got == want and len(want) > 1


def test_a_bucket_of_unlike_lines_ends(spark):
    """4,000 lines that share a template: no quadratic number of pairs is compared or kept."""
    rnd = random.Random(13)
    template = "".join(rnd.choice("abcdefghij ") for _ in range(60))
    texts = [template + "".join(rnd.choice("abcdefghij ") for _ in range(60)) for _ in range(4000)]
    frame = spark.createDataFrame([(i, i.to_bytes(4, "big"), x) for i, x in enumerate(texts)], "handle long, digest binary, line string")
    shared = spark.createDataFrame([(1, i) for i in range(len(texts))], "key long, handle long")
    assert lines.links(shared, frame, lines.JACCARD).count() == 0
