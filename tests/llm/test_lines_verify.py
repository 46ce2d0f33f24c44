"""Verification of line pairs: what is computed once, which bucket stands for others, what is trimmed."""

import random

from strandex.llm import lines
from tests.llm.test_lines import linked


def test_shingles_of_a_pair_are_hashed_once(spark):
    texts = spark.createDataFrame([(1, b"1", "a line that is near"), (2, b"2", "a line that is nearer")], "handle long, digest binary, line string")
    near = lines._near(spark.createDataFrame([(1, 2)], "a long, b long"), texts, 0.1)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambdafunction(xxhash64(") == 2
    assert [(r.a, r.b) for r in near.collect()] == [(b"1", b"2")]


def test_of_buckets_with_the_same_members_the_rarest_shingle_stays(spark):
    """In bucket 1 the shared shingle is so late that its pairs couldn't be near; in bucket 2 it is the first."""
    rows = [(key, h, 100, place) for key, place in ((1, 20), (2, 1)) for h in (1, 2, 3)]
    buckets = spark.createDataFrame(rows, "key long, handle long, size int, place int")
    texts = spark.createDataFrame([(h, bytes([h]), "x") for h in (1, 2, 3)], "handle long, digest binary, line string")
    left = lines._open(buckets, texts, spark.createDataFrame([(b"\1", b"\2")], "a binary, b binary"))
    assert {r.key for r in left.collect()} == {2}
    assert lines._across(left, lines._may_be_near("a_", "b_", 0.8)).count() == 2


def test_buckets_of_two_may_come_as_pairs(spark):
    rnd = random.Random(15)
    line = lambda: "".join(rnd.choice("abcdefghij ") for _ in range(120))
    texts = [x for _ in range(20) for one in [line()] for x in (one, one[:-3] + "xyz", line())]
    frame = spark.createDataFrame([(i, i.to_bytes(4, "big"), x) for i, x in enumerate(texts)], "handle long, digest binary, line string")
    shared = spark.createDataFrame([(i, 3 * i + k) for i in range(10) for k in range(3)], "key long, handle long")
    twos = spark.createDataFrame([(3 * i, 3 * i + k) for i in range(10, 20) for k in (1, 2)], "a long, b long")
    got = linked((int.from_bytes(e.a, "big"), int.from_bytes(e.b, "big")) for e in lines.links(shared, frame, lines.JACCARD, twos).collect())
    assert got == {frozenset((3 * i, 3 * i + 1)) for i in range(20)}


def test_lines_are_trimmed_of_all_white_space(spark):
    ends = ["", " ", "\t", "\x1c", "\x85", "\xa0", " ", "　", "é", "\x7f", "\x01", "　\t", "日"]
    own = [a + "a line" + b for a in ends for b in ends] + ends
    docs = spark.createDataFrame([(1, "\n".join(own))], "doc_id long, text string")
    got = {r.line_no: r.line for r in lines._lines(docs, "doc_id", "text").collect()}
    assert got == {i: x.strip() for i, x in enumerate(own) if x.strip()}
