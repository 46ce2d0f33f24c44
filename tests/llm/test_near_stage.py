"""The pipeline's near-dedup follows the links of fingerprints as well as those of shingles."""

from strandex.llm import near, simhash


def test_stage_unites_links_of_fingerprints(spark):
    one = "s p q r x0 p q r x1 p q r x2 p q r x3 p q r t"  # the four-word shingles of both are the same, in another order
    two = "s p q r x2 p q r x3 p q r x1 p q r x0 p q r t"
    docs = spark.createDataFrame([(5, one), (7, two), (8, two.upper()), (9, "p q r x0 and other words"), (10, None), (11, "")], "doc_id long, text string")
    assert simhash.fingerprint(one) == simhash.fingerprint(two)
    roots = {r.doc_id: bytes(r.root) for r in near.near_classes(docs, keys=("doc_id",)).collect()}
    assert roots[5] != roots[7] == roots[8]
    assert sorted(r.doc_id for r in simhash.one_of_each(spark, docs, "").collect()) == [5, 9, 10]
