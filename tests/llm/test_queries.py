"""The registered queries: against DuckDB where they have SQL, and on odd and empty tables."""

import os
from collections import Counter

import duckdb
import pytest

from strandex.llm import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CLASHES = "shard int, size string, score double, component_id long, fp string, digest string, n long, rate double, keep_id int, row string, key string, items int, t int, handle int, quality int, leaks int, grams int, words int"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, name):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    frame = registry.queries()[name](spark, FOLDER)
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    columns = sorted(frame.columns)
    assert sorted(names) == columns
    want = Counter(tuple(row[names.index(c)] for c in columns) for row in found.fetchall())
    assert Counter(map(tuple, frame.select(*columns).collect())) == want


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with nulls, blanks, a long text, repeated rows and clashing columns, and the same tables without rows."""
    more = len(CLASHES.split(","))
    texts = [(None, None, None, None), (None, "", "en", "s"), (1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (2, "x " * 60000, "en", "s"), (3, "MIT License\nMIT License\n\n", "fr", "t")]
    texts += [(4, "\n\n\n", "en", "s"), (5, "é   z\x00q", "de", "s"), (6, "The quick brown fox.\nSecond line here.", None, None)]
    tables = {
        "documents": ([(*r, 1, *[None] * more) for r in texts], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"),
        "labels": ([(1, 1, 0, "x"), (3, 0, 0, "x"), (None, 1, None, None), (9, None, None, None), (1, 1, 0, "x")], "doc_id long, quality int, toxic int, text string"),
        "benchmark": ([(1, "a b c"), (None, None), (2, "")], "item_id long, text string"),
        "pages": ([(1, "u", None, "x"), (None, None, "<p>x", "y"), (1, "u", "<p>a", "z")], "page_id long, url string, html string, text string"),
        "conversations": ([(0, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", "a"), (2, None, None, None), (2, None, None, None)], "conv_id long, turn long, role string, text string"),
    }
    out = {}
    for kind in ("odd", "empty"):
        out[kind] = str(tmp_path_factory.mktemp(kind))
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows if kind == "odd" else [], schema).write.parquet(f"{out[kind]}/{name}.parquet")
    return out


ROWS = {"op1_simhash": 9, "op2_licence": 1, "op3_exact": 9, "op4_decontaminate": 9, "op5_lines": 9, "op6_preferences": 2, "op7_shard": 9, "op9_quality": 9, "op10_extract": 3}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_odd_and_empty_tables(spark, odd, name):
    query = registry.queries()[name]
    assert query(spark, odd["empty"]).count() == 0
    rows = query(spark, odd["odd"]).collect()
    assert name not in ROWS or len(rows) == ROWS[name]
