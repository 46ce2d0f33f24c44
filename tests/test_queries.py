"""Every registered query of the engine with SQL gives what DuckDB gives, over whole tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from strandex.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def tidy(v):
    if isinstance(v, float) and not math.isnan(v):
        return float(f"{v:.9g}")
    return tuple(map(tidy, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    frame = registry.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = Counter(tuple(tidy(row[names.index(c)]) for c in columns) for row in found.fetchall())
    assert Counter(tuple(map(tidy, row)) for row in frame.select(*columns).collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
