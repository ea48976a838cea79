import os

import __spark_entry__ as entry
import duckdb
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = "/root/testdata/sf0.001"
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    return v


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = duck.execute(entry.oracle_sql()[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == cols
    assert got == sorted((tuple(plain(r[at.index(c)]) for c in cols) for r in found.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
