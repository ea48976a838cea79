import os

import duckdb
import pytest
from frametide.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = con.execute(ORACLE_SQL[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == cols
    assert got == sorted((tuple(plain(r[at.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
