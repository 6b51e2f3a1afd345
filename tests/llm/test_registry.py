import glob
import os

import duckdb
import pytest

from drawforge.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    df = queries.QUERIES[name](spark, sf)
    cur = con.execute(queries.ORACLE[name])
    cols = [c[0] for c in cur.description]
    key = lambda r: tuple(repr(x) for x in r)
    want = sorted((tuple(r) for r in cur.fetchall()), key=key)
    assert sorted(df.columns) == sorted(cols)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=key) == want
