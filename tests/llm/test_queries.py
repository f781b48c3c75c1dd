import os

import pytest

from clauseworks.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for f in os.listdir(SMALL):
        db.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    got, wanted = queries.queries()[name](spark, SMALL), db.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)
    rows = lambda rs, names: sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in rs)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(wanted.fetchall(), list(wanted.columns))
