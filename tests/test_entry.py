import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "label" in df.columns


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
@pytest.mark.parametrize("name", [n for n in entry.core.queries() if n in entry.core.oracle_sql()])
def test_core_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute("set timezone='UTC'")
    for f in os.listdir(SMALL):
        db.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    got = entry.core.queries()[name](spark, SMALL)
    wanted = db.sql(entry.core.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)
    rows = lambda rs, names: sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in rs)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(wanted.fetchall(), list(wanted.columns))
