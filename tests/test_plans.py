import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def cell(v):
    if v is None or v != v:
        return None
    return round(v, 6) if isinstance(v, float) else str(v)


def own():
    from tokenloom.plans.queries import SQL

    return sorted(SQL)


@pytest.mark.parametrize("name", own())
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM read_parquet('{DATA}/{file}')")
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(cell(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(cell(r[i]) for i in order) for r in rel.fetchall()), key=repr)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() == 1
