import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def value(x):
    if hasattr(x, "isoformat"):
        return x.isoformat()[:10]
    return round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.plans.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    frame = entry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(value(r[c]) for c in columns)) for r in frame.collect())
    sql = entry.oracle_sql().get(name)
    if sql:
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert got == sorted(repr(tuple(value(r[names.index(c)]) for c in columns)) for r in result.fetchall())


def test_entry_runs(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["doc_id", "score"] and frame.count() >= 0


def test_every_sql_has_its_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
