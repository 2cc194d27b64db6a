"""Every query with SQL gives what the SQL gives, on the smallest tables."""

import os
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import pytest

import __spark_entry__ as entry
from recordloom.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, Decimal):
        return round(float(v), 5)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return v.isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    r = duck.execute(entry.oracle_sql(SF)[name])
    cols = [x[0] for x in r.description]
    order = sorted(range(len(cols)), key=cols.__getitem__)
    want = Counter(tuple(plain(row[i]) for i in order) for row in r.fetchall())
    assert sorted(cols) == sorted(df.columns)
    assert Counter(tuple(plain(row[c]) for c in sorted(df.columns)) for row in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_runs(spark, name):
    entry.queries()[name](spark, SF).count()


def test_entry(spark):
    assert entry.entry(spark).columns == ["record_id", "source_field", "target_table", "target_key", "period", "status"]
