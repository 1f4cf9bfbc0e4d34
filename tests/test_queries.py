"""Every analytics query against its SQL in another engine."""

import os

import duckdb
import pytest
from conftest import DATA

from clickloom.plans.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


def plain(v):
    return None if v is None else float(v) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in result.fetchall()), key=repr)
    assert got == want


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "area"
    assert set(ORACLE) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", ["area_top3_product", "session_buckets", "page_convert_rate", "ad_province_top3"])
def test_no_python_in_plans(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Scan ExistingRDD" not in plan.replace("Scan ExistingRDD[step", "")
