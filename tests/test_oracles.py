"""Every query with an oracle against DuckDB on the smallest tables; every other one runs."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from respira.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(catalogue.REGISTRY.queries)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def normal(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.6g}"
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    data = [tuple(r) for r in got.collect()]
    if sql is None:
        return
    want = duck.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, data) == rows(columns, want.fetchall())


def test_no_products_or_python_in_sql_operators(spark):
    for name in ("i01_merge_spans", "j04_asof_backward", "j07_interval_overlap_join", "i19_build_episodes", "l05_assign_label", "w04_locf_max_age"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan and "Pandas" not in plan, name


def test_entry(spark):
    assert entry.entry(spark).count() > 0
