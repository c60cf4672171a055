"""Every registered query with SQL gives the SQL's rows on small data."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLAIN = {n: f for m in entry._plan_modules() for n, f in m.QUERIES.items()}
SQL = {n: s for m in entry._plan_modules() for n, s in m.SQL.items()}


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(columns, tuples):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(float(x), 5) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    return sorted((tuple(cell(t[i]) for i in order) for t in tuples), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = PLAIN[name](spark, SF)
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(PLAIN) - set(SQL)))
def test_query_runs(spark, name):
    PLAIN[name](spark, SF).write.format("noop").mode("overwrite").save()
