"""Every query that has SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from assay.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
LARGER = {"ols_solution": "/root/testdata/sf0.01"}  # ten questions do not tell its effects apart
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def views(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def db():
    return views(DATA)


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 9) + 0.0 if isinstance(v, float) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([plain(r[i]) for i in order] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    data = LARGER.get(name, DATA)
    got = QUERIES[name](spark, data)
    want = db.execute(SQL[name]) if data == DATA else views(data).execute(SQL[name])
    names = [c[0] for c in want.description]
    assert table(got.columns, [tuple(r) for r in got.collect()]) == table(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
