"""Each query with SQL gives the rows that DuckDB gives; each other query runs."""

import duckdb
import pytest

from textmill.plans import more, tables  # noqa: F401 (add their queries)
from textmill.plans.queries import QUERIES, SQL

TABLES = "lineitem events documents pages benchmark labels conversations".split()


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = [tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows]
    return sorted(clean, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    found = rows_of(df.columns, df.collect())
    if name in SQL:
        wanted = duck.sql(SQL[name])
        assert sorted(df.columns) == sorted(wanted.columns)
        assert found == rows_of(wanted.columns, wanted.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
