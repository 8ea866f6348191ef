"""Each registered query runs over whole tables; those with SQL give the rows that DuckDB gives."""

import duckdb
import pytest

from textmill.llm import registry


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = [tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows]
    return sorted(clean, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", [n for n in registry.queries() if n != "pipeline"])
def test_query(name, spark, sf):
    df = registry.queries()[name](spark, sf)
    found = df.collect()
    assert found
    if name in registry.oracle_sql():
        con = duckdb.connect()
        con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
        wanted = con.sql(registry.oracle_sql()[name])
        assert sorted(df.columns) == sorted(wanted.columns)
        assert rows_of(df.columns, found) == rows_of(wanted.columns, wanted.fetchall())
