"""Every registered query that has SQL gives what DuckDB gives on the same tables."""

import duckdb
import pytest

from factloom.plans import catalog, interface, project

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if hasattr(value, "asDict"):
        value = value.asDict()
    return {k: plain(v) for k, v in value.items()} if isinstance(value, dict) else [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


QUERIES, SQL = catalog.queries() | project.queries() | interface.queries(), catalog.oracle_sql() | project.oracle_sql() | interface.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, got.collect()) == rows_of(columns, want.fetchall())
