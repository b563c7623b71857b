"""Queries of the operators that SQL can express, against DuckDB on the same tables."""

import duckdb
import pytest

from lodestone.llm.queries import ORACLE_SQL, QUERIES

TABLES = ("documents", "embeddings", "labels", "pages")


def _plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    frame = QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    result = con.execute(ORACLE_SQL[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    expected = sorted((tuple(_plain(r[order.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert sorted((tuple(_plain(r[c]) for c in columns) for r in frame.collect()), key=repr) == expected
