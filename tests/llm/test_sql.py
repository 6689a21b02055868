"""Queries against their SQL, on the same tables."""

from __future__ import annotations

import pytest

from auditloom.llm.queries import ORACLE_SQL, QUERIES

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    ours, sql = QUERIES[name](spark, sf), con.sql(ORACLE_SQL[name])
    assert sorted(ours.columns) == sorted(sql.columns)
    assert sorted(tuple(r[c] for c in sql.columns) for r in ours.collect()) == sorted(sql.fetchall())
