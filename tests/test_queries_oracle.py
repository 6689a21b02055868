"""Every query that SQL can say agrees with its SQL, on the same tables."""

from __future__ import annotations

import glob
import os

import pandas as pd
import pytest

from auditloom.queries import audits, evaluation, extraction, preparation, statistics  # noqa: F401
from auditloom.queries.base import ORACLE_SQL, QUERIES

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def in_order(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf, con, name):
    ours, sql = in_order(QUERIES[name](spark, sf).toPandas()), in_order(con.sql(ORACLE_SQL[name]).df())
    assert list(ours.columns) == list(sql.columns)
    pd.testing.assert_frame_equal(ours, sql, check_dtype=False, rtol=1e-9, atol=2e-6)


def test_every_query_has_sql_or_is_known():
    without = {"baseline_splits", "baseline_eval", "loocv_models", "metadata_auc", "oof_at_elbow", "external_pvalues", "forced_instances", "extract_signals", "nn_split", "external_audit", "internal_audit", "contributions", "loo_logistic", "combo_search", "transfer_eval"}
    assert set(QUERIES) - set(ORACLE_SQL) == without
