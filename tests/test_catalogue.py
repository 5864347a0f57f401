"""Registered queries against DuckDB on the smallest tables; the driver compares all of them on larger ones."""

import os

import duckdb
import pytest

from sparkprep.plans import catalogue

SF = "/root/testdata/sf0.001"
NAMES = ["fill_forward", "text_scores", "quartiles_outliers", "oversample", "split_positional", "drift_ks", "drift_chi2", "ddsketch_quantiles", "contamination", "federated_execute", "sort_positions", "schema_violations", "streaming_daily_counts"]


def test_sql_has_queries():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = con.sql(f"SELECT {quoted} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want, key=str)
