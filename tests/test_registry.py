"""Registered queries and their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
import check
from fieldspark.operators import spatial
from fieldspark.operators.ordered import block
from fieldspark.plans.adapters import TABLES

SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 200


@pytest.mark.parametrize("name", ["match_captures", "defect_epochs", "surface_change", "label_regions_8", "fill_sinks", "stratified_split", "stream_metrics"])
def test_rows_equal_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and check.rows_of(got) == check.rows_of(want)


def test_thinned_samples(spark):
    df = spark.range(1000).selectExpr("id % 2 AS site", "id")
    got = sorted(r["id"] for r in spatial.thin_samples(df, ["site"], ["id"], [block("id", 100)], limit=200).where("site = 0").collect())
    assert got == list(range(0, 1000, 6))
