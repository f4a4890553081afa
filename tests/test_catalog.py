"""Every query of the catalogue against its SQL in DuckDB, and the driver's entry."""

from __future__ import annotations

import duckdb
import pytest
from oracle import connect, difference

from bazaarlake.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) & set(catalog.ORACLE_SQL)))
def test_rows_equal_those_of_sql(spark, con, name):
    assert not difference(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF_DIR, con)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, SF_DIR).count() > 0


def test_offers_of_every_id_are_scored(spark):
    ids = catalog.QUERIES["d5_j13_score_all_offers"](spark, SF_DIR).selectExpr("id % 20 as k").distinct().count()
    assert ids == 20


def test_sql_belongs_to_queries():
    assert not set(catalog.ORACLE_SQL) - set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("pages", [[(1, "a"), (4, "a"), (5, "a"), (6, "b"), (7, "b"), (8, None), (9, None)], [(None, "a"), (-1, "b"), (-3, None), (3, "b")]])
def test_pages_that_share_a_url_are_resumed_by_id(spark, tmp_path, pages):
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert not difference(spark, catalog.QUERIES["p1_p3_resume"], catalog.ORACLE_SQL["p1_p3_resume"], str(tmp_path), con)
