"""Every query over the provided tables against DuckDB."""

import pytest

from quirefold.plans import queries as Q

from .conftest import SMALL, same_rows


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_its_sql(spark, duck, name):
    same_rows(Q.QUERIES[name](spark, SMALL), duck, Q.SQL[name])


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_titles_hold_no_counters(spark):
    """What the window form of unique titles rests on."""
    from quirefold.functions.text import html_title
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert pages.where(html_title(F.col("html")).rlike(r" \(\d+\)$")).count() == 0


def test_projections_reach_the_scan(spark):
    plan = Q.QUERIES["q28_total_chars"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = Q.QUERIES["q11_unmapped_anti"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderpriority), Not(EqualTo(o_orderpriority,5-LOW))]" in plan
    assert "o_orderdate" not in plan
