"""Queries whose tasks hold a bounded number of rows, however many there are."""

import pytest
from pyspark.sql import functions as F

from quoteproof.plans.registry import QUERIES


@pytest.fixture
def tables(spark, tmp_path, monkeypatch):
    """200 lines of 50 orders of 7 customers, and partitions of at most 10 rows."""
    monkeypatch.setattr("quoteproof.functions.dealing.MOST_ROWS", 10)
    k = F.col("id")
    lines = spark.range(200).select((k % 50).alias("l_orderkey"), (k * 7 % 100).alias("l_partkey"), (k % 90).alias("l_suppkey"), (k % 3).cast("int").alias("l_linenumber"), (k % 5).cast("double").alias("l_quantity"), F.lit("R").alias("l_returnflag"))
    orders = spark.range(50).select(k.alias("o_orderkey"), (k % 7).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.lit("1996-01-02").cast("timestamp").alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


@pytest.mark.parametrize(("name", "rows", "column"), [("limit_violations", 50, "l_orderkey"), ("payload_json", 50, "l_orderkey"), ("export_positions", 200, "l_orderkey"), ("renumber_items", 150, "o_custkey")])
def test_partitions_are_given(spark, tables, name, rows, column):
    got = QUERIES[name](spark, tables)
    assert got.count() == rows
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert any(f"hashpartitioning({column}#" in x and ", 20), REPARTITION_BY_NUM" in x for x in plan.splitlines()), plan


def test_attachments_are_dealt_once(spark, tables):
    got = QUERIES["attachment_reports"](spark, tables)
    assert {r.error for r in got.collect()} >= {None, "not_attached_by_value", "document_unparseable"}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan
