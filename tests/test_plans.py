"""Plan shapes that the scale design relies on (checked on the smallest
fixture; the shapes do not depend on data size)."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from docweave.session import bucketed_table

SMOKE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMOKE), reason="fixture tables not present")


def final_plan(df):
    df.collect()                       # run this query execution so AQE finalises the plan
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_context_limits_per_question_before_and_after_one_exchange(spark):
    plan = final_plan(E.queries()["context"](spark, SMOKE))
    assert "WindowGroupLimit" in plan and "Partial" in plan and "Final" in plan
    assert "MapInArrow" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_links_need_no_hash_shuffle(spark):
    plan = final_plan(E.queries()["links"](spark, SMOKE))
    assert "hashpartitioning" not in plan


def test_page_dedup_aggregates_before_the_exchange(spark):
    plan = final_plan(E.queries()["page_dedup"](spark, SMOKE))
    before = plan.split("Exchange hashpartitioning")[1]
    assert "Aggregate" in before                       # partial aggregate below the exchange


def test_histogram_reads_the_values_once(spark):
    plan = final_plan(E.queries()["token_histogram"](spark, SMOKE))
    assert "ReusedExchange" in plan


def test_scan_reads_only_needed_columns(spark):
    plan = final_plan(E.queries()["page_key"](spark, SMOKE))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan


def test_bucketed_table_is_joined_without_reshuffle(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = 8
        big = bucketed_table(spark.range(1000).select(F.col("id").cast("string").alias("k")), "k", n)
        small = spark.range(100).select(F.col("id").cast("string").alias("k")).repartition(n, "k")
        plan = final_plan(small.join(big, "k", "left_anti"))
        assert plan.count("Exchange") == 1               # only the small side moves
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
