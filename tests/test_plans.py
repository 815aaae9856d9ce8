"""Plan checks: pruning reaches the scan, no cartesian products, top-k stays top-k."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_cartesian_nested_loop_or_python(spark, name):
    p = plan_of(entry.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "EvalPython" not in p and "FlatMapGroupsInPandas" not in p   # everything stays in the JVM


def test_projection_pruned_at_scan(spark):
    df = entry.queries()["include_exclude"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in p
    assert "PushedFilters: [In(event_type" in p


def test_time_range_prunes_partitions(spark):
    p = plan_of(entry.queries()["time_range_scan"](spark, SF_SMALL))
    assert "PartitionFilters: [isnotnull(ym" in p and "EqualTo(user_id,7)" in p


def test_top_n_is_take_ordered(spark):
    assert "TakeOrderedAndProject" in plan_of(entry.queries()["top_n"](spark, SF_SMALL))


def test_bucketed_book_join_has_no_shuffle_when_not_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = entry.queries()["book_with_header"](spark, SF_SMALL)
        df.collect()
        p = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in p and "Exchange hashpartitioning" not in p
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", ["incremental_page", "ticker_from_trades"])
def test_trades_are_not_dealt_by_symbol_before_they_are_reduced(spark, name):
    """Without automatic broadcasts too: the staged small side is broadcast by its counted rows."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan_of(entry.queries()[name](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
    # what lies under the join, down to the scans, is not shuffled
    below = p[p.index("BroadcastHashJoin"):]
    assert "hashpartitioning(symbol" not in below
    if name == "incremental_page":
        assert "hashpartitioning(symbol" in p and "_salt" in p and p.count("WindowGroupLimit") == 4


def test_the_quality_report_parses_every_book_once(spark):
    """One scan of the table that the books are made of, and no exploded levels."""
    p = plan_of(entry.queries()["quality_report"](spark, SF_SMALL))
    assert p.count("lineitem.parquet") == 1 and "Generate posexplode(filter" not in p
