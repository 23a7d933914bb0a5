"""The physical plans: what reaches the scan, how often data is shuffled, what is never planned."""

import re

import pytest
from conftest import SF
from millrace.catalogue import Q
from millrace.operators import asof, diff, materialize, quality
from millrace.plans.engine import run_sql
from millrace.sources.tables import read_table
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def big(spark):
    """Tables too large to broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(run_sql(spark, SF, Q["tpch_q6"]))
    assert "GreaterThanOrEqual(l_shipdate" in p and "LessThan(l_quantity" in p
    assert re.search(r"ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_shipdate:timestamp_ntz>", p)


def test_window_bound_reaches_the_scan(spark):
    import datetime as dt

    events = read_table(spark, SF, "events").select("event_id", "ts")
    p = plan(materialize.window_rows(events, "ts", dt.datetime(2024, 1, 1), 3600))
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts,2023-12-31T23:00)]" in p


def test_keyed_diff_is_one_equi_join(big):
    orders = read_table(big, SF, "orders")
    p = plan(diff.keyed_diff(orders, orders.where("o_orderkey > 5"), ["o_orderkey"]))
    assert p.count("SortMergeJoin") == 1 and "Cartesian" not in p and "NestedLoop" not in p
    assert p.count("Exchange hashpartitioning") == 2


def test_asof_join_makes_no_pairs(big):
    orders, events = read_table(big, SF, "orders"), read_table(big, SF, "events")
    p = plan(asof.asof_join(orders.withColumn("user_id", F.col("o_custkey")), events, ["user_id"], "o_orderdate", "ts", ["value"]))
    assert "Join" not in p and p.count("Exchange hashpartitioning") == 1


def test_merge_and_partition_replacement_are_anti_joins(big):
    orders = read_table(big, SF, "orders")
    for df in (materialize.merged(orders, orders.where("o_orderkey < 9"), ["o_orderkey"], check=False), materialize.partitions_replaced(orders, orders.limit(5), ["o_orderpriority"])):
        p = plan(df)
        assert "LeftAnti" in p and "NestedLoop" not in p and "Cartesian" not in p


def test_equality_shuffles_each_side_once(big):
    orders = read_table(big, SF, "orders").select("o_orderkey", "o_orderstatus")
    p = plan(quality.equality(orders, orders.where("o_orderkey > 3")))
    assert "Join" not in p and p.count("Exchange hashpartitioning") == 1


def test_qualify_limits_groups_early(spark):
    assert "WindowGroupLimit" in plan(run_sql(spark, SF, Q["qualify_topk"]))


def test_top_k_needs_no_global_sort(spark):
    p = plan(run_sql(spark, SF, Q["topk"]))
    assert "TakeOrderedAndProject" in p and "rangepartitioning" not in p
