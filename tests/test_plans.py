"""What the physical plans must and must not contain, and how they take a hot key."""

import pytest
from pyspark.sql import functions as F

from tests.helpers import physical_plan
from tradescope.plans import sales
from tradescope.plans.fact import sales_fact
from verification.catalog import queries
from verification.tables import dataset

SF = "/root/testdata/sf0.001"


def test_no_window_over_the_whole_table(spark):
    # Scores come from cuts that are found by counting; positions are windows inside a group.
    assert "Window [" not in physical_plan(queries()["rfm_segments"](spark, SF))
    plan = physical_plan(queries()["order_position_in_priority"](spark, SF))
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("[refund_reason#" in line for line in windows)


def test_fact_scans_only_the_columns_in_use(spark):
    plan = physical_plan(sales.monthly_sales(sales_fact(dataset(spark, SF), ())))
    assert "o_totalprice" not in plan and "p_name" not in plan and "l_tax" not in plan


def test_distinct_orders_need_no_second_shuffle_of_the_items(spark, no_broadcast):
    plan = physical_plan(sales.executive_kpis(sales_fact(dataset(spark, SF), ())))
    # items and products by product, items and orders by order, then one-row partials.
    assert plan.count("Exchange hashpartitioning") == 4


def scans(plan: str, column: str) -> int:
    return sum(column in line for line in plan.splitlines() if "ReadSchema" in line)


def test_finance_cards_join_items_and_orders_once(spark, no_broadcast):
    plan = physical_plan(queries()["finance_cards"](spark, SF))
    # Line table: items of the fact and expenses; order table: the fact's and the refunds.
    assert plan.count("FileScan parquet") <= 6 and scans(plan, "l_orderkey") == 1


def test_return_reasons_leave_the_fact_alone_when_names_are_unique(spark, no_broadcast):
    plan = physical_plan(queries()["return_reasons"](spark, SF))
    assert "SortMergeJoin" not in plan and plan.count("FileScan parquet") == 1


def test_constant_sentences_read_neither_spend_nor_inventory_again(spark, no_broadcast):
    plan = physical_plan(queries()["insights"](spark, SF))
    assert "p_size" not in plan and plan.count("l_tax") <= plan.count("l_extendedprice")


def test_a_hot_order_is_split_at_run_time(spark, no_broadcast):
    """A third of all items in one order: the join splits it and the totals stay right."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        n = 60_000
        item = spark.range(n, numPartitions=8).select(
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("order_id"),
            (F.col("id") % 10).alias("prod_id"),
            F.lit(1).cast("decimal(18,4)").alias("quantity"),
            F.lit(2).cast("decimal(18,4)").alias("net_amount"),
        )
        order = spark.range(n, numPartitions=4).select(
            F.col("id").alias("order_id"),
            (F.col("id") % 50).alias("cust_id"),
            F.lit("Shipped").alias("order_status"),
            F.lit("2024-01-01").cast("timestamp_ntz").alias("order_date"),
        )
        ds = dataset(spark, SF).with_tables(order_items=item, orders=order)
        monthly = sales.monthly_sales(sales_fact(ds, ()))
        row = monthly.collect()[0]
        assert "skew=true" in physical_plan(monthly)
        # Order 7 and the two thirds of orders whose own number has no factor three.
        assert (row.revenue, row.orders) == (2.0 * n, n - n // 3)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
