"""Bucketed tables whose hot keys lie in a side table."""

from collections import Counter

import pytest

from pyspark.sql import functions as F
from tests.helpers import dataset, physical_plan
from tradescope.plans.fact import sales_fact, sales_fact_of_parts
from tradescope.registry import table_specs
from tradescope.sources.catalog import CatalogSource, hot_keys, parts, save_bucketed
from tradescope.sources.loader import load

TABLES = {"orders": "order_id", "order_items": "order_id"}


@pytest.fixture
def hot_shop(spark):
    # Order 7 holds 1,000 of 3,000 items, 500 items have no order.
    items = [7] * 1000 + [None] * 500 + [i % 300 + 100 for i in range(1500)]
    ds = dataset(
        spark,
        orders=[{"order_id": i, "cust_id": i % 3, "order_status": "Shipped", "order_date": "2024-01-01"} for i in [7, *range(100, 400)]],
        order_items=[{"order_id": o, "prod_id": k % 5, "quantity": 1, "net_amount": k} for k, o in enumerate(items)],
        products=[{"product_id": i, "product_name": f"P{i}", "brand_id": 1, "cost_price": 1} for i in range(5)],
    )
    yield ds
    spark.sql("DROP SCHEMA IF EXISTS sales CASCADE")


def bucket_sizes(spark, name: str) -> Counter:
    files = F.regexp_extract(F.input_file_name(), r"_(\d{5})\.", 1)
    return Counter({r.bucket: r["count"] for r in spark.read.table(name).groupBy(files.alias("bucket")).count().collect()})


def test_hot_keys_are_exact(spark):
    values = [i % 50 for i in range(5000)] + [-1] * 1001 + [-2] * 999 + [None] * 3000
    frame = spark.createDataFrame([(v,) for v in values], "k long").repartition(7)
    assert hot_keys(frame, "k", 0.1) == ([-1], True)
    assert hot_keys(frame, "k", 0.5) == ([], False)
    assert hot_keys(frame.limit(0), "k", 0.1) == ([], False)
    words = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [("c",)], "`odd name` string")
    assert hot_keys(words, "odd name", 0.3) == (["a", "b"], False)


def test_buckets_are_even_and_nothing_is_lost(spark, hot_shop):
    save_bucketed(hot_shop, TABLES, 4, hot_share=0.05)
    sizes = bucket_sizes(spark, "sales.order_items")
    assert sum(sizes.values()) == 1500 and max(sizes.values()) <= 2 * sorted(sizes.values())[len(sizes) // 2]
    assert Counter(r.order_id for r in spark.read.table("sales.order_items_hot").collect()) == {7: 1000, None: 500}
    assert [r.order_id for r in spark.read.table("sales.orders_hot").collect()] == [7]
    for key in TABLES:
        stored = CatalogSource(spark).read(table_specs()[key])
        assert Counter(map(str, stored.collect())) == Counter(map(str, hot_shop[key].collect()))
    with pytest.raises(ValueError, match="unknown part"):
        CatalogSource(spark, "cold")


def test_the_parts_join_without_a_shuffle_of_items(spark, hot_shop, no_broadcast):
    save_bucketed(hot_shop, TABLES, 4, hot_share=0.05)
    stored, _ = load(CatalogSource(spark), keys=TABLES, dedup="none")
    bare_bucketed, bare_hot = parts(stored, TABLES)
    assert "Exchange" not in physical_plan(sales_fact(bare_bucketed))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    hot = physical_plan(sales_fact(bare_hot))
    assert "BroadcastHashJoin" in hot and "hashpartitioning" not in hot
    whole = sales_fact_of_parts(parts(hot_shop, TABLES))
    want = sales_fact(hot_shop)
    assert whole.columns == want.columns
    assert Counter(map(str, whole.collect())) == Counter(map(str, want.collect())) and whole.count() == 2500


def test_saving_without_a_share_drops_the_side_table(spark, hot_shop):
    save_bucketed(hot_shop, TABLES, 4, hot_share=0.05)
    save_bucketed(hot_shop, TABLES, 4)
    assert not spark.catalog.tableExists("sales.order_items_hot")
    assert CatalogSource(spark).read(table_specs()["order_items"]).count() == 3000
    # No key reaches half of the rows: the side table is there and empty.
    save_bucketed(hot_shop, TABLES, 4, hot_share=0.5)
    assert spark.read.table("sales.order_items_hot").count() == 0
    assert sales_fact_of_parts(parts(hot_shop, TABLES)).count() == 2500
