"""The roll-up gives what the fact gives, and the text results join the fact once."""

from pyspark.sql import functions as F

from tests.helpers import physical_plan
from tradescope.plans import rfm, rollup, sales
from tradescope.plans.insights import GROUPS, PRIORITY_GROUPS, build_insights, priorities
from tradescope.plans.rollup import sales_rollup
from verification import catalog
from verification.tables import dataset

SF = "/root/testdata/sf0.001"
SCHEMA = (
    "order_id long, month timestamp_ntz, region_name string, cust_id long, product_name string, category_name string, "
    "quantity decimal(18,4), net_amount decimal(18,4), cost decimal(38,6), order_date timestamp_ntz"
)


def odd_fact(spark):
    """Negative, sparse, null and repeated ids, an order in two months and regions, a hot order."""
    ids = [-5, 0, 7, 2**60, -(2**60), None, 7, 7]
    rows = spark.range(4000).select(
        F.element_at(F.array(*[F.lit(i).cast("long") for i in ids]), (F.col("id") % 8 + 1).cast("int")).alias("order_id"),
        F.when(F.col("id") % 11 > 0, F.lit("2024-01-01").cast("timestamp_ntz")).alias("month"),
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("r"), (F.col("id") % 3).cast("string"))).alias("region_name"),
        F.when(F.col("id") % 13 > 0, F.col("id") % 4).alias("cust_id"),
        F.when(F.col("id") % 17 > 0, F.concat(F.lit("p"), (F.col("id") % 9).cast("string"))).alias("product_name"),
        F.concat(F.lit("c"), (F.col("id") % 2).cast("string")).alias("category_name"),
        (F.col("id") % 3).alias("quantity"),
        F.when(F.col("id") % 19 > 0, F.col("id") / 7).alias("net_amount"),
        F.lit(1.5).alias("cost"),
        F.lit("2024-01-03").cast("timestamp_ntz").alias("order_date"),
    )
    return rows.select(*[F.col(f.split()[0]).cast(f.split()[1]).alias(f.split()[0]) for f in SCHEMA.split(", ")])


def values(df):
    return sorted(map(str, df.collect()))


def test_the_rollup_stands_for_the_fact(spark):
    for sold in (odd_fact(spark), sales_rollup(odd_fact(spark)).orders.limit(0).join(odd_fact(spark).limit(0).select("product_name", "category_name"))):
        parts = sales_rollup(sold)
        for result in (sales.executive_kpis, sales.monthly_sales, sales.regional_contribution, rfm.customer_values):
            assert values(result(parts.orders)) == values(result(sold)), result
        assert values(sales.product_contribution(parts.products)) == values(sales.product_contribution(sold))
        assert values(sales.category_contribution(parts.categories)) == values(sales.category_contribution(sold))


def test_names_that_are_missing_stay_missing(spark):
    sold = odd_fact(spark).drop("product_name", "region_name")
    parts = sales_rollup(sold)
    assert parts.products is None and "region_name" not in parts.orders.columns
    assert values(sales.executive_kpis(parts.orders)) == values(sales.executive_kpis(sold))
    assert values(sales.category_contribution(parts.categories)) == values(sales.category_contribution(sold))


def test_text_results_read_the_fact_once_and_only_through_the_rollup(spark, monkeypatch):
    joined = []
    real = rollup.stage_once
    monkeypatch.setattr(rollup, "stage_once", lambda df, label: joined.append(df) or real(df, label))
    for name in ("insights", "report_lines", "fact_insights", "management_priorities"):
        joined.clear()
        found = catalog.queries()[name](spark, SF)
        assert len(joined) == 1 and physical_plan(joined[0]).count("Expand") == 1, name
        plan = physical_plan(found)
        assert "l_partkey" not in plan and "o_orderdate" not in plan.replace("spend", ""), name


def test_only_the_wanted_groups_are_built(spark, monkeypatch):
    ds = dataset(spark, SF)
    sold = sales_rollup(catalog._narrow_fact(ds))
    whole = build_insights(ds, sold)
    assert {r.group for r in whole.collect()} == set(GROUPS)
    monkeypatch.setattr("tradescope.plans.insights.rfm_segments", lambda *_: 1 / 0)
    some = build_insights(ds, sold, groups=PRIORITY_GROUPS)
    assert values(some) == values(priorities(whole))


def test_some_groups_join_only_what_they_read(spark, monkeypatch):
    """The management groups tell no orders, products or customers apart, so neither does their roll-up."""
    joined = []
    real = rollup.stage_once
    monkeypatch.setattr(rollup, "stage_once", lambda df, label: joined.append(df) or real(df, label))
    ds = dataset(spark, SF)
    whole = values(priorities(build_insights(ds, catalog._narrow_fact(ds))))
    joined.clear()
    assert values(build_insights(ds, catalog._narrow_fact(ds), groups=PRIORITY_GROUPS)) == whole
    plan = physical_plan(joined[0])
    assert not [c for c in ("p_name", "region_name") if c in plan]
    assert joined[0].columns == ["month", "category_name", "_set", "net_amount", "cost"]
    odd = odd_fact(spark)
    for groups in (["Executive"], ["Executive", "Sales & Customer"], ["Cross-Functional"]):
        narrow = build_insights(ds, odd, groups=groups)
        assert values(narrow) == values(build_insights(ds, sales_rollup(odd), groups=groups)), groups


def test_rows_stand_for_orders_only_where_no_order_has_several(spark):
    several = sales_rollup(odd_fact(spark))
    assert not several.one_row_per_order
    single = sales_rollup(odd_fact(spark).where("order_id IS NULL OR order_id <> 7").dropDuplicates(["order_id"]))
    assert single.one_row_per_order and single.orders.count() == 5
    for result in (sales.executive_kpis, rfm.customer_values):
        assert values(result(single.orders, single.one_row_per_order)) == values(result(single.orders)), result
    counted = rfm.customer_values(single.orders, True)
    assert physical_plan(counted).count("Exchange") == 1 < physical_plan(rfm.customer_values(single.orders)).count("Exchange")
