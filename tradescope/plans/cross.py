"""Results that combine several business areas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradescope.dataset import Dataset, Results
from tradescope.functions.exprs import mean, percent_2dp, ratio, sql_total, total
from tradescope.operators.joins import lookup, lookup_table
from tradescope.plans.fact import categorised_products, inner_sales
from tradescope.plans.finance import expenses_in_scope, finance_results, monthly_expenses
from tradescope.plans.hr import payroll_monthly
from tradescope.plans.marketing import ad_spend, spend_sales_trend
from tradescope.plans.operations import inventory_by_category, inventory_positions
from tradescope.plans.sales import category_contribution, executive_kpis, regional_contribution


def staff_by_region(ds: Dataset) -> DataFrame:
    staff = lookup_table(ds.table("store_employees"), ds, "stores", "store_id", ["region_id"])
    staff = lookup_table(staff, ds, "region", "region_id", ["region_name"])
    return (
        staff.where(F.col("region_name").isNotNull())
        .groupBy("region_name")
        .agg(
            F.count_distinct("employee_id").alias("headcount"),
            mean("salary").alias("avg_salary"),
        )
    )


def region_sales_staff(ds: Dataset, fact: DataFrame) -> DataFrame:
    return lookup(regional_contribution(fact), staff_by_region(ds), "region_name").orderBy(
        F.col("revenue").desc(), "region_name"
    )


def category_margin_inventory(ds: Dataset, fact: DataFrame) -> DataFrame:
    return lookup(
        category_contribution(fact), inventory_by_category(ds), "category_name"
    ).orderBy(F.col("revenue").desc(), "category_name")


def cross_functional_results(
    ds: Dataset,
    fact: DataFrame,
    years: Sequence[int] | None = None,
    platforms: Sequence[str] | None = None,
    categories: DataFrame | None = None,
) -> Results:
    """The four results; ``categories`` stands for the fact in the one by category, if given."""
    by_category = fact if categories is None else categories
    spend = ad_spend(ds, years, platforms) if "ads_spend" in ds else None
    results = {
        "marketing_sales_profit": lambda: spend_sales_trend(fact, spend),
        "profit_cost": lambda: finance_results(ds, fact, years)["pnl"],
    }
    staffed = all(key in ds for key in ("store_employees", "stores", "region"))
    if staffed and "region_name" in fact.columns:
        results["region_sales_staff"] = lambda: region_sales_staff(ds, fact)
    if "inventory" in ds and "category_name" in by_category.columns:
        results["category_margin_inventory"] = lambda: category_margin_inventory(ds, by_category)
    return Results(results)


def overview_cards(
    ds: Dataset, fact: DataFrame, years: Sequence[int] | None = None
) -> DataFrame:
    """Operating expense, gross payroll, items below reorder and revenue per employee."""
    exact = "decimal(38,4)"
    opex = monthly_expenses(expenses_in_scope(ds, years)).agg(
        total(F.col("opex").cast(exact)).alias("v")
    )
    payroll = payroll_monthly(ds, years).agg(
        total(F.col("gross_payroll").cast(exact)).alias("v")
    )
    low = inventory_positions(ds).agg(F.count_if("below_reorder").alias("v"))
    staff = ds.table("store_employees").agg(F.count_distinct("employee_id").alias("v"))
    employees = F.greatest(F.lit(1), staff.select("v").scalar())
    return executive_kpis(fact).select(
        opex.select("v").scalar().alias("opex"),
        payroll.select("v").scalar().alias("gross_payroll"),
        low.select("v").scalar().alias("below_reorder_skus"),
        ratio(F.col("revenue"), employees).alias("revenue_per_employee"),
    )


# --- SQL report --------------------------------------------------------------------------


def category_capital_and_margin(ds: Dataset) -> DataFrame:
    """Category revenue and margin next to the capital held in its inventory."""
    products = categorised_products(ds)
    sales = (
        inner_sales(ds, products)
        .groupBy("category_name")
        .agg(
            sql_total("net_amount").alias("revenue"),
            (F.sum("net_amount") - F.sum("cost")).cast("double").alias("profit"),
        )
    )
    capital = (
        ds.table("inventory")
        .join(products.select("product_id", "category_name", "cost_price"), "product_id")
        .groupBy("category_name")
        .agg(sql_total(F.col("quantity_on_hand") * F.col("cost_price")).alias("inventory_working_capital"))
    )
    return (
        sales.withColumn("margin_pct", percent_2dp(F.col("profit"), F.col("revenue")))
        .join(capital, "category_name", "left")
        .orderBy(F.col("inventory_working_capital").desc_nulls_last(), "category_name")
    )
