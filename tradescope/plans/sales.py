"""Sales and customer results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradescope.dataset import Dataset, Results
from tradescope.functions.exprs import (
    mean_hours,
    month_start,
    percent,
    percent_2dp,
    ratio,
    seconds_between,
    sql_total,
    total,
)
from tradescope.operators.joins import named_by
from tradescope.plans.fact import inner_sales, product_dimension
from tradescope.plans.rfm import rfm_segments


def _profit_total() -> Column:
    """Profit of a group from the two sums, exact because both are decimals."""
    zero = F.lit(0)
    revenue, cost = F.coalesce(F.sum("net_amount"), zero), F.coalesce(F.sum("cost"), zero)
    return (revenue - cost).cast("double")


def _by(fact: DataFrame, key: str, *measures: Column) -> DataFrame:
    """Aggregate by a key whose null group does not count."""
    return fact.where(F.col(key).isNotNull()).groupBy(key).agg(*measures)


def _revenue_profit() -> list[Column]:
    return [total("net_amount").alias("revenue"), _profit_total().alias("profit")]


def _order_count(one_row_per_order: bool = False) -> Column:
    count = F.count if one_row_per_order else F.count_distinct
    return count("order_id").alias("orders")


def _with_margin(df: DataFrame, out: str = "margin_pct") -> DataFrame:
    return df.withColumn(out, percent(F.col("profit"), F.col("revenue")))


def executive_kpis(fact: DataFrame, one_row_per_order: bool = False) -> DataFrame:
    """Revenue, profit, margin, orders and average order value, as one row.

    With ``one_row_per_order`` rows are counted, which moves no order ids.
    """
    return fact.agg(*_revenue_profit(), _order_count(one_row_per_order)).select(
        "revenue",
        "profit",
        percent(F.col("profit"), F.col("revenue")).alias("margin_pct"),
        "orders",
        ratio(F.col("revenue"), F.col("orders")).alias("aov"),
    )


def revenue_and_profit(fact: DataFrame) -> DataFrame:
    """Revenue, profit and margin as one row; orders are not told apart."""
    return _with_margin(fact.agg(*_revenue_profit()))


def monthly_sales(fact: DataFrame) -> DataFrame:
    return _with_margin(_by(fact, "month", *_revenue_profit(), _order_count())).orderBy("month")


def monthly_revenue_profit(fact: DataFrame) -> DataFrame:
    """Revenue and profit per month, sales without a month as a row of their own."""
    return fact.groupBy("month").agg(*_revenue_profit())


def product_contribution(fact: DataFrame) -> DataFrame:
    by_product = _by(fact, "product_name", *_revenue_profit(), total("quantity").alias("units"))
    return by_product.orderBy(F.col("revenue").desc(), "product_name")


def category_contribution(fact: DataFrame) -> DataFrame:
    by_category = _with_margin(_by(fact, "category_name", *_revenue_profit()))
    return by_category.orderBy(F.col("revenue").desc(), "category_name")


def regional_contribution(fact: DataFrame) -> DataFrame:
    by_region = _with_margin(_by(fact, "region_name", *_revenue_profit(), _order_count()))
    return by_region.orderBy(F.col("revenue").desc(), "region_name")


def return_reasons(ds: Dataset, fact: DataFrame) -> DataFrame:
    """Refund value and distinct returns by reason.

    Returns are matched to the distinct products sold in their order; a return keeps
    counting when the filtered fact does not hold its order.  A match changes something
    only where one product id has several names, so the fact is read for such ids alone.
    """
    returns = ds.table("sales_returns").withColumn("copies", F.lit(1))
    named = ["category_name", "product_name"]
    ambiguous = (
        product_dimension(ds, ("category",))
        .select(F.col("product_id").alias("prod_id"), *named)
        .distinct()
        .groupBy("prod_id")
        .agg(F.count(F.lit(1)).alias("names"))
        .where(F.col("names") > 1)
        .select("prod_id")
    )
    if not ambiguous.isEmpty():
        sold = fact.join(ambiguous, "prod_id", "left_semi").select("order_id", "prod_id", *named)
        times = sold.distinct().groupBy("order_id", "prod_id").agg(F.count(F.lit(1)).alias("times"))
        returns = returns.join(times, ["order_id", "prod_id"], "left").withColumn(
            "copies", F.coalesce("times", F.lit(1))
        )
    return _by(
        returns,
        "reason",
        total(F.col("refund_amount") * F.col("copies")).alias("refund_value"),
        F.count_distinct("return_id").alias("return_count"),
    ).orderBy(F.col("refund_value").desc(), "reason")


def review_distribution(ds: Dataset) -> DataFrame:
    return _by(ds.table("reviews"), "rating", F.count(F.lit(1)).alias("review_count")).orderBy(
        "rating"
    )


def loyalty_by_tier(ds: Dataset) -> DataFrame:
    members = named_by(ds.table("loyalty_members"), ds, "loyalty_tiers", "tier_id", ["tier_name"])
    key = "tier_name" if "tier_name" in members.columns else "tier_id"
    return _by(
        members.withColumnRenamed(key, "tier"),
        "tier",
        F.count_distinct("customer_id").alias("members"),
        total("points_balance").alias("points_balance"),
    )


def ticket_resolution(ds: Dataset) -> DataFrame:
    tickets = ds.table("support_tickets").withColumn(
        "open_seconds", seconds_between("created_date", "resolved_date")
    )
    return _by(
        tickets,
        "category",
        F.count_distinct("ticket_id").alias("ticket_count"),
        mean_hours("open_seconds").alias("avg_resolution_hours"),
    ).orderBy(F.col("ticket_count").desc(), "category")


def sales_customer_results(ds: Dataset, fact: DataFrame) -> Results:
    results = {"monthly": lambda: monthly_sales(fact), "rfm": lambda: rfm_segments(fact)}
    if "product_name" in fact.columns:
        results["products"] = lambda: product_contribution(fact)
    if "category_name" in fact.columns:
        results["categories"] = lambda: category_contribution(fact)
    if "region_name" in fact.columns:
        results["regions"] = lambda: regional_contribution(fact)
    if "sales_returns" in ds:
        results["return_reasons"] = lambda: return_reasons(ds, fact)
    if "reviews" in ds:
        results["reviews"] = lambda: review_distribution(ds)
    if "loyalty_members" in ds:
        results["loyalty"] = lambda: loyalty_by_tier(ds)
    if "support_tickets" in ds:
        results["tickets"] = lambda: ticket_resolution(ds)
    return Results(results)


# --- Top-N slices ----------------------------------------------------------------------


def leading(df: DataFrame, measure: str, name: str, n: int, descending: bool = True) -> DataFrame:
    """The first ``n`` rows by a measure, ties by name; every task keeps only ``n`` rows."""
    by = F.col(measure).desc_nulls_last() if descending else F.col(measure).asc_nulls_last()
    return df.orderBy(by, F.col(name).asc_nulls_last()).limit(n)


def latest(df: DataFrame, column: str, n: int) -> DataFrame:
    """The last ``n`` rows by a column, in ascending order."""
    return df.orderBy(F.col(column).desc()).limit(n).orderBy(column)


# --- SQL reports -------------------------------------------------------------------------


def _sql_profit() -> Column:
    return (F.sum("net_amount") - F.sum("cost")).cast("double")


def monthly_sales_with_cost(ds: Dataset) -> DataFrame:
    sales = inner_sales(ds).withColumn("month", month_start("order_date").cast("date"))
    measured = sales.groupBy("month").agg(
        sql_total("net_amount").alias("revenue"),
        sql_total("cost").alias("estimated_cost"),
        _sql_profit().alias("profit"),
    )
    return measured.withColumn(
        "profit_margin_pct", percent_2dp(F.col("profit"), F.col("revenue"))
    ).orderBy("month")


def top_products(ds: Dataset, n: int = 20) -> DataFrame:
    measured = (
        inner_sales(ds)
        .groupBy("product_name")
        .agg(sql_total("net_amount").alias("revenue"), _sql_profit().alias("profit"))
        .withColumn("margin_pct", percent_2dp(F.col("profit"), F.col("revenue")))
    )
    return leading(measured, "revenue", "product_name", n)


def region_state_sales(ds: Dataset) -> DataFrame:
    places = (
        ds.table("stores")
        .select("store_id", "region_id")
        .join(ds.table("region").select("region_id", "region_name", "state"), "region_id")
    )
    return (
        inner_sales(ds, places=places)
        .groupBy("region_name", "state")
        .agg(
            _order_count(),
            sql_total("net_amount").alias("revenue"),
            _sql_profit().alias("profit"),
        )
        .orderBy(F.col("revenue").desc(), "region_name", "state")
    )
