"""Documented indicators beside the dashboard's own results; each is one or two aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradescope.dataset import Dataset
from tradescope.functions.exprs import mean, month_start, percent, ratio, total
from tradescope.operators.filters import valid_orders
from tradescope.plans.hr import payroll_monthly
from tradescope.plans.marketing import ad_spend
from tradescope.plans.operations import inventory_by_category
from tradescope.plans.sales import monthly_revenue_profit

_FAILED = "FAILED"


def units_per_order(fact: DataFrame) -> DataFrame:
    measured = fact.agg(total("quantity").alias("units"), F.count_distinct("order_id").alias("orders"))
    return measured.withColumn("units_per_order", ratio(F.col("units"), F.col("orders")))


def _first_orders(ds: Dataset) -> DataFrame:
    """Each known customer's earliest valid order date."""
    orders = valid_orders(ds.table("orders")).where(F.col("cust_id").isNotNull())
    return orders.groupBy("cust_id").agg(F.min("order_date").alias("first_date"))


def new_and_returning_revenue(ds: Dataset, fact: DataFrame) -> DataFrame:
    """Monthly revenue of first order dates, of later ones, and of unknown customers."""
    per_customer = fact.where(F.col("month").isNotNull()).groupBy("month", "cust_id", "order_date").agg(
        F.sum("net_amount").alias("revenue")
    )
    dated = per_customer.join(_first_orders(ds), "cust_id", "left")
    known, first = F.col("cust_id").isNotNull(), F.col("order_date") == F.col("first_date")

    def revenue(condition: Column) -> Column:
        return total(F.when(condition, F.col("revenue")))

    return dated.groupBy("month").agg(
        revenue(known & first).alias("new_revenue"),
        revenue(known & ~first).alias("returning_revenue"),
        revenue(~known).alias("unknown_revenue"),
    )


def return_rate(ds: Dataset) -> DataFrame:
    """Share of valid orders with at least one return."""
    returned = ds.table("sales_returns").select("order_id").distinct().withColumn("returned", F.lit(True))
    orders = valid_orders(ds.table("orders")).select("order_id").distinct()
    counted = orders.join(returned, "order_id", "left").agg(
        F.count(F.lit(1)).alias("orders"), F.count("returned").alias("returned_orders")
    )
    return counted.withColumn("return_rate_pct", percent(F.col("returned_orders"), F.col("orders")))


def refund_rate(ds: Dataset) -> DataFrame:
    """Refunded share of payments, by number and by amount."""
    refunded = F.col("refunded_at").isNotNull()
    counted = ds.table("finance_payments").agg(
        F.count(F.lit(1)).alias("payments"),
        F.count_if(refunded).alias("refunds"),
        total("amount").alias("amount"),
        total(F.when(refunded, F.col("amount"))).alias("refunded_amount"),
    )
    return counted.withColumns(
        {
            "refund_rate_pct": percent(F.col("refunds"), F.col("payments")),
            "refunded_amount_pct": percent(F.col("refunded_amount"), F.col("amount")),
        }
    )


def failed_refunds(ds: Dataset) -> DataFrame:
    """Failed refunds per month; those without a date form their own row."""
    months = ds.table("refund_failures").select(month_start("failed_at").alias("month"))
    return months.groupBy("month").agg(F.count(F.lit(1)).alias("failed_refunds"))


def payroll_to_revenue(ds: Dataset, fact: DataFrame) -> DataFrame:
    """Gross payroll as a share of revenue, for every month that has either."""
    sold = monthly_revenue_profit(fact).where(F.col("month").isNotNull()).select("month", "revenue")
    paid = payroll_monthly(ds).select("month", "gross_payroll")
    return sold.join(paid, "month", "full_outer").withColumn(
        "payroll_to_revenue_pct", percent(F.col("gross_payroll"), F.col("revenue"))
    )


def sales_velocity(ds: Dataset, fact: DataFrame) -> DataFrame:
    """Units sold per day between a category's first and last order, beside its inventory."""
    days = F.date_diff(F.max("order_date").cast("date"), F.min("order_date").cast("date")) + F.lit(1)
    sold = fact.where(F.col("category_name").isNotNull()).groupBy("category_name").agg(
        total("quantity").alias("units"), days.cast("long").alias("days")
    )
    held = inventory_by_category(ds).select("category_name", "inventory_value")
    return sold.withColumn("units_per_day", ratio(F.col("units"), F.col("days"))).join(held, "category_name", "left")


def web_conversion(ds: Dataset) -> DataFrame:
    """Share of identified visitors who placed a valid order (a proxy: no session holds an order)."""
    visitors = ds.table("page_views").where(F.col("customer_id").isNotNull()).select("customer_id").distinct()
    buyers = _first_orders(ds).select(F.col("cust_id").alias("customer_id"), F.lit(True).alias("bought"))
    counted = visitors.join(buyers, "customer_id", "left").agg(
        F.count(F.lit(1)).alias("visitors"), F.count("bought").alias("buyers")
    )
    return counted.withColumn("conversion_pct", percent(F.col("buyers"), F.col("visitors")))


def _spend_by_month(ds: Dataset) -> DataFrame:
    spend = ad_spend(ds).withColumn("month", month_start("spend_date")).where(F.col("month").isNotNull())
    return spend.groupBy("month").agg(
        total("amount").alias("marketing_spend"), F.count_distinct("campaign_id").alias("active_campaigns")
    )


def blended_acquisition_cost(ds: Dataset) -> DataFrame:
    """Marketing spend per customer whose first valid order falls into the month.

    Months without spend stay, with a cost of zero per customer.
    """
    won = _first_orders(ds).where(F.col("first_date").isNotNull())
    won = won.groupBy(month_start("first_date").alias("month")).agg(F.count(F.lit(1)).alias("new_customers"))
    spend = _spend_by_month(ds).select("month", "marketing_spend")
    both = spend.join(won, "month", "full_outer").select(
        "month",
        F.coalesce("marketing_spend", F.lit(0.0)).alias("marketing_spend"),
        F.coalesce("new_customers", F.lit(0)).alias("new_customers"),
    )
    return both.withColumn(
        "cost_per_new_customer", ratio(F.col("marketing_spend"), F.col("new_customers"))
    )


def campaign_period_trend(ds: Dataset, fact: DataFrame) -> DataFrame:
    """Months with running campaigns: how many spent, how much, and the month's revenue."""
    sold = monthly_revenue_profit(fact).where(F.col("month").isNotNull()).select("month", "revenue")
    return _spend_by_month(ds).join(sold, "month", "left")


def promotion_uplift(ds: Dataset, fact: DataFrame) -> DataFrame:
    """Mean daily revenue on days with and without a promotion (a proxy: days, not products)."""
    span = ds.table("promotions").where("start_date <= end_date").select(
        F.explode(F.sequence(F.col("start_date").cast("date"), F.col("end_date").cast("date"))).alias("day")
    )
    promoted = span.distinct().withColumn("promoted", F.lit(True))
    daily = fact.where(F.col("order_date").isNotNull()).groupBy(F.col("order_date").cast("date").alias("day")).agg(
        F.coalesce(F.sum("net_amount"), F.lit(0)).alias("revenue")
    )
    means = daily.join(promoted, "day", "left").agg(
        mean(F.when(F.col("promoted"), F.col("revenue"))).alias("promoted_daily_revenue"),
        mean(F.when(F.col("promoted").isNull(), F.col("revenue"))).alias("other_daily_revenue"),
    )
    change = F.col("promoted_daily_revenue") - F.col("other_daily_revenue")
    return means.withColumn("uplift_pct", percent(change, F.col("other_daily_revenue")))


def loyalty_redemption_rate(ds: Dataset) -> DataFrame:
    """Redemptions per hundred loyalty members."""
    redeemed = ds.table("loyalty_redemptions").agg(F.count(F.lit(1)).alias("n"))
    members = ds.table("loyalty_members").agg(F.count_distinct("customer_id").alias("members"))
    counted = members.withColumn("redemptions", redeemed.select("n").scalar())
    return counted.withColumn("redemptions_per_100_members", percent(F.col("redemptions"), F.col("members")))


def procedure_failures(ds: Dataset) -> DataFrame:
    """Procedure calls and their failed share."""
    counted = ds.table("procedure_calls").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") == _FAILED).alias("failures")
    )
    return counted.withColumn("failure_rate_pct", percent(F.col("failures"), F.col("calls")))
