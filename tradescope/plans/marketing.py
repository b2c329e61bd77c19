"""Marketing results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradescope.dataset import Dataset, Results
from tradescope.functions.exprs import (
    mean,
    mean_rate,
    month_start,
    percent,
    percent_2dp,
    ratio,
    sql_total,
    total,
    with_numbers,
)
from tradescope.operators.filters import by_years, where_in
from tradescope.operators.joins import lookup, lookup_table, named_by
from tradescope.plans.fact import inner_sales
from tradescope.plans.sales import monthly_sales

_EMAIL_COUNTS = ["emails_sent", "emails_opened", "emails_clicked"]


def ad_spend(
    ds: Dataset, years: Sequence[int] | None = None, platforms: Sequence[str] | None = None
) -> DataFrame:
    """The ad spend in scope; the platform choice does not touch e-mail results."""
    return where_in(by_years(ds.table("ads_spend"), ["spend_date"], years), "platform", platforms)


def spend_cells(spend: DataFrame) -> DataFrame:
    """The spend per platform and month, in the form of ad spend rows.

    Results by platform and by month that both start from it share one pass over the spend.
    """
    dated = spend.withColumn("spend_date", month_start("spend_date"))
    return dated.groupBy("platform", "spend_date").agg(F.sum("amount").alias("amount"))


def platform_spend(spend: DataFrame) -> DataFrame:
    return (
        spend.where(F.col("platform").isNotNull())
        .groupBy("platform")
        .agg(total("amount").alias("spend"))
        .orderBy(F.col("spend").desc(), "platform")
    )


def monthly_spend(spend: DataFrame) -> DataFrame:
    return (
        spend.withColumn("month", month_start("spend_date"))
        .where(F.col("month").isNotNull())
        .groupBy("month")
        .agg(total("amount").alias("marketing_spend"))
    )


def campaign_pacing(ds: Dataset, spend: DataFrame) -> DataFrame:
    """Spend against budget for the campaigns that spent something."""
    pacing = (
        spend.where(F.col("campaign_id").isNotNull())
        .groupBy("campaign_id")
        .agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("spent"))
        .withColumn("actual_spend", F.col("spent").cast("double"))
    )
    details = ["campaign_name", "budget", "start_date", "end_date"]
    pacing = lookup_table(pacing, ds, "campaigns", "campaign_id", details)
    if "campaigns" in ds:
        budget = F.col("budget") if "budget" in pacing.columns else F.lit(0)
        pacing = pacing.withColumns(
            {
                "budget_variance": (budget - F.col("spent")).cast("double"),
                "spend_to_budget_pct": percent(F.col("actual_spend"), budget),
            }
        )
    if "budget" in pacing.columns:
        pacing = pacing.withColumn("budget", F.col("budget").cast("double"))
    return pacing.drop("spent").orderBy(F.col("actual_spend").desc(), "campaign_id")


def email_performance(ds: Dataset, years: Sequence[int] | None = None) -> DataFrame:
    emails = with_numbers(
        by_years(ds.table("email_clicks"), ["sent_date"], years), _EMAIL_COUNTS, T.LongType()
    )
    # Counts are added up per campaign before the campaign name is looked up.
    per_campaign = emails.groupBy("campaign_id").agg(*[F.sum(c).alias(c) for c in _EMAIL_COUNTS])
    named = named_by(per_campaign, ds, "campaigns", "campaign_id", ["campaign_name"])
    key = "campaign_name" if "campaign_name" in named.columns else "campaign_id"
    sent, opened, clicked = F.col("sent"), F.col("opened"), F.col("clicked")
    return (
        named.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.sum("emails_sent").alias("sent"),
            F.sum("emails_opened").alias("opened"),
            F.sum("emails_clicked").alias("clicked"),
        )
        .withColumns(
            {
                "open_rate_pct": percent(opened, sent),
                "ctr_pct": percent(clicked, sent),
                "ctor_pct": percent(clicked, opened),
            }
        )
    )


def spend_sales_trend(fact: DataFrame, spend: DataFrame | None) -> DataFrame:
    """Monthly sales with the month's ad spend, zero where nothing was spent."""
    trend = monthly_sales(fact)
    if spend is None:
        trend = trend.withColumn("marketing_spend", F.lit(0.0))
    else:
        trend = lookup(trend, monthly_spend(spend), "month").fillna({"marketing_spend": 0.0})
    return trend.withColumn(
        "revenue_per_spend", ratio(F.col("revenue"), F.col("marketing_spend"))
    ).orderBy("month")


def web_engagement(ds: Dataset, years: Sequence[int] | None = None) -> DataFrame:
    """Identified and anonymous sessions, pages per session and single-page share."""
    views = by_years(ds.table("page_views"), ["view_timestamp"], years)
    sessions = (
        views.where(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(
            F.count_distinct("view_id").alias("pages"),
            F.max(F.col("customer_id").isNotNull()).alias("identified"),
        )
    )
    single = F.count_if(F.col("pages") == 1)
    return sessions.agg(
        F.count_if(F.col("identified")).alias("identified_sessions"),
        F.count_if(~F.col("identified")).alias("anonymous_sessions"),
        mean("pages").alias("avg_pages_per_session"),
        percent(single, F.count(F.lit(1))).alias("single_page_share_pct"),
    )


def marketing_results(
    ds: Dataset,
    fact: DataFrame,
    years: Sequence[int] | None = None,
    platforms: Sequence[str] | None = None,
) -> Results:
    results: dict[str, Callable[[], DataFrame]] = {}
    spend = ad_spend(ds, years, platforms) if "ads_spend" in ds else None
    if spend is not None:
        results["platform_spend"] = lambda: platform_spend(spend)
        results["monthly_spend"] = lambda: monthly_spend(spend)
        results["campaign_pacing"] = lambda: campaign_pacing(ds, spend)
    if "email_clicks" in ds:
        results["email_performance"] = lambda: email_performance(ds, years)
    results["spend_sales_trend"] = lambda: spend_sales_trend(fact, spend)
    if "page_views" in ds:
        results["web_engagement"] = lambda: web_engagement(ds, years)
    return Results(results)


def marketing_cards(
    platforms: DataFrame, emails: DataFrame, trend: DataFrame
) -> DataFrame:
    """Total spend, mean open and click rates of campaigns, mean revenue per spend."""
    rates = emails.agg(
        mean_rate("open_rate_pct").alias("avg_open_rate_pct"),
        mean_rate("ctr_pct").alias("avg_ctr_pct"),
    )
    spent = platforms.agg(total(F.col("spend").cast("decimal(38,4)")).alias("v"))
    per_spend = trend.agg(mean_rate("revenue_per_spend").alias("v"))
    return rates.select(
        spent.select("v").scalar().alias("marketing_spend"),
        "avg_open_rate_pct",
        "avg_ctr_pct",
        per_spend.select("v").scalar().alias("avg_revenue_per_spend"),
    )


# --- SQL reports -------------------------------------------------------------------------


def campaign_pacing_all(ds: Dataset) -> DataFrame:
    """Budget pacing of every campaign, spending or not; spend is added up before the join."""
    spend = ds.table("ads_spend").groupBy("campaign_id").agg(F.sum("amount").alias("amount"))
    spent = F.coalesce(F.col("spent"), F.lit(0)).cast("double")
    budget = F.col("budget").cast("double")
    return (
        ds.table("campaigns")
        .select("campaign_id", "campaign_name", "budget")
        .join(spend, "campaign_id", "left")
        .groupBy("campaign_name", "budget")
        .agg(F.sum("amount").alias("spent"))
        .select(
            "campaign_name",
            budget.alias("budget"),
            spent.alias("actual_spend"),
            percent_2dp(spent, budget).alias("spend_to_budget_pct"),
        )
        .orderBy(F.col("actual_spend").desc(), "campaign_name")
    )


def email_rates(ds: Dataset) -> DataFrame:
    """E-mail counts and rounded rates of the known campaigns."""
    per_campaign = (
        ds.table("email_clicks")
        .groupBy("campaign_id")
        .agg(*[F.sum(c).alias(c) for c in _EMAIL_COUNTS])
    )
    sent, opened, clicked = (F.col(c) for c in _EMAIL_COUNTS)
    return (
        per_campaign.join(ds.table("campaigns").select("campaign_id", "campaign_name"), "campaign_id")
        .groupBy("campaign_name")
        .agg(*[F.sum(c).alias(c) for c in _EMAIL_COUNTS])
        .withColumns(
            {
                "open_rate_pct": percent_2dp(opened, sent),
                "ctr_pct": percent_2dp(clicked, sent),
                "ctor_pct": percent_2dp(clicked, opened),
            }
        )
        .orderBy(F.col("ctr_pct").desc_nulls_first(), "campaign_name")
    )


def spend_and_revenue(ds: Dataset) -> DataFrame:
    """Months with sales or spend, zero for the side that is missing."""
    sales = (
        inner_sales(ds)
        .withColumn("month", month_start("order_date").cast("date"))
        .groupBy("month")
        .agg(
            sql_total("net_amount").alias("revenue"),
            (F.sum("net_amount") - F.sum("cost")).cast("double").alias("profit"),
        )
    )
    spend = (
        ds.table("ads_spend")
        .withColumn("month", month_start("spend_date").cast("date"))
        .groupBy("month")
        .agg(sql_total("amount").alias("marketing_spend"))
    )
    return (
        sales.join(spend, "month", "full_outer")
        .fillna(0.0, ["marketing_spend", "revenue", "profit"])
        .select("month", "marketing_spend", "revenue", "profit")
        .orderBy(F.col("month").asc_nulls_last())
    )
