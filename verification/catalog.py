"""Every result of the library as a named query over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradescope.dataset import Dataset, Results
from tradescope.functions.exprs import number_or_zero
from tradescope.functions.text import currency, html_escape, percent_text
from tradescope.operators import clean, filters, quality, ranking
from tradescope.operators.filters import Filters
from tradescope.operators.staging import stage
from tradescope.plans import cross, fact, finance, hr, insights, kpis, marketing, operations, report, rfm, sales
from tradescope.session import prepare
from tradescope.sources.sinks import html_lines
from verification.tables import dataset

Query = Callable[[SparkSession, str], DataFrame]

# Parameters shared with the oracle SQL.
YEARS = [1997, 1998, 2000]
PLATFORMS = ["AF", "RO"]
REGIONS = ["ASIA", "EUROPE"]
WAREHOUSE_ZONES = ["Zone-2", "Zone-3"]
CATEGORIES = ["Category-1", "Category-2", "Category-4"]

_QUERIES: dict[str, Query] = {}


def _doubles(df: DataFrame) -> DataFrame:
    """Decimals leave the engine as doubles."""
    decimals = [f.name for f in df.schema if isinstance(f.dataType, T.DecimalType)]
    return df.withColumns({c: F.col(c).cast("double") for c in decimals})


def _query(name: str):
    def register(build: Callable[[Dataset], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return _doubles(build(dataset(spark, sf_dir)))

        _QUERIES[name] = run
        return build

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _fact(ds: Dataset, *dimensions: str) -> DataFrame:
    return fact.sales_fact(ds, dimensions)


def _category_fact(ds: Dataset) -> DataFrame:
    return _fact(ds, "category")


def _narrow_fact(ds: Dataset) -> DataFrame:
    """The fact columns the text results read."""
    columns = "order_id cust_id order_date month prod_id product_name category_name region_name"
    measures = "quantity net_amount cost profit"
    return fact.sales_fact(ds).select(*columns.split(), *measures.split())


# --- Fact, dimension and filters -----------------------------------------------------------

_query("product_dimension")(fact.product_dimension)


@_query("sales_fact")
def _(ds):
    return fact.sales_fact(ds).select(
        "order_id", "prod_id", "cust_id", "order_date", "order_status", "net_total",
        "order_discount_amount", "item_discount_amount", "gross_amount", "quantity",
        "net_amount", "product_name", "brand_name", "category_name", "store_name",
        "region_name", "state", "cost", "profit", "profit_margin_pct", "month",
    )


@_query("categorised_products")
def _(ds):
    return fact.categorised_products(ds).drop("brand_id")


@_query("sales_filtered")
def _(ds):
    chosen = Filters(years=YEARS, regions=REGIONS, categories=CATEGORIES)
    return sales.monthly_sales(filters.filter_sales(fact.sales_fact(ds), chosen))


@_query("sales_filtered_store_product")
def _(ds):
    chosen = Filters(
        states=["State of ASIA"],
        stores=["NATION_2", "NATION_7", "NATION_12"],
        products=["small ring", "red widget", "blue bolt"],
    )
    return sales.regional_contribution(filters.filter_sales(fact.sales_fact(ds), chosen))


@_query("filter_options")
def _(ds):
    return filters.filter_options(ds, fact.sales_fact(ds))


@_query("valid_orders_by_status")
def _(ds):
    kept = filters.valid_orders(ds.table("orders"))
    return kept.groupBy("order_status").agg(F.count(F.lit(1)).alias("orders"))


# --- Sales and customers -------------------------------------------------------------------


@_query("executive_kpis")
def _(ds):
    return sales.executive_kpis(_fact(ds))


@_query("monthly_sales")
def _(ds):
    return sales.monthly_sales(_fact(ds))


_query("monthly_sales_with_cost")(sales.monthly_sales_with_cost)


@_query("product_contribution")
def _(ds):
    return sales.product_contribution(_fact(ds))


_query("top_products")(sales.top_products)


@_query("category_contribution")
def _(ds):
    return sales.category_contribution(_category_fact(ds))


@_query("regional_contribution")
def _(ds):
    return sales.regional_contribution(_fact(ds, "region"))


_query("region_state_sales")(sales.region_state_sales)


@_query("return_reasons")
def _(ds):
    return sales.return_reasons(ds, _category_fact(ds))


_query("review_distribution")(sales.review_distribution)
_query("loyalty_by_tier")(sales.loyalty_by_tier)
_query("ticket_resolution")(sales.ticket_resolution)


@_query("rfm_segments")
def _(ds):
    return rfm.rfm_segments(_fact(ds))


@_query("rfm_segments_by_monetary")
def _(ds):
    return rfm.rfm_segments(_fact(ds), by_monetary=True)


@_query("segment_counts")
def _(ds):
    return rfm.segment_counts(rfm.rfm_segments(_fact(ds)))


@_query("segment_summary")
def _(ds):
    return rfm.segment_summary(rfm.rfm_segments(_fact(ds)))


@_query("at_risk_customers")
def _(ds):
    return rfm.at_risk_customers(rfm.rfm_segments(_fact(ds)))


@_query("repeat_purchase_rate")
def _(ds):
    customers = rfm.customer_values(_fact(ds)).where(F.col("cust_id").isNotNull())
    return rfm.repeat_purchase_rate(customers)


_query("rfm_base")(rfm.rfm_base)


@_query("order_position_in_priority")
def _(ds):
    """Exact rank of every payment inside its reason, the primitive under the RFM scores."""
    payments = ds.table("finance_payments").select("refund_reason", "amount", "payment_id")
    return ranking.position_in_group(payments, ["refund_reason"], ["amount", "payment_id"])


@_query("top_12_products")
def _(ds):
    return sales.leading(sales.product_contribution(_fact(ds)), "revenue", "product_name", 12)


@_query("top_10_return_reasons")
def _(ds):
    reasons = sales.return_reasons(ds, _category_fact(ds))
    return sales.leading(reasons, "refund_value", "reason", 10)


@_query("latest_12_months")
def _(ds):
    return sales.latest(sales.monthly_sales(_fact(ds)), "month", 12)


# --- Marketing -----------------------------------------------------------------------------


@_query("platform_spend")
def _(ds):
    return marketing.platform_spend(marketing.ad_spend(ds))


@_query("platform_spend_filtered")
def _(ds):
    return marketing.platform_spend(marketing.ad_spend(ds, YEARS, PLATFORMS))


@_query("monthly_spend")
def _(ds):
    return marketing.monthly_spend(marketing.ad_spend(ds))


@_query("campaign_pacing")
def _(ds):
    return marketing.campaign_pacing(ds, marketing.ad_spend(ds))


_query("campaign_pacing_all")(marketing.campaign_pacing_all)
_query("email_performance")(marketing.email_performance)
_query("email_rates")(marketing.email_rates)


@_query("first_15_emails")
def _(ds):
    return marketing.email_performance(ds).orderBy("campaign_name").limit(15)


@_query("spend_sales_trend")
def _(ds):
    return marketing.spend_sales_trend(_fact(ds), marketing.ad_spend(ds))


_query("web_engagement")(marketing.web_engagement)


@_query("marketing_cards")
def _(ds):
    spend = marketing.spend_cells(marketing.ad_spend(ds))
    return marketing.marketing_cards(
        marketing.platform_spend(spend),
        marketing.email_performance(ds),
        marketing.spend_sales_trend(_fact(ds), spend),
    )


_query("spend_and_revenue")(marketing.spend_and_revenue)


# --- Finance -------------------------------------------------------------------------------


@_query("expense_categories")
def _(ds):
    return finance.expense_categories(ds, finance.expenses_in_scope(ds))


@_query("top_12_expense_categories")
def _(ds):
    by_category = finance.expense_categories(ds, finance.expenses_in_scope(ds))
    return sales.leading(by_category, "expense", "category_name", 12)


_query("expense_totals")(finance.expense_totals)


@_query("monthly_expenses")
def _(ds):
    return finance.monthly_expenses(finance.expenses_in_scope(ds, YEARS))


@_query("profit_and_loss")
def _(ds):
    opex = finance.monthly_expenses(finance.expenses_in_scope(ds))
    return finance.profit_and_loss(_fact(ds), opex)


_query("payment_status")(finance.payment_status)
_query("refund_reasons")(finance.refund_reasons)
_query("refund_log")(lambda ds: finance.refund_log(ds, YEARS))
_query("refund_totals")(finance.refund_totals)


@_query("finance_cards")
def _(ds):
    opex = finance.monthly_expenses(finance.expenses_in_scope(ds))
    return finance.finance_cards(opex, _fact(ds), finance.refund_log(ds))


# --- Workforce -----------------------------------------------------------------------------

_query("headcount")(hr.headcount)
_query("role_salary")(hr.role_salary)


@_query("revenue_per_employee")
def _(ds):
    return hr.revenue_per_employee(ds, sales.executive_kpis(_fact(ds)))


_query("payroll_monthly")(lambda ds: hr.payroll_monthly(ds, YEARS))
_query("payroll_by_department")(hr.payroll_by_department)
_query("attendance_summary")(hr.attendance_summary)
_query("attendance_by_department")(hr.attendance_by_department)
_query("salary_payment_status")(lambda ds: hr.salary_payment_status(ds, YEARS))


@_query("hr_cards")
def _(ds):
    return hr.hr_cards(ds, hr.headcount(ds), hr.payroll_monthly(ds))


# --- Operations and logistics --------------------------------------------------------------

_query("inventory_risk")(operations.inventory_risk)
_query("inventory_below_reorder")(operations.inventory_below_reorder)
_query("inventory_by_category")(operations.inventory_by_category)
_query("outbound_status")(lambda ds: operations.outbound_status(operations.outbound_shipments(ds, YEARS)))


@_query("outbound_status_filtered")
def _(ds):
    return operations.outbound_status(operations.outbound_shipments(ds, None, ["Delivered"]))


@_query("courier_performance")
def _(ds):
    return operations.courier_performance(operations.outbound_shipments(ds))


_query("courier_status_shipments")(operations.courier_status_shipments)


@_query("supplier_lead_time")
def _(ds):
    return operations.supplier_lead_time(ds, operations.inbound_in_scope(ds, with_warehouse=False))


@_query("fastest_12_suppliers")
def _(ds):
    by_supplier = operations.supplier_lead_time(ds, operations.inbound_in_scope(ds, with_warehouse=False))
    return sales.leading(by_supplier, "avg_lead_days", "supplier_name", 12, descending=False)


_query("supplier_shipments")(operations.supplier_shipments)


@_query("warehouse_flow")
def _(ds):
    return operations.region_flow(ds)


@_query("warehouse_flow_filtered")
def _(ds):
    return operations.region_flow(ds, YEARS, WAREHOUSE_ZONES)


_query("production_quality")(operations.production_quality)
_query("line_quality")(operations.line_quality)
_query("api_health")(operations.api_health)


@_query("operations_cards")
def _(ds):
    return operations.operations_cards(
        ds,
        operations.courier_performance(operations.outbound_shipments(ds)),
        operations.production_quality(ds),
        operations.supplier_lead_time(ds, operations.inbound_in_scope(ds, with_warehouse=False)),
    )


# --- Cross-functional ----------------------------------------------------------------------


@_query("marketing_sales_profit")
def _(ds):
    results = cross.cross_functional_results(ds, _category_fact(ds), YEARS, PLATFORMS)
    return results["marketing_sales_profit"]


@_query("profit_cost")
def _(ds):
    return cross.cross_functional_results(ds, _category_fact(ds), YEARS)["profit_cost"]


@_query("region_sales_staff")
def _(ds):
    return cross.region_sales_staff(ds, _fact(ds, "region"))


@_query("category_margin_inventory")
def _(ds):
    return cross.category_margin_inventory(ds, _category_fact(ds))


_query("category_capital_and_margin")(cross.category_capital_and_margin)


@_query("overview_cards")
def _(ds):
    return cross.overview_cards(ds, _fact(ds))


# --- Documented indicators -----------------------------------------------------------------


_query("units_per_order")(lambda ds: kpis.units_per_order(_fact(ds)))
_query("new_and_returning_revenue")(lambda ds: kpis.new_and_returning_revenue(ds, _fact(ds)))
_query("return_rate")(kpis.return_rate)
_query("refund_rate")(kpis.refund_rate)
_query("failed_refunds")(kpis.failed_refunds)
_query("payroll_to_revenue")(lambda ds: kpis.payroll_to_revenue(ds, _fact(ds)))
_query("sales_velocity")(lambda ds: kpis.sales_velocity(ds, _category_fact(ds)))
_query("web_conversion")(kpis.web_conversion)
_query("blended_acquisition_cost")(kpis.blended_acquisition_cost)
_query("campaign_period_trend")(lambda ds: kpis.campaign_period_trend(ds, _fact(ds)))
_query("promotion_uplift")(lambda ds: kpis.promotion_uplift(ds, _fact(ds)))
_query("loyalty_redemption_rate")(kpis.loyalty_redemption_rate)
_query("procedure_failures")(kpis.procedure_failures)


# --- Unfiltered forms, and whole bundles in long form --------------------------------------

_query("monthly_expenses_all")(lambda ds: finance.monthly_expenses(finance.expenses_in_scope(ds)))
_query("payroll_monthly_all")(hr.payroll_monthly)
_query("refund_log_all")(finance.refund_log)
_query("salary_payment_status_all")(hr.salary_payment_status)
_query("outbound_status_all")(lambda ds: operations.outbound_status(operations.outbound_shipments(ds)))

# bundle: result -> (registered query with the same rows, key column, measures); shared with the oracle.
BUNDLES = {
    "sales_bundle": {
        "monthly": ("monthly_sales", "month", "revenue profit orders"),
        "rfm": ("rfm_segments", "cust_id", "frequency monetary rfm_total"),
        "products": ("product_contribution", "product_name", "revenue units"),
        "categories": ("category_contribution", "category_name", "revenue profit"),
        "regions": ("regional_contribution", "region_name", "revenue orders"),
        "return_reasons": ("return_reasons", "reason", "refund_value return_count"),
        "reviews": ("review_distribution", "rating", "review_count"),
        "loyalty": ("loyalty_by_tier", "tier", "members points_balance"),
        "tickets": ("ticket_resolution", "category", "ticket_count avg_resolution_hours"),
    },
    "marketing_bundle": {
        "platform_spend": ("platform_spend", "platform", "spend"),
        "monthly_spend": ("monthly_spend", "month", "marketing_spend"),
        "campaign_pacing": ("campaign_pacing", "campaign_id", "actual_spend budget_variance"),
        "email_performance": ("email_performance", "campaign_name", "sent opened clicked ctr_pct"),
        "spend_sales_trend": ("spend_sales_trend", "month", "revenue marketing_spend"),
        "web_engagement": ("web_engagement", "'all'", "identified_sessions avg_pages_per_session"),
    },
    "hr_bundle": {
        "headcount": ("headcount", "dept_name", "headcount avg_salary"),
        "role_salary": ("role_salary", "role", "headcount avg_salary"),
        "revenue_per_employee": ("revenue_per_employee", "'all'", "revenue_per_employee"),
        "payroll_monthly": ("payroll_monthly_all", "month", "gross_payroll net_payroll deductions"),
        "attendance": ("attendance_summary", "dept_name", "attendance_days avg_worked_hours"),
        "salary_payment_status": ("salary_payment_status_all", "status", "payment_count amount"),
    },
    "operations_bundle": {
        "inventory_risk": ("inventory_risk", "product_id", "inventory_value"),
        "inventory_by_category": ("inventory_by_category", "category_name", "inventory_units inventory_value"),
        "outbound_status": ("outbound_status_all", "status", "shipments avg_delivery_days"),
        "courier": ("courier_performance", "courier_name", "shipments avg_delivery_days"),
        "supplier_lead": ("supplier_lead_time", "supplier_name", "inbound_units avg_lead_days"),
        "warehouse_flow": ("warehouse_flow", "region", "inbound_units avg_lead_days"),
        "production": ("production_quality", "line_name", "produced rejected yield_pct"),
        "api_health": ("api_health", "endpoint", "requests error_rate_pct p95_latency_ms"),
    },
}


def _long(results: Results, bundle: str) -> DataFrame:
    """(result, key, measure, value) rows of every result of a bundle."""
    parts = []
    for name, (_, key, measures) in BUNDLES[bundle].items():
        cells = [F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures.split()]
        part = results[name].select(F.lit(name).alias("result"), F.expr(key).cast("string").alias("key"), F.inline(F.array(*cells)))
        parts.append(part)
    assert set(BUNDLES[bundle]) == set(results)
    return reduce(DataFrame.unionByName, parts)


@_query("sales_bundle")
def _(ds):
    return _long(sales.sales_customer_results(ds, _narrow_fact(ds)), "sales_bundle")


@_query("marketing_bundle")
def _(ds):
    return _long(marketing.marketing_results(ds, _fact(ds)), "marketing_bundle")


@_query("hr_bundle")
def _(ds):
    return _long(hr.hr_results(ds, sales.executive_kpis(_fact(ds))), "hr_bundle")


@_query("operations_bundle")
def _(ds):
    return _long(operations.operations_results(ds), "operations_bundle")


# --- Observations and report ---------------------------------------------------------------


@_query("insights")
def _(ds):
    return insights.build_insights(ds, _narrow_fact(ds))


@_query("management_priorities")
def _(ds):
    return insights.build_insights(ds, _narrow_fact(ds), groups=insights.PRIORITY_GROUPS)


@_query("fact_insights")
def _(ds):
    return insights.fact_insights(_narrow_fact(ds))


@_query("report_lines")
def _(ds):
    return report.build_report(ds, _narrow_fact(ds), Filters()).lines


@_query("report_html")
def _(ds):
    lines = report.build_report(ds, _narrow_fact(ds), Filters()).lines
    return html_lines(stage(lines, "report_lines"))


# --- Cleaning and validation ---------------------------------------------------------------


def _doubled(df: DataFrame) -> DataFrame:
    return df.unionByName(df)


@_query("duplicate_rows_dropped")
def _(ds):
    items = clean.drop_duplicate_rows(_doubled(ds.table("order_items")))
    return items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("items"), F.sum("net_amount").alias("net_amount")
    )


def _events(ds: Dataset) -> DataFrame:
    views = ds.table("page_views").select(F.col("view_id"), F.col("customer_id"))
    forward = F.concat(F.lit('{"user": '), F.coalesce(F.col("customer_id"), F.lit(-1)), F.lit(', "kind": "view"}'))
    backward = F.concat(F.lit('{"kind":"view","user":'), F.coalesce(F.col("customer_id"), F.lit(-1)), F.lit("}"))
    day = F.col("view_id") % 100
    rows = views.select(F.inline(F.array(
        F.struct(day.alias("slot"), forward.alias("payload")),
        F.struct(day.alias("slot"), backward.alias("payload")),
    )))
    return rows


@_query("json_duplicates_dropped")
def _(ds):
    """Every page view twice, with its JSON keys in either order; one row must remain."""
    kept = clean.drop_duplicate_rows(_events(ds), ["payload"])
    return kept.select("slot", F.get_json_object("payload", "$.user").cast("long").alias("user"))


@_query("dates_standardised")
def _(ds):
    """Text dates back to timestamps, with unparsable ones turned to null."""
    orders = ds.table("orders")
    text = F.when(F.col("payment_mode_id") == 3, F.lit("not a date")).otherwise(
        F.col("order_date").cast("string")
    )
    raw = orders.select("order_id", text.alias("order_date"))
    return clean.standardise_dates(raw, ["order_date"])


@_query("numbers_coerced")
def _(ds):
    """Text amounts back to numbers, zero where the text is not a number."""
    text = F.when(F.col("status") == "Cancelled", F.lit("n/a")).otherwise(
        F.col("amount").cast("string")
    )
    return ds.table("finance_payments").select(
        "payment_id", number_or_zero(text).cast("double").alias("amount")
    )


@_query("required_tables")
def _(ds):
    return quality.validate_required(ds)


@_query("quality_profile")
def _(ds):
    return quality.quality_profile(ds)


@_query("order_row_count")
def _(ds):
    return quality.row_count(ds.table("orders"), "order_count")


@_query("order_date_coverage")
def _(ds):
    return quality.date_coverage(ds.table("orders"), "order_date")


@_query("duplicate_shipment_ids")
def _(ds):
    return quality.duplicate_keys(ds.table("sales_shipments"), "shipment_id")


# --- Text rendering ------------------------------------------------------------------------


@_query("currency_text")
def _(ds):
    """Net amounts in every size class, negative and missing ones included."""
    sized = F.when(F.col("payment_id") % 5 == 0, F.col("amount") / 1000)
    sized = sized.when(F.col("payment_id") % 5 == 1, F.col("amount") * 100)
    sized = sized.when(F.col("payment_id") % 5 == 2, -F.col("amount"))
    sized = sized.when(F.col("payment_id") % 5 == 3, F.col("amount") / 10)
    return ds.table("finance_payments").select("payment_id", currency(sized).alias("amount_text"))


@_query("percent_text")
def _(ds):
    share = F.when(F.col("net_total") > 100000, F.col("discount_amount") / 1000)
    return ds.table("orders").select("order_id", percent_text(share).alias("share_text"))


@_query("html_text")
def _(ds):
    text = F.concat(F.lit("<b>"), "product_name", F.lit("'s \"new\" & "), "product_name", F.lit("</b>"))
    return ds.table("products").select("product_id", html_escape(text).alias("html"))
