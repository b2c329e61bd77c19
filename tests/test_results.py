from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.helpers import by, dataset, frame, rows
from tradescope.dataset import Dataset
from tradescope.operators.filters import filter_options
from tradescope.plans import cross, finance, hr, insights, marketing, operations, report, sales
from tradescope.plans.fact import categorised_products, product_dimension, sales_fact


@pytest.fixture(scope="module")
def shop(spark):
    """Four orders: one cancelled, one with an unknown product, one in a nameless category."""
    orders = [
        {"order_id": 1, "cust_id": 7, "store_id": 1, "order_status": "Delivered", "order_date": "2024-01-05", "discount_amount": 3},
        {"order_id": 2, "cust_id": 8, "store_id": 2, "order_status": "Processing", "order_date": "2024-02-05"},
        {"order_id": 3, "cust_id": 7, "store_id": 9, "order_status": "Out for Delivery", "order_date": "2024-02-06"},
        {"order_id": 4, "cust_id": 9, "store_id": 1, "order_status": "Cancelled", "order_date": "2024-02-07"},
    ]
    items = [
        {"order_id": 1, "prod_id": 1, "quantity": 2, "net_amount": 100, "discount_amount": 1},
        {"order_id": 1, "prod_id": 99, "quantity": 1, "net_amount": 50},
        {"order_id": 2, "prod_id": 2, "quantity": 4, "net_amount": 200},
        {"order_id": 3, "prod_id": 1, "quantity": 1, "net_amount": 0},
        {"order_id": 4, "prod_id": 1, "quantity": 9, "net_amount": 900},
    ]
    return dataset(
        spark,
        orders=orders,
        order_items=items,
        products=[
            {"product_id": 1, "product_name": "Lamp", "brand_id": 1, "cost_price": 20},
            {"product_id": 2, "product_name": "Desk", "brand_id": 2, "cost_price": 45},
        ],
        brand=[{"brand_id": 1, "category_id": 1}, {"brand_id": 2, "category_id": 2}],
        category=[{"category_id": 1, "category_name": "Light"}, {"category_id": 2}],
        stores=[{"store_id": 1, "store_name": "A", "region_id": 1}, {"store_id": 2, "store_name": "B", "region_id": 2}],
        region=[{"region_id": 1, "region_name": "North", "state": "N"}, {"region_id": 2, "region_name": "South", "state": "S"}],
    )


@pytest.fixture(scope="module")
def fact(shop):
    return sales_fact(shop).cache()


def test_fact_rows_and_unknown_product(fact):
    got = {(r.order_id, r.prod_id): r for r in fact.collect()}
    assert set(got) == {(1, 1), (1, 99), (2, 2), (3, 1)}
    unknown = got[(1, 99)]
    assert unknown.cost == 0 and unknown.profit == 50 and unknown.product_name is None
    assert float(got[(1, 1)].profit) == 60 and got[(1, 1)].profit_margin_pct == 60.0
    assert got[(3, 1)].profit_margin_pct is None
    assert float(got[(1, 1)].order_discount_amount) == 3 and float(got[(1, 1)].item_discount_amount) == 1
    assert got[(3, 1)].region_name is None and got[(2, 2)].month == datetime(2024, 2, 1)


def test_clashing_names_get_a_suffix(spark, shop):
    stores = shop["stores"].withColumn("product_name", F.lit("shelf")).withColumn("state", F.lit("open"))
    got = sales_fact(shop.with_tables(stores=stores))
    assert {"product_name", "product_name_store", "state", "state_region"} <= set(got.columns)
    assert got.where("order_id = 2").collect()[0].product_name == "Desk"


def test_fact_without_optional_tables(shop, spark):
    bare = Dataset(spark, {k: shop[k] for k in ("orders", "order_items")})
    kpis = sales.executive_kpis(sales_fact(bare)).collect()[0]
    assert (kpis.revenue, kpis.profit, kpis.orders) == (350.0, 350.0, 3)


def test_category_through_the_product_when_the_brand_has_none(spark, shop):
    products = shop["products"].withColumn("category_id", F.lit(1).cast("long"))
    ds = shop.with_tables(products=products, brand=shop["brand"].drop("category_id"))
    assert {r.category_name for r in product_dimension(ds).collect()} == {"Light"}
    assert categorised_products(ds).count() == 2


def test_kpis_and_monthly(fact):
    kpis = sales.executive_kpis(fact).collect()[0]
    assert (kpis.revenue, kpis.profit, kpis.orders, kpis.aov) == (350.0, 110.0, 3, 350 / 3)
    months = by(sales.monthly_sales(fact), "month")
    assert months[datetime(2024, 2, 1)]["orders"] == 2
    assert sum(m["revenue"] for m in months.values()) == kpis.revenue


def test_kpis_of_nothing(spark):
    kpis = sales.executive_kpis(sales_fact(dataset(spark, orders=[], order_items=[]))).collect()[0]
    assert (kpis.revenue, kpis.profit, kpis.margin_pct, kpis.orders, kpis.aov) == (0.0, 0.0, None, 0, None)


def test_null_groups_are_dropped_in_dashboards_and_kept_in_sql_reports(spark, shop, fact):
    assert set(by(sales.category_contribution(fact), "category_name")) == {"Light"}
    stock = frame(spark, "inventory", {"product_id": 2, "quantity_on_hand": 3, "reorder_level": 5})
    report_rows = by(cross.category_capital_and_margin(shop.with_tables(inventory=stock)), "category_name")
    assert set(report_rows) == {"Light", None}
    # Null does not join null, so the nameless category shows no capital.
    assert report_rows[None]["inventory_working_capital"] is None


def test_month_without_revenue_has_no_margin(spark):
    ds = dataset(
        spark,
        orders=[{"order_id": 1, "order_status": "Shipped", "order_date": "2024-05-01"}],
        order_items=[{"order_id": 1, "net_amount": 0}],
    )
    assert sales.monthly_sales(sales_fact(ds)).collect()[0].margin_pct is None


def test_sql_and_dashboard_months_agree_on_known_products(spark, shop):
    known = shop.with_tables(order_items=shop["order_items"].where("prod_id <> 99"))
    a = {r.month.date(): r.revenue for r in sales.monthly_sales(sales_fact(known)).collect()}
    b = {r.month: r.revenue for r in sales.monthly_sales_with_cost(shop).collect()}
    assert a == b


def test_returns_keep_counting_outside_the_filtered_fact(spark, shop, fact):
    returned = frame(
        spark, "sales_returns",
        {"return_id": 1, "order_id": 1, "prod_id": 1, "reason": "Late", "refund_amount": 5},
        {"return_id": 2, "order_id": 4, "prod_id": 1, "reason": "Late", "refund_amount": 7},
        {"return_id": 2, "order_id": 4, "prod_id": 1, "refund_amount": 7},
    )
    got = rows(sales.return_reasons(shop.with_tables(sales_returns=returned), fact), "reason", "refund_value", "return_count")
    assert got == [("Late", 12.0, 2)]


def test_loyalty_falls_back_to_the_tier_id(spark):
    members = [{"customer_id": 1, "tier_id": 4, "points_balance": 5}, {"customer_id": 2}]
    ds = dataset(spark, loyalty_members=members)
    assert rows(sales.loyalty_by_tier(ds), "tier", "members", "points_balance") == [(4, 1, 5.0)]


def test_filter_options(shop, fact):
    options = {(r.filter, r.value) for r in filter_options(shop, fact).collect()}
    assert {("years", "2024"), ("regions", "North"), ("categories", "Light")} <= options
    assert not any(value is None for _, value in options)


def test_spend_and_sales_in_different_months(spark, shop, fact):
    spend = frame(
        spark, "ads_spend",
        {"campaign_id": 1, "platform": "X", "amount": 50, "spend_date": "2024-02-01"},
        {"campaign_id": 1, "platform": "Y", "amount": 10, "spend_date": "2024-03-01"},
    )
    trend = by(marketing.spend_sales_trend(fact, spend), "month")
    assert [m.month for m in trend] == [1, 2]
    assert trend[datetime(2024, 1, 1)]["marketing_spend"] == 0.0
    assert trend[datetime(2024, 1, 1)]["revenue_per_spend"] is None
    assert trend[datetime(2024, 2, 1)]["revenue_per_spend"] == 4.0
    full = rows(marketing.spend_and_revenue(shop.with_tables(ads_spend=spend)), "marketing_spend", "revenue")
    assert full == [(0.0, 100.0), (50.0, 200.0), (10.0, 0.0)]


def test_campaigns_with_and_without_spend(spark):
    ds = dataset(
        spark,
        campaigns=[{"campaign_id": 1, "campaign_name": "A", "budget": 100}, {"campaign_id": 2, "campaign_name": "B", "budget": 0}],
        ads_spend=[{"campaign_id": 1, "amount": 25}, {"campaign_id": 3, "amount": 40}],
    )
    driven = by(marketing.campaign_pacing(ds, ds["ads_spend"]), "campaign_id")
    assert driven[1]["budget_variance"] == 75.0 and driven[1]["spend_to_budget_pct"] == 25.0
    assert driven[3]["budget"] is None and set(driven) == {1, 3}
    every = by(marketing.campaign_pacing_all(ds), "campaign_name")
    assert every["B"]["actual_spend"] == 0.0 and every["B"]["spend_to_budget_pct"] is None


def test_email_rates_and_fallback_key(spark):
    mails = [{"campaign_id": 1, "emails_sent": 10, "emails_opened": 4, "emails_clicked": 1}, {"campaign_id": 1, "emails_sent": 10}]
    ds = dataset(spark, email_clicks=mails)
    got = marketing.email_performance(ds).collect()[0]
    assert (got.campaign_id, got.open_rate_pct, got.ctr_pct, got.ctor_pct) == (1, 20.0, 5.0, 25.0)


def test_web_sessions(spark):
    ds = dataset(
        spark,
        page_views=[
            {"view_id": 1, "session_id": "a"},
            {"view_id": 2, "session_id": "b"},
            {"view_id": 3, "session_id": "b", "customer_id": 5},
            {"view_id": 3, "session_id": "b", "customer_id": 5},
        ],
    )
    got = marketing.web_engagement(ds).collect()[0]
    assert tuple(got) == (1, 1, 1.5, 50.0)


def test_finance(spark, fact):
    ds = dataset(
        spark,
        finance_expenses=[{"exp_cat_id": 1, "amount": 40, "expense_date": "2024-01-09"}, {"exp_cat_id": 2, "amount": 60, "expense_date": "2024-06-01"}],
        expense_category=[{"exp_cat_id": 1, "category_name": "Rent"}],
        finance_payments=[
            {"payment_id": 1, "status": "Refunded", "amount": 5, "refunded_at": "2024-01-01", "refund_reason": "Late"},
            {"payment_id": 2, "status": "Paid", "amount": 6},
        ],
        refund_log=[{"refund_id": 1, "reason": "Late", "amount": 5}, {"refund_id": 1, "reason": "Late", "amount": 5}],
    )
    expenses = finance.expenses_in_scope(ds)
    assert rows(finance.expense_categories(ds, expenses), "category_name", "expense") == [("Rent", 40.0)]
    assert rows(finance.expense_totals(ds), "category_name", "total_expense") == [(None, 60.0), ("Rent", 40.0)]
    pnl = rows(finance.profit_and_loss(fact, finance.monthly_expenses(expenses)), "opex", "ebitda_proxy")
    assert pnl == [(40.0, 70.0), (0.0, 0.0)]
    assert rows(finance.refund_reasons(ds), "refund_reason", "refund_count") == [("Late", 1)]
    assert rows(finance.refund_log(ds), "refund_count", "refund_value") == [(1, 10.0)]
    assert rows(finance.refund_totals(ds), "refund_count", "refund_value") == [(2, 10.0)]
    assert set(by(finance.payment_status(ds), "status")) == {"Refunded", "Paid"}


def test_hr(spark, fact):
    ds = dataset(
        spark,
        store_employees=[
            {"employee_id": 1, "dept_id": 1, "role": "a", "salary": 10},
            {"employee_id": 2, "dept_id": 1, "role": "b", "salary": 30},
            {"employee_id": 3, "dept_id": 9, "role": "b", "salary": 50},
        ],
        department=[{"dept_id": 1, "dept_name": "Ops"}],
        pay_slips=[
            {"employee_id": 1, "gross_salary": 100, "net_salary": 80, "pf": 10, "professional_tax": 2, "income_tax": 8, "payment_date": "2024-01-31"},
            {"employee_id": 1, "gross_salary": 100, "net_salary": 80, "pf": 10, "payment_date": "2024-02-28"},
        ],
        attendance=[
            {"attendance_id": 1, "employee_id": 1, "check_in": "2024-01-01T08:00:00", "check_out": "2024-01-01T16:30:00"},
            {"attendance_id": 2, "employee_id": 1, "check_in": "2024-01-02T08:00:00"},
        ],
    )
    assert rows(hr.headcount(ds), "dept_name", "headcount", "avg_salary") == [("Ops", 2, 20.0)]
    assert rows(hr.role_salary(ds), "role", "headcount", "avg_salary") == [("b", 2, 40.0), ("a", 1, 10.0)]
    payroll = rows(hr.payroll_monthly(ds), "deductions", "deduction_rate_pct")
    assert sorted(payroll) == [(10.0, 10.0), (20.0, 20.0)]
    weighted = by(hr.payroll_by_department(ds), "dept_name")
    assert weighted["Ops"]["average_salary"] == pytest.approx((10 * 2 + 30) / 3)
    assert weighted["Ops"]["gross_payroll"] == 200.0 and weighted[None]["gross_payroll"] is None
    present = hr.attendance_summary(ds).collect()[0]
    assert (present.attendance_days, present.avg_worked_hours, present.missing_checkout_rate_pct) == (2, 8.5, 50.0)
    per_head = hr.revenue_per_employee(ds, sales.executive_kpis(fact)).collect()[0]
    assert per_head.revenue_per_employee == 350 / 3


def test_operations(spark, shop):
    ds = shop.with_tables(
        inventory=frame(
            spark, "inventory",
            {"product_id": 1, "store_id": 1, "quantity_on_hand": 2, "reorder_level": 5},
            {"product_id": 99, "store_id": 1, "quantity_on_hand": 9, "reorder_level": 5},
        ),
        work_orders=frame(
            spark, "work_orders",
            {"line_id": 1, "quantity_produced": 10, "rejected_quantity": 5},
            {"line_id": 1, "quantity_produced": 90, "rejected_quantity": 0},
            {"line_id": 1, "quantity_produced": 0, "rejected_quantity": 0},
        ),
        production_lines=frame(spark, "production_lines", {"line_id": 1, "line_name": "L"}),
        inbound_shipments=frame(
            spark, "inbound_shipments",
            {"shipment_id": 1, "supplier_id": 1, "warehouse_id": 1, "quantity": 5, "shipped_date": "2024-01-01", "arrival_date": "2024-01-02T12:00:00"},
        ),
        warehouses=frame(spark, "warehouses", {"warehouse_id": 1, "region": "North"}),
    )
    positions = by(operations.inventory_risk(ds), "product_id")
    assert positions[1]["below_reorder"] and float(positions[1]["inventory_value"]) == 40
    assert float(positions[99]["inventory_value"]) == 0
    mean = operations.production_quality(ds).collect()[0]
    assert (mean.rejection_rate_pct, mean.yield_pct) == (25.0, 75.0)
    ratio = operations.line_quality(ds).collect()[0]
    assert (ratio.rejection_rate_pct, ratio.yield_pct) == (5.0, 95.0)
    lead = operations.supplier_lead_time(ds, operations.inbound_in_scope(ds)).collect()[0]
    assert (lead.supplier_id, lead.avg_lead_days) == (1, 1.5)
    assert operations.warehouse_flow(operations.inbound_in_scope(ds, None, ["South"])).count() == 0


def test_api_health(spark):
    calls = [
        {"request_id": i, "endpoint": "/a", "status_code": code, "response_time_ms": latency}
        for i, (code, latency) in enumerate([(200, 1.0), (404, 2.0), (None, 3.0), (500, None)])
    ]
    calls.append({"request_id": 9, "endpoint": "/b", "status_code": 200})
    ds = dataset(spark, api_requests=calls)
    got = by(operations.api_health(ds), "endpoint")
    assert got["/a"]["error_rate_pct"] == 50.0 and got["/a"]["p95_latency_ms"] == 2.9
    assert got["/b"]["p95_latency_ms"] is None
    assert by(operations.api_health(ds, approximate=True), "endpoint")["/a"]["requests"] == 4


def test_fact_insights_rules(shop, fact, spark):
    told = [r.message for r in insights.fact_insights(fact).collect()]
    assert told[0] == insights.NEUTRAL and "'Light'" in told[1]
    thin = fact.withColumn("cost", F.col("net_amount") * 0.9)
    assert insights.fact_insights(thin).collect()[0].message == insights.LOW_MARGIN
    empty = sales_fact(dataset(spark, orders=[], order_items=[]))
    assert [r.message for r in insights.fact_insights(empty).collect()] == [insights.NO_FACT]


def test_insights_and_report_of_a_bare_dataset(shop, fact):
    told = insights.build_insights(shop, fact).collect()
    assert [(r.group, r.rule_id) for r in told] == [
        ("Executive", "executive_summary"), ("Sales & Customer", "top_product"),
        ("Sales & Customer", "at_risk"), ("Cross-Functional", "marketing_sales_profit"),
    ]
    assert told[0].message.startswith("Selected filters show revenue of ₹350, profit of ₹110, and a profit margin of 31.4%")
    assert told[1].message.startswith("Desk is the highest-revenue product")
    lines = [r.line for r in report.report_lines(sales.executive_kpis(fact), insights.build_insights(shop, fact), "T").collect()]
    assert lines[:8] == ["T", "=" * 65, "Revenue: ₹350", "Profit: ₹110", "Profit Margin: 31.43%", "Orders: 3", "", "Management Insights"]
    assert lines[8:11] == ["", "Executive", "- " + told[0].message]
    assert lines[-2:] == ["Cross-Functional", "- " + insights.SPEND_REVIEW]
