"""The library's logical tables as views over the driver's star-schema tables.

Each view is one projection of one driver table and keeps all of its rows (returned
lines and cancelled orders excepted, where that is what the table means); see
FIXTURES.md.  A table is opened when a query first asks for it.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

from tradescope.dataset import Dataset

MONEY = "decimal(18,4)"

_LINE_ID = "l_orderkey * 8 + l_linenumber"
_PRODUCT_ID = "CASE WHEN l_linenumber = 7 AND l_returnflag = 'N' THEN -1L ELSE l_partkey END"
_STATUS = (
    "CASE WHEN o_orderstatus = 'F' THEN 'Delivered' WHEN o_orderstatus = 'P' THEN 'Cancelled' "
    "WHEN o_orderkey % 3 = 0 THEN 'Shipped' WHEN o_orderkey % 3 = 1 THEN 'Out for Delivery' "
    "ELSE 'Processing' END"
)
# Whole seconds, so that both engines add exactly the same interval.
_LATER = (
    "CASE WHEN event_type <> 'error' THEN "
    "ts + make_dt_interval(0, 0, 0, CAST(round(value * 60, 0) AS decimal(18,6))) END"
)
_BRAND_ID = "CAST(replace(p_brand, 'Brand#', '') AS bigint)"


def _money(expr: str, name: str) -> str:
    """A double amount as a decimal, by way of whole ten-thousandths.

    Every amount here has at most four decimals, so this equals the plain cast, which is
    twice as slow because it prints and parses each double.
    """
    units = f"CAST(CAST(rint(({expr}) * 10000) AS bigint) AS decimal(18,0))"
    return f"CAST({units} * 0.0001BD AS {MONEY}) AS {name}"


_VIEWS: dict[str, tuple[str, list[str]]] = {
    "order_items": ("lineitem", [
        "l_orderkey AS order_id",
        f"{_PRODUCT_ID} AS prod_id",
        _money("l_quantity", "quantity"),
        _money("l_extendedprice", "gross_amount"),
        _money("l_extendedprice * l_discount", "discount_amount"),
        _money("l_extendedprice * (1 - l_discount)", "net_amount"),
    ]),
    "sales_returns": ("lineitem", [
        f"{_LINE_ID} AS return_id",
        "l_orderkey AS order_id",
        f"{_PRODUCT_ID} AS prod_id",
        "elt(l_linenumber % 4 + 1, 'Damaged', 'Wrong item', 'Late', 'Changed mind') AS reason",
        _money("l_extendedprice", "refund_amount"),
        "l_shipdate AS return_date",
    ]),
    "sales_shipments": ("lineitem", [
        f"{_LINE_ID} AS shipment_id",
        "concat('Courier-', l_suppkey % 7) AS courier_name",
        "CASE WHEN l_linestatus = 'F' THEN 'Delivered' ELSE 'In Transit' END AS status",
        "l_shipdate AS shipped_date",
        "CASE WHEN l_linestatus = 'F' THEN "
        "l_shipdate + make_dt_interval(0, CAST(l_quantity * 5 AS int)) END AS delivered_date",
    ]),
    "ads_spend": ("lineitem", [
        "l_suppkey AS campaign_id",
        "concat(l_returnflag, l_linestatus) AS platform",
        _money("l_extendedprice * l_tax", "amount"),
        "l_shipdate AS spend_date",
    ]),
    "finance_expenses": ("lineitem", [
        "CAST(l_linenumber AS bigint) AS exp_cat_id",
        _money("l_extendedprice * l_tax", "amount"),
        "l_shipdate AS expense_date",
    ]),
    "inbound_shipments": ("lineitem", [
        f"{_LINE_ID} AS shipment_id",
        "l_suppkey AS supplier_id",
        "l_suppkey % 25 AS warehouse_id",
        _money("l_quantity", "quantity"),
        "l_shipdate AS shipped_date",
        "l_shipdate + make_dt_interval(CAST(l_partkey % 40 AS int), l_linenumber) AS arrival_date",
    ]),
    "work_orders": ("lineitem", [
        "CAST(l_linenumber AS bigint) AS line_id",
        _money("l_quantity", "quantity_produced"),
        _money("l_quantity * l_discount", "rejected_quantity"),
        "l_shipdate AS start_timestamp",
    ]),
    "orders": ("orders", [
        "o_orderkey AS order_id",
        "o_custkey AS cust_id",
        "o_custkey % 27 AS store_id",
        "o_orderdate AS order_date",
        f"{_STATUS} AS order_status",
        _money("o_totalprice", "net_total"),
        _money("o_totalprice * 0.05D", "discount_amount"),
        "o_orderkey % 4 AS payment_mode_id",
    ]),
    "finance_payments": ("orders", [
        "o_orderkey AS payment_id",
        f"{_STATUS} AS status",
        _money("o_totalprice", "amount"),
        "CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS refunded_at",
        "o_orderpriority AS refund_reason",
    ]),
    "refund_log": ("orders", [
        "o_orderkey AS refund_id",
        "o_orderpriority AS reason",
        _money("o_totalprice", "amount"),
        "o_orderdate AS refunded_at",
    ]),
    "pay_slips": ("orders", [
        "o_custkey AS employee_id",
        _money("o_totalprice", "gross_salary"),
        _money("o_totalprice * 0.8D", "net_salary"),
        _money("o_totalprice * 0.1D", "pf"),
        _money("o_totalprice * 0.02D", "professional_tax"),
        _money("o_totalprice * 0.08D", "income_tax"),
        "o_orderdate AS payment_date",
    ]),
    "salary_history": ("orders", [
        "o_orderkey AS payment_id",
        "o_orderstatus AS status",
        _money("o_totalprice", "amount"),
        "o_orderdate AS payment_date",
    ]),
    "support_tickets": ("events", [
        "event_id AS ticket_id",
        "event_type AS category",
        "ts AS created_date",
        f"{_LATER} AS resolved_date",
    ]),
    "email_clicks": ("events", [
        "user_id % 120 AS campaign_id",
        "1L AS emails_sent",
        "CAST(event_type IN ('view', 'click', 'purchase') AS bigint) AS emails_opened",
        "CAST(event_type IN ('click', 'purchase') AS bigint) AS emails_clicked",
        "ts AS sent_date",
    ]),
    "page_views": ("events", [
        "event_id AS view_id",
        "concat(user_id, '-', CAST(ts AS date)) AS session_id",
        "CASE WHEN user_id % 3 <> 0 THEN user_id END AS customer_id",
        "ts AS view_timestamp",
    ]),
    "attendance": ("events", [
        "event_id AS attendance_id",
        "user_id AS employee_id",
        "ts AS attendance_date",
        "ts AS check_in",
        f"{_LATER} AS check_out",
    ]),
    "api_requests": ("events", [
        "event_id AS request_id",
        "concat('/ep', user_id % 10) AS endpoint",
        "CASE WHEN event_type = 'error' THEN 500L WHEN event_type <> 'signup' THEN 200L END "
        "AS status_code",
        "value AS response_time_ms",
        "ts AS timestamp",
    ]),
    "products": ("part", [
        "p_partkey AS product_id",
        "p_name AS product_name",
        f"{_BRAND_ID} AS brand_id",
        _money("p_retailprice * 0.5D", "cost_price"),
    ]),
    "brand": ("part", [
        f"{_BRAND_ID} AS brand_id",
        "p_brand AS brand_name",
        f"{_BRAND_ID} % 6 AS category_id",
    ]),
    "category": ("part", [
        f"{_BRAND_ID} % 6 AS category_id",
        f"CASE WHEN {_BRAND_ID} % 6 <> 5 THEN concat('Category-', {_BRAND_ID} % 6) END "
        "AS category_name",
    ]),
    "inventory": ("part", [
        "p_partkey AS product_id",
        "p_partkey % 25 AS store_id",
        _money("p_size", "quantity_on_hand"),
        _money("25", "reorder_level"),
    ]),
    "stores": ("nation", [
        "CAST(n_nationkey AS bigint) AS store_id",
        "n_name AS store_name",
        "CAST(n_regionkey AS bigint) AS region_id",
    ]),
    "warehouses": ("nation", [
        "CAST(n_nationkey AS bigint) AS warehouse_id",
        "n_name AS name",
        "concat('Zone-', n_regionkey) AS region",
    ]),
    "region": ("region", [
        "CAST(r_regionkey AS bigint) AS region_id",
        "r_name AS region_name",
        "concat('State of ', r_name) AS state",
    ]),
    "department": ("region", [
        "CAST(r_regionkey AS bigint) AS dept_id",
        "concat('Dept ', r_name) AS dept_name",
    ]),
    "loyalty_tiers": ("region", [
        "CAST(r_regionkey AS bigint) AS tier_id",
        "concat('Tier ', r_name) AS tier_name",
    ]),
    "customers": ("customer", ["c_custkey AS customer_id"]),
    "loyalty_members": ("customer", [
        "c_custkey AS customer_id",
        "CAST(c_nationkey % 6 AS bigint) AS tier_id",
        _money("c_acctbal", "points_balance"),
    ]),
    "store_employees": ("customer", [
        "c_custkey AS employee_id",
        "CAST(c_nationkey % 6 AS bigint) AS dept_id",
        "concat(c_mktsegment, '-', c_custkey % 3) AS role",
        _money("c_acctbal", "salary"),
        "c_custkey % 27 AS store_id",
    ]),
    "campaigns": ("supplier", [
        "s_suppkey AS campaign_id",
        "s_name AS campaign_name",
        _money("CASE WHEN s_acctbal > 0 THEN s_acctbal * 100 ELSE 0D END", "budget"),
    ]),
    "suppliers": ("supplier", ["s_suppkey AS supplier_id", "s_name AS supplier_name"]),
    "promotions": ("nation", [
        "timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(n_nationkey * 90) AS start_date",
        "timestamp_ntz'1995-01-11 00:00:00' + make_dt_interval(n_nationkey * 90) AS end_date",
    ]),
    "loyalty_redemptions": ("orders", ["o_orderdate AS redemption_date"]),
    "refund_failures": ("orders", ["o_orderdate AS failed_at"]),
    "procedure_calls": ("events", [
        "ts AS called_at",
        "CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_type <> 'signup' THEN 'OK' END AS status",
    ]),
    "reviews": ("labels", ["CAST(quality * 3 + toxic + 1 AS bigint) AS rating"]),
}

_ROWS = {"sales_returns": "l_returnflag = 'R'", "refund_log": "o_orderstatus = 'P'",
    "refund_failures": "o_orderstatus = 'P' AND o_orderkey % 5 = 0", "loyalty_redemptions": "o_orderkey % 20 = 0",
}
_DISTINCT = {"brand", "category"}
# Small code lists that the driver's tables only hold as numbers 1..n.
_CODES = {
    "expense_category": (6, "exp_cat_id", "category_name", "Expense-"),
    "production_lines": (7, "line_id", "line_name", "Line-"),
}


def dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    @cache
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

    def view(key: str) -> DataFrame:
        source, columns = _VIEWS[key]
        rows = read(source).where(_ROWS[key]) if key in _ROWS else read(source)
        rows = rows.selectExpr(*columns)
        return rows.distinct() if key in _DISTINCT else rows

    def codes(key: str) -> DataFrame:
        last, number, name, prefix = _CODES[key]
        return spark.range(1, last + 1).selectExpr(
            f"id AS {number}", f"concat('{prefix}', id) AS {name}"
        )

    views = {key: (lambda key=key: view(key)) for key in _VIEWS}
    lists = {key: (lambda key=key: codes(key)) for key in _CODES}
    return Dataset(spark, {**views, **lists})
