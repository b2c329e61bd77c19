"""The logical tables the library knows: where they live and which columns it reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)

_TYPES: dict[str, T.DataType] = {
    "long": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "money": MONEY,
    "ts": T.TimestampNTZType(),
}


@dataclass(frozen=True)
class TableSpec:
    key: str
    namespace: str
    name: str
    required: bool
    optional_large: bool
    schema: T.StructType
    # The column by whose ranges a database table is read in parallel.
    split: str | None = None

    @property
    def qualified_name(self) -> str:
        return f"{self.namespace}.{self.name}"

    @property
    def date_columns(self) -> list[str]:
        return [f.name for f in self.schema if isinstance(f.dataType, T.TimestampNTZType)]


def _spec(
    key: str, qualified: str, columns: str, required: bool = False, large: bool = False, split: str | None = None
) -> TableSpec:
    """A table with its columns ("name type, ..."); read in ranges of ``split``, else of its
    first id, else of its first date."""
    namespace, name = qualified.split(".")
    fields = [column.split() for column in columns.split(",") if column.strip()]
    by_kind = {kind: c for c, kind in reversed(fields)}
    schema = T.StructType([T.StructField(c, _TYPES[kind]) for c, kind in fields])
    return TableSpec(key, namespace, name, required, large, schema, split or by_kind.get("long") or by_kind.get("ts"))


# --- Fixed values: table keys, database namespaces/names and required flags ----------
_TABLES = [
    _spec("orders", "sales.orders", "order_id long, cust_id long, store_id long, order_date ts, order_status string, gross_total money, discount_amount money, net_total money, payment_mode_id long", required=True),
    _spec("order_items", "sales.order_items", "order_id long, prod_id long, quantity money, gross_amount money, discount_amount money, net_amount money", required=True),
    _spec("sales_payments", "sales.payments", "payment_date ts"),
    _spec("sales_returns", "sales.returns", "return_id long, order_id long, prod_id long, reason string, refund_amount money, return_date ts"),
    _spec("sales_shipments", "sales.shipments", "shipment_id long, courier_name string, status string, shipped_date ts, delivered_date ts"),
    _spec("products", "products.products", "product_id long, product_name string, brand_id long, cost_price money", required=True),
    _spec("inventory", "products.inventory", "product_id long, store_id long, quantity_on_hand money, reorder_level money"),
    _spec("suppliers", "products.suppliers", "supplier_id long, supplier_name string"),
    _spec("promotions", "products.promotions", "start_date ts, end_date ts"),
    _spec("brand", "core.dim_brand", "brand_id long, brand_name string, category_id long", required=True),
    _spec("category", "core.dim_category", "category_id long, category_name string", required=True),
    _spec("region", "core.dim_region", "region_id long, region_name string, state string"),
    _spec("department", "core.dim_department", "dept_id long, dept_name string"),
    _spec("expense_category", "core.dim_expense_category", "exp_cat_id long, category_name string"),
    _spec("stores", "stores.stores", "store_id long, store_name string, region_id long"),
    _spec("store_employees", "stores.employees", "employee_id long, dept_id long, role string, salary money, store_id long"),
    _spec("store_expenses", "stores.expenses", ""),
    _spec("customers", "customers.customers", "customer_id long, registration_date ts, tier_updated_at ts", required=True),
    _spec("reviews", "customers.reviews", "rating long, review_date ts", split="review_date"),
    _spec("loyalty_points", "customers.loyalty_points", "date_earned ts"),
    _spec("wallets", "customers.wallets", "last_updated ts"),
    _spec("loyalty_members", "loyalty.members", "customer_id long, tier_id long, points_balance money, join_date ts"),
    _spec("loyalty_tiers", "loyalty.tiers", "tier_id long, tier_name string"),
    _spec("loyalty_redemptions", "loyalty.redemptions", "redemption_date ts"),
    _spec("support_tickets", "support.tickets", "ticket_id long, category string, created_date ts, resolved_date ts"),
    _spec("calls", "call_center.calls", "call_start_time ts"),
    _spec("transcripts", "call_center.transcripts", ""),
    _spec("campaigns", "marketing.campaigns", "campaign_id long, campaign_name string, budget money, start_date ts, end_date ts"),
    _spec("ads_spend", "marketing.ads_spend", "campaign_id long, platform string, amount money, spend_date ts", split="spend_date"),
    _spec("email_clicks", "marketing.email_clicks", "campaign_id long, emails_sent long, emails_opened long, emails_clicked long, sent_date ts", split="sent_date"),
    _spec("finance_expenses", "finance.expenses", "exp_cat_id long, amount money, expense_date ts", split="expense_date"),
    _spec("finance_payments", "finance.payments", "payment_id long, status string, amount money, refunded_at ts, refund_reason string"),
    _spec("finance_payment_modes", "finance.payment_modes", ""),
    _spec("revenue_summary", "finance.revenue_summary", "summary_date ts"),
    _spec("refund_log", "audit.refund_log", "refund_id long, reason string, amount money, refunded_at ts"),
    _spec("refund_failures", "audit.refund_failures", "failed_at ts"),
    _spec("attendance", "hr.attendance", "attendance_id long, employee_id long, attendance_date ts, check_in ts, check_out ts"),
    _spec("salary_history", "hr.salary_history", "payment_id long, status string, amount money, payment_date ts"),
    _spec("pay_slips", "payroll.pay_slips", "employee_id long, gross_salary money, net_salary money, pf money, professional_tax money, income_tax money, payment_date ts"),
    _spec("warehouses", "supply_chain.warehouses", "warehouse_id long, name string, region string, capacity_sqft money"),
    _spec("inbound_shipments", "supply_chain.shipments", "shipment_id long, supplier_id long, warehouse_id long, quantity money, shipped_date ts, arrival_date ts"),
    _spec("inventory_snapshots", "supply_chain.inventory_snapshots", "snapshot_date ts"),
    _spec("work_orders", "manufacture.work_orders", "line_id long, quantity_produced money, rejected_quantity money, start_timestamp ts, end_timestamp ts", split="start_timestamp"),
    _spec("production_lines", "manufacture.production_lines", "line_id long, line_name string, capacity_per_hour money"),
    _spec("page_views", "web_events.page_views", "view_id long, session_id string, customer_id long, view_timestamp ts", large=True),
    _spec("web_events", "web_events.events", "event_timestamp ts", large=True),
    _spec("api_requests", "audit.api_requests", "request_id long, endpoint string, status_code long, response_time_ms double, timestamp ts"),
    _spec("application_logs", "audit.application_logs", "timestamp ts"),
    _spec("procedure_calls", "audit.procedure_calls", "called_at ts, status string"),
]

# The smaller table set used by the validation run: the first five are required there.
_VALIDATION_KEYS = """
orders order_items products brand category stores region customers sales_returns
sales_shipments ads_spend campaigns email_clicks finance_expenses finance_payments
attendance salary_history pay_slips inventory suppliers warehouses inventory_snapshots
inbound_shipments work_orders production_lines
""".split()
_VALIDATION_REQUIRED = frozenset({"orders", "order_items", "products", "brand", "category"})
# --- End of fixed values -------------------------------------------------------------

_SPECS = {spec.key: spec for spec in _TABLES}


def table_specs(profile: str = "dashboard") -> dict[str, TableSpec]:
    """All 49 tables (``dashboard``) or the 25 tables of the validation run (``validation``)."""
    if profile == "dashboard":
        return dict(_SPECS)
    if profile == "validation":
        return {
            key: TableSpec(
                key,
                _SPECS[key].namespace,
                _SPECS[key].name,
                key in _VALIDATION_REQUIRED,
                False,
                _SPECS[key].schema,
                _SPECS[key].split,
            )
            for key in _VALIDATION_KEYS
        }
    raise ValueError(f"unknown profile: {profile}")


def selected_specs(include_large: bool = False, profile: str = "dashboard") -> dict[str, TableSpec]:
    """The registry without the large optional tables, unless they are asked for."""
    return {
        key: spec
        for key, spec in table_specs(profile).items()
        if include_large or not spec.optional_large
    }
