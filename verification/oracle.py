"""The same results as independent ANSI SQL over the driver's tables.

The logical tables are restated here as common table expressions, and each query's SQL
is written from the meaning of the result, not from the Spark plan.
"""

from __future__ import annotations

from verification.catalog import BUNDLES, CATEGORIES, PLATFORMS, REGIONS, WAREHOUSE_ZONES, YEARS


def _money(expr: str) -> str:
    return f"CAST({expr} AS DECIMAL(18,4))"


_STATUS = """CASE o_orderstatus WHEN 'F' THEN 'Delivered' WHEN 'P' THEN 'Cancelled'
  ELSE CASE o_orderkey % 3 WHEN 0 THEN 'Shipped' WHEN 1 THEN 'Out for Delivery' ELSE 'Processing' END END"""
_PRODUCT = "CASE WHEN l_linenumber = 7 AND l_returnflag = 'N' THEN -1 ELSE l_partkey END"
_BRAND = "CAST(replace(p_brand, 'Brand#', '') AS BIGINT)"
_LATER = """CASE WHEN event_type <> 'error'
  THEN ts + to_seconds(CAST(round(value * 60) AS BIGINT)) END"""

_TABLES = {
    "items": f"""SELECT l_orderkey AS order_id, {_PRODUCT} AS prod_id, {_money("l_quantity")} AS quantity,
        {_money("l_extendedprice")} AS gross_amount, {_money("l_extendedprice * l_discount")} AS item_discount_amount,
        {_money("l_extendedprice * (1 - l_discount)")} AS net_amount FROM lineitem""",
    "returned": f"""SELECT l_orderkey * 8 + l_linenumber AS return_id, l_orderkey AS order_id, {_PRODUCT} AS prod_id,
        CASE l_linenumber % 4 WHEN 0 THEN 'Damaged' WHEN 1 THEN 'Wrong item' WHEN 2 THEN 'Late'
        ELSE 'Changed mind' END AS reason, {_money("l_extendedprice")} AS refund_amount
        FROM lineitem WHERE l_returnflag = 'R'""",
    "outbound": """SELECT l_orderkey * 8 + l_linenumber AS shipment_id, 'Courier-' || (l_suppkey % 7) AS courier_name,
        CASE l_linestatus WHEN 'F' THEN 'Delivered' ELSE 'In Transit' END AS status, l_shipdate AS shipped_date,
        CASE l_linestatus WHEN 'F' THEN l_shipdate + to_hours(CAST(l_quantity * 5 AS BIGINT)) END AS delivered_date
        FROM lineitem""",
    "ads": f"""SELECT l_suppkey AS campaign_id, l_returnflag || l_linestatus AS platform,
        {_money("l_extendedprice * l_tax")} AS amount, l_shipdate AS spend_date FROM lineitem""",
    "expenses": f"""SELECT CAST(l_linenumber AS BIGINT) AS exp_cat_id, {_money("l_extendedprice * l_tax")} AS amount,
        l_shipdate AS expense_date FROM lineitem""",
    "inbound": f"""SELECT l_orderkey * 8 + l_linenumber AS shipment_id, l_suppkey AS supplier_id,
        l_suppkey % 25 AS warehouse_id, {_money("l_quantity")} AS quantity, l_shipdate AS shipped_date,
        l_shipdate + to_days(CAST(l_partkey % 40 AS INTEGER)) + to_hours(l_linenumber) AS arrival_date FROM lineitem""",
    "work": f"""SELECT l_linenumber AS line_id, {_money("l_quantity")} AS produced,
        {_money("l_quantity * l_discount")} AS rejected FROM lineitem""",
    "placed": f"""SELECT o_orderkey AS order_id, o_custkey AS cust_id, o_custkey % 27 AS store_id,
        o_orderdate AS order_date, {_STATUS} AS order_status, {_money("o_totalprice")} AS net_total,
        {_money("o_totalprice * 0.05::DOUBLE")} AS order_discount_amount FROM orders""",
    "valid": """SELECT * FROM placed
        WHERE order_status IN ('Delivered', 'Shipped', 'Out for Delivery', 'Processing')""",
    "payments": f"""SELECT o_orderkey AS payment_id, {_STATUS} AS status, {_money("o_totalprice")} AS amount,
        CASE o_orderstatus WHEN 'P' THEN o_orderdate END AS refunded_at, o_orderpriority AS refund_reason FROM orders""",
    "refunds": f"""SELECT o_orderkey AS refund_id, o_orderpriority AS reason, {_money("o_totalprice")} AS amount,
        o_orderdate AS refunded_at FROM orders WHERE o_orderstatus = 'P'""",
    "slips": f"""SELECT o_custkey AS employee_id, {_money("o_totalprice")} AS gross_salary,
        {_money("o_totalprice * 0.8::DOUBLE")} AS net_salary, {_money("o_totalprice * 0.1::DOUBLE")} AS pf,
        {_money("o_totalprice * 0.02::DOUBLE")} AS professional_tax, {_money("o_totalprice * 0.08::DOUBLE")} AS income_tax,
        o_orderdate AS payment_date FROM orders""",
    "tickets": f"""SELECT event_id AS ticket_id, event_type AS category, ts AS created_date,
        {_LATER} AS resolved_date FROM events""",
    "emails": """SELECT user_id % 120 AS campaign_id, 1 AS sent,
        CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 1 ELSE 0 END AS opened,
        CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS clicked FROM events""",
    "views": """SELECT event_id AS view_id, user_id || '-' || CAST(ts AS DATE) AS session_id,
        CASE WHEN user_id % 3 <> 0 THEN user_id END AS customer_id, ts AS view_timestamp FROM events""",
    "attended": f"""SELECT event_id AS attendance_id, user_id AS employee_id, ts AS check_in,
        {_LATER} AS check_out FROM events""",
    "api": """SELECT event_id AS request_id, '/ep' || (user_id % 10) AS endpoint,
        CASE WHEN event_type = 'error' THEN 500 WHEN event_type <> 'signup' THEN 200 END AS status_code,
        value AS latency FROM events""",
    "products": f"""SELECT p_partkey AS product_id, p_name AS product_name, {_BRAND} AS brand_id,
        {_money("p_retailprice * 0.5::DOUBLE")} AS cost_price FROM part""",
    "brands": f"SELECT DISTINCT {_BRAND} AS brand_id, p_brand AS brand_name, {_BRAND} % 6 AS category_id FROM part",
    "categories": f"""SELECT DISTINCT {_BRAND} % 6 AS category_id,
        CASE WHEN {_BRAND} % 6 <> 5 THEN 'Category-' || ({_BRAND} % 6) END AS category_name FROM part""",
    "stock": f"""SELECT p_partkey AS product_id, p_partkey % 25 AS store_id, {_money("p_size")} AS quantity_on_hand,
        {_money("25")} AS reorder_level FROM part""",
    "stores": "SELECT CAST(n_nationkey AS BIGINT) AS store_id, n_name AS store_name, n_regionkey AS region_id FROM nation",
    "zones": "SELECT n_nationkey AS warehouse_id, 'Zone-' || n_regionkey AS region FROM nation",
    "regions": "SELECT r_regionkey AS region_id, r_name AS region_name, 'State of ' || r_name AS state FROM region",
    "depts": "SELECT r_regionkey AS dept_id, 'Dept ' || r_name AS dept_name FROM region",
    "members": f"""SELECT c_custkey AS customer_id, c_nationkey % 6 AS tier_id,
        {_money("c_acctbal")} AS points_balance FROM customer""",
    "staff": f"""SELECT c_custkey AS employee_id, c_nationkey % 6 AS dept_id,
        c_mktsegment || '-' || (c_custkey % 3) AS role, {_money("c_acctbal")} AS salary,
        c_custkey % 27 AS store_id FROM customer""",
    "campaigns": f"""SELECT s_suppkey AS campaign_id, s_name AS campaign_name,
        {_money("CASE WHEN s_acctbal > 0 THEN s_acctbal * 100 ELSE 0 END")} AS budget FROM supplier""",
    "exp_names": "SELECT range AS exp_cat_id, 'Expense-' || range AS category_name FROM range(1, 7)",
    "line_names": "SELECT range AS line_id, 'Line-' || range AS line_name FROM range(1, 8)",
    "catalogue": """SELECT p.*, b.brand_name, b.category_id, c.category_name FROM products p
        LEFT JOIN brands b ON b.brand_id = p.brand_id LEFT JOIN categories c ON c.category_id = b.category_id""",
    "fact": """SELECT i.*, v.cust_id, v.order_date, v.order_status, v.net_total, v.order_discount_amount,
        CAST(date_trunc('month', v.order_date) AS TIMESTAMP) AS month, p.product_name, p.brand_name, p.category_name,
        s.store_name, r.region_name, r.state, i.quantity * COALESCE(p.cost_price, 0) AS cost
        FROM items i JOIN valid v ON v.order_id = i.order_id LEFT JOIN catalogue p ON p.product_id = i.prod_id
        LEFT JOIN stores s ON s.store_id = v.store_id LEFT JOIN regions r ON r.region_id = s.region_id""",
    # Only items of known products, as the SQL reports see them.
    "sold": """SELECT i.*, v.cust_id, v.store_id, v.order_date, p.product_name, p.brand_id,
        i.quantity * p.cost_price AS cost
        FROM items i JOIN valid v ON v.order_id = i.order_id JOIN products p ON p.product_id = i.prod_id""",
}
_NEEDS = {
    "valid": ["placed"],
    "catalogue": ["products", "brands", "categories"],
    "fact": ["items", "valid", "catalogue", "stores", "regions"],
    "sold": ["items", "valid", "products"],
}


def _closure(names: list[str]) -> list[str]:
    ordered: list[str] = []
    for name in names:
        for needed in [*_closure(_NEEDS.get(name, [])), name]:
            if needed not in ordered:
                ordered.append(needed)
    return ordered


def _sql(uses: str, body: str, **parts: str) -> str:
    """The body behind the table expressions it uses and its own ``parts``.

    Logical tables get a prefix, since some share their name with a driver table.
    """
    names = _closure(uses.split())
    ctes = [f"t_{name} AS ({_prefixed(_TABLES[name], names)})" for name in names]
    ctes += [f"{name} AS ({_prefixed(text, names)})" for name, text in parts.items()]
    return f"WITH {', '.join(ctes)} {_prefixed(body, names)}" if ctes else body


def _prefixed(text: str, names: list[str]) -> str:
    for name in names:
        for keyword in ("FROM", "JOIN"):
            text = text.replace(f"{keyword} {name} ", f"{keyword} t_{name} ")
            text = text.replace(f"{keyword} {name}\n", f"{keyword} t_{name}\n")
            text = text.replace(f"{keyword} {name})", f"{keyword} t_{name})")
            if text.endswith(f"{keyword} {name}"):
                text = text[: -len(name)] + f"t_{name}"
    return text


def _double(expr: str) -> str:
    """An exact decimal total as a double (four decimals are enough for every total here)."""
    return f"CAST(CAST({expr} AS DECIMAL(38,4)) AS DOUBLE)"


def _sum(expr: str) -> str:
    return _double(f"COALESCE(SUM({expr}), 0)")


def _raw_sum(expr: str) -> str:
    return _double(f"SUM({expr})")


def _avg(expr: str) -> str:
    return f"({_raw_sum(expr)} / NULLIF(COUNT({expr}), 0))"


def _avg_rate(expr: str) -> str:
    fixed = f"CAST({expr} AS DECIMAL(28,10))"
    return f"(CAST(SUM({fixed}) AS DOUBLE) / NULLIF(COUNT({expr}), 0))"


def _div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def _pct(a: str, b: str) -> str:
    return f"({_div(a, b)} * 100.0::DOUBLE)"


def _pct2(a: str, b: str) -> str:
    return f"round(100.0::DOUBLE * {a} / NULLIF({b}, 0), 2)"


def _seconds(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) // 1000000)"


def _mean_time(a: str, b: str, unit: str) -> str:
    gap = _seconds(a, b)
    return f"(CAST(SUM({gap}) AS DOUBLE) / NULLIF(COUNT({gap}), 0) / {unit}::DOUBLE)"


def _days(a: str, b: str) -> str:
    return f"(CAST({b} AS DATE) - CAST({a} AS DATE))"


def _in(values) -> str:
    return "(" + ", ".join(repr(v) for v in values) + ")"


_MONTH = "CAST(date_trunc('month', {}) AS TIMESTAMP)"
_REVENUE, _PROFIT = _sum("net_amount"), _double("COALESCE(SUM(net_amount), 0) - COALESCE(SUM(cost), 0)")
_ORDERS = "COUNT(DISTINCT order_id)"
_YEAR_LIST = _in(YEARS)


def _monthly(source: str = "fact", where: str = "TRUE") -> str:
    return f"""SELECT month, {_REVENUE} AS revenue, {_PROFIT} AS profit, {_ORDERS} AS orders,
        {_pct(_PROFIT, _REVENUE)} AS margin_pct FROM {source} WHERE month IS NOT NULL AND {where} GROUP BY month"""


def _by_fact(key: str, extra: str, where: str = "TRUE") -> str:
    return f"""SELECT {key}, {_REVENUE} AS revenue, {_PROFIT} AS profit, {extra}
        FROM fact WHERE {key} IS NOT NULL AND {where} GROUP BY {key}"""


_MARGIN = f"{_pct(_PROFIT, _REVENUE)} AS margin_pct"
_PRODUCTS = _by_fact("product_name", f"{_sum('quantity')} AS units")
_CATEGORIES = _by_fact("category_name", _MARGIN)
_REGIONS = _by_fact("region_name", f"{_ORDERS} AS orders, {_MARGIN}")
_KPIS = f"""SELECT {_REVENUE} AS revenue, {_PROFIT} AS profit, {_pct(_PROFIT, _REVENUE)} AS margin_pct,
    {_ORDERS} AS orders, {_div(_REVENUE, _ORDERS)} AS aov FROM fact"""

_RETURNS = f"""SELECT reason, {_sum("refund_amount")} AS refund_value, COUNT(DISTINCT return_id) AS return_count
    FROM returned x LEFT JOIN (SELECT DISTINCT order_id, prod_id, category_name, product_name FROM fact) f
    ON f.order_id = x.order_id AND f.prod_id = x.prod_id WHERE reason IS NOT NULL GROUP BY reason"""

_RFM_PARTS = {
    "per_customer": """SELECT cust_id, MAX(order_date) AS last_order, COUNT(DISTINCT order_id) AS frequency,
        SUM(net_amount) AS spend FROM fact WHERE cust_id IS NOT NULL GROUP BY cust_id""",
    "dated": """SELECT *, CAST(floor((epoch_us((SELECT MAX(order_date) FROM fact)) - epoch_us(last_order)) / 86400000000)
        AS BIGINT) AS recency_days FROM per_customer""",
    "ranked": """SELECT *, CAST(COUNT(*) OVER () AS DOUBLE) AS n,
        ROW_NUMBER() OVER (ORDER BY recency_days, cust_id) AS r_pos,
        ROW_NUMBER() OVER (ORDER BY frequency, cust_id) AS f_pos,
        ROW_NUMBER() OVER (ORDER BY spend, cust_id) AS m_pos FROM dated""",
    "scored": """SELECT *, CAST(least(5, greatest(1, round_even((1.0::DOUBLE - r_pos / n) * 5.0::DOUBLE, 0))) AS INTEGER) AS r_score,
        CAST(least(5, greatest(1, round_even((f_pos / n) * 5.0::DOUBLE, 0))) AS INTEGER) AS f_score,
        CAST(least(5, greatest(1, round_even((m_pos / n) * 5.0::DOUBLE, 0))) AS INTEGER) AS m_score FROM ranked""",
    "rfm": f"""SELECT cust_id, last_order, frequency, {_double("spend")} AS monetary, recency_days,
        r_score, f_score, m_score, r_score + f_score + m_score AS rfm_total,
        CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions'
             WHEN r_score >= 3 AND f_score >= 3 THEN 'Loyal'
             WHEN r_score <= 2 AND m_score >= 4 THEN 'At-Risk Valuable'
             WHEN r_score <= 2 AND f_score <= 2 THEN 'Needs Attention' ELSE 'Others' END AS segment,
        {_double("spend")} * (1.0::DOUBLE + frequency / CAST(greatest((SELECT MAX(frequency) FROM scored), 1) AS DOUBLE))
        AS clv_proxy FROM scored""",
}

_PLATFORM = f"SELECT platform, {_sum('amount')} AS spend FROM ads WHERE platform IS NOT NULL GROUP BY platform"
_SPEND = f"""SELECT {_MONTH.format("spend_date")} AS month, {_sum("amount")} AS marketing_spend
    FROM ads WHERE spend_date IS NOT NULL GROUP BY 1"""
_SPEND_CHOSEN = f"""SELECT {_MONTH.format("spend_date")} AS month, {_sum("amount")} AS marketing_spend
    FROM ads WHERE year(spend_date) IN {_YEAR_LIST} AND platform IN {_in(PLATFORMS)} GROUP BY 1"""
_OPEX = f"""SELECT {_MONTH.format("expense_date")} AS month, {_sum("amount")} AS opex
    FROM expenses WHERE expense_date IS NOT NULL GROUP BY 1"""
_OPEX_YEARS = f"""SELECT {_MONTH.format("expense_date")} AS month, {_sum("amount")} AS opex
    FROM expenses WHERE year(expense_date) IN {_YEAR_LIST} GROUP BY 1"""
_EMAIL = f"""SELECT campaign_name, CAST(SUM(sent) AS BIGINT) AS sent, CAST(SUM(opened) AS BIGINT) AS opened,
    CAST(SUM(clicked) AS BIGINT) AS clicked, {_pct("SUM(opened)", "SUM(sent)")} AS open_rate_pct,
    {_pct("SUM(clicked)", "SUM(sent)")} AS ctr_pct, {_pct("SUM(clicked)", "SUM(opened)")} AS ctor_pct
    FROM emails e LEFT JOIN campaigns c ON c.campaign_id = e.campaign_id WHERE campaign_name IS NOT NULL
    GROUP BY campaign_name"""
_TREND = """SELECT m.*, COALESCE(s.marketing_spend, 0) AS marketing_spend,
    m.revenue / NULLIF(COALESCE(s.marketing_spend, 0), 0) AS revenue_per_spend
    FROM monthly m LEFT JOIN spend s ON s.month = m.month"""
_PNL = f"""SELECT m.*, COALESCE(o.opex, 0) AS opex, m.profit - COALESCE(o.opex, 0) AS ebitda_proxy,
    {_pct("COALESCE(o.opex, 0)", "m.revenue")} AS cost_to_revenue_pct
    FROM monthly m LEFT JOIN opex o ON o.month = m.month"""
_EXPENSE = f"""SELECT category_name, {_sum("amount")} AS expense FROM expenses e
    LEFT JOIN exp_names n ON n.exp_cat_id = e.exp_cat_id WHERE category_name IS NOT NULL GROUP BY category_name"""


def _refund_log(where: str) -> str:
    return f"""SELECT reason, COUNT(DISTINCT refund_id) AS refund_count, {_sum("amount")} AS refund_value
        FROM refunds WHERE reason IS NOT NULL AND {where} GROUP BY reason"""


_STAFF_DEPT = "staff e LEFT JOIN depts d ON d.dept_id = e.dept_id"
_HEADCOUNT = f"""SELECT dept_name, COUNT(DISTINCT employee_id) AS headcount, {_avg("salary")} AS avg_salary
    FROM {_STAFF_DEPT} WHERE dept_name IS NOT NULL GROUP BY dept_name"""


def _payroll(where: str) -> str:
    taken = _sum("pf + professional_tax + income_tax")
    return f"""SELECT {_MONTH.format("payment_date")} AS month, {_sum("gross_salary")} AS gross_payroll,
        {_sum("net_salary")} AS net_payroll, {taken} AS deductions,
        {_pct(taken, _sum("gross_salary"))} AS deduction_rate_pct
        FROM slips WHERE {where} GROUP BY 1"""


_STOCK = """SELECT s.product_id, s.store_id, s.quantity_on_hand, s.reorder_level, p.product_name, p.category_name,
    p.cost_price, s.quantity_on_hand < s.reorder_level AS below_reorder,
    s.quantity_on_hand * COALESCE(p.cost_price, 0) AS inventory_value
    FROM stock s LEFT JOIN catalogue p ON p.product_id = s.product_id"""
_STOCK_CATEGORY = f"""SELECT category_name, {_sum("quantity_on_hand")} AS inventory_units,
    {_sum("inventory_value")} AS inventory_value, COUNT(*) FILTER (WHERE below_reorder) AS below_reorder_skus
    FROM held WHERE category_name IS NOT NULL GROUP BY category_name"""


def _delivery(key: str, where: str = "TRUE") -> str:
    days = _mean_time("shipped_date", "delivered_date", "86400.0")
    return f"""SELECT {key}, COUNT(DISTINCT shipment_id) AS shipments, {days} AS avg_delivery_days
        FROM outbound WHERE {key} IS NOT NULL AND {where} GROUP BY {key}"""


_LEAD = _mean_time("shipped_date", "arrival_date", "86400.0")
_SUPPLIERS = f"""SELECT s_name AS supplier_name, {_sum("quantity")} AS inbound_units, {_LEAD} AS avg_lead_days,
    COUNT(DISTINCT shipment_id) AS shipments FROM inbound i LEFT JOIN supplier s ON s.s_suppkey = i.supplier_id
    WHERE s_name IS NOT NULL GROUP BY s_name"""


def _warehouses(where: str) -> str:
    return f"""SELECT region, {_sum("quantity")} AS inbound_units, {_LEAD} AS avg_lead_days
        FROM inbound i LEFT JOIN zones z ON z.warehouse_id = i.warehouse_id
        WHERE region IS NOT NULL AND {where} GROUP BY region"""


_PRODUCTION = f"""SELECT line_name, {_sum("produced")} AS produced, {_sum("rejected")} AS rejected,
    {_avg_rate(_pct("rejected", "produced"))} AS rejection_rate_pct,
    {_avg_rate(_pct("produced - rejected", "produced"))} AS yield_pct
    FROM work w LEFT JOIN line_names n ON n.line_id = w.line_id WHERE line_name IS NOT NULL GROUP BY line_name"""
_REGION_STAFF = f"""SELECT region_name, COUNT(DISTINCT employee_id) AS headcount, {_avg("salary")} AS avg_salary
    FROM staff e LEFT JOIN stores s ON s.store_id = e.store_id LEFT JOIN regions r ON r.region_id = s.region_id
    WHERE region_name IS NOT NULL GROUP BY region_name"""


def _first(source: str, name: str, order: str) -> str:
    return f"(SELECT {name} FROM {source} ORDER BY {order}, {name} LIMIT 1)"


_INSIGHT_PARTS = {
    **_RFM_PARTS,
    "kpis": _KPIS,
    "by_product": _PRODUCTS,
    "by_category": _CATEGORIES,
    "by_platform": _PLATFORM,
    "by_expense": _EXPENSE,
    "by_dept": _HEADCOUNT,
    "by_line": _PRODUCTION,
}
_INSIGHT_USES = "fact ads expenses exp_names staff depts work line_names"
_AT_RISK = "(SELECT COUNT(*) FROM rfm WHERE segment = 'At-Risk Valuable')"


def _whole(expr: str) -> str:
    return f"format('{{:,}}', CAST(round_even({expr}, 0) AS BIGINT))"


_INSIGHTS = f"""
SELECT 1 AS group_no, 'Executive' AS "group", 1 AS seq, 'executive_summary' AS rule_id,
  'Selected filters show revenue of ₹' || {_whole("revenue")} || ', profit of ₹' || {_whole("profit")}
  || ', and a profit margin of ' || printf('%.1f', margin_pct) || '%.' AS message FROM kpis
UNION ALL SELECT 2, 'Sales & Customer', 1, 'top_product', {_first("by_product", "product_name", "revenue DESC")}
  || ' is the highest-revenue product in the selected view and should be monitored for margin protection and availability.'
UNION ALL SELECT 2, 'Sales & Customer', 2, 'at_risk', format('{{:,}}', {_AT_RISK})
  || ' customers are classified as At-Risk Valuable based on RFM logic; targeted re-engagement can be prioritised.'
UNION ALL SELECT 3, 'Marketing', 1, 'top_platform', {_first("by_platform", "platform", "spend DESC")}
  || ' has the highest marketing spend in the selected period. Review it alongside revenue-per-spend before reallocating budget.'
UNION ALL SELECT 4, 'Finance', 1, 'top_expense', 'The largest expense category is '
  || {_first("by_expense", "category_name", "expense DESC")}
  || '; it should be reviewed when the cost-to-revenue ratio increases.'
UNION ALL SELECT 5, 'HR', 1, 'top_department', {_first("by_dept", "dept_name", "headcount DESC")}
  || ' has the highest headcount. Compare staffing level, average salary, and revenue contribution during workforce planning.'
UNION ALL SELECT 6, 'Operations & Logistics', 1, 'worst_line', {_first("by_line", "line_name", "rejection_rate_pct DESC")}
  || ' has the highest production rejection rate. Quality checks and root-cause review should be prioritised.'
UNION ALL SELECT 7, 'Cross-Functional', 1, 'marketing_sales_profit', 'Review marketing spend together with revenue and profit because higher spend does not automatically indicate efficient growth.'
UNION ALL SELECT 7, 'Cross-Functional', 2, 'category_margin_inventory', 'Review categories with high inventory working capital and lower margins to reduce capital blockage and margin pressure.'
"""


def _currency(v: str) -> str:
    return f"""CASE WHEN {v} IS NULL THEN 'N/A'
        WHEN abs({v}) >= 1e7 THEN '₹' || format('{{:,.2f}}', {v} / 1e7::DOUBLE) || ' Cr'
        WHEN abs({v}) >= 1e5 THEN '₹' || format('{{:,.2f}}', {v} / 1e5::DOUBLE) || ' L'
        WHEN abs({v}) >= 1e3 THEN '₹' || format('{{:,.1f}}', {v} / 1e3::DOUBLE) || ' K'
        ELSE '₹' || format('{{:,.0f}}', {v}) END"""


_GROUP_NAMES = ", ".join(
    f"({i}, '{g}')"
    for i, g in enumerate(
        ["Executive", "Sales & Customer", "Marketing", "Finance", "HR", "Operations & Logistics", "Cross-Functional"], 1
    )
)
_LINES = f"""
SELECT 1 AS seq, 'Management Report' AS line
UNION ALL SELECT 2, repeat('=', 65)
UNION ALL SELECT 3, 'Revenue: ' || {_currency("revenue")} FROM kpis
UNION ALL SELECT 4, 'Profit: ' || {_currency("profit")} FROM kpis
UNION ALL SELECT 5, 'Profit Margin: ' || printf('%.2f%%', margin_pct) FROM kpis
UNION ALL SELECT 6, 'Orders: ' || format('{{:,}}', orders) FROM kpis
UNION ALL SELECT 7, ''
UNION ALL SELECT 8, 'Management Insights'
UNION ALL SELECT no * 100, '' FROM (VALUES {_GROUP_NAMES}) g(no, name)
UNION ALL SELECT no * 100 + 1, name FROM (VALUES {_GROUP_NAMES}) g(no, name)
UNION ALL SELECT group_no * 100 + 1 + seq, '- ' || message FROM told
"""


def _escaped(v: str) -> str:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        v = f"replace({v}, '{mark}', '{entity}')"
    return v


def _profile(key: str, table: str, columns: list[str]) -> str:
    nulls = " + ".join(f"COUNT(*) - COUNT({c})" for c in columns)
    distinct = f"(SELECT COUNT(*) FROM (SELECT DISTINCT {', '.join(columns)} FROM {table} ) q)"
    return f"""SELECT '{key}' AS table_key, COUNT(*) AS rows, {len(columns)}::BIGINT AS columns,
        round_even(CAST({nulls} AS DOUBLE) / greatest(COUNT(*) * {len(columns)}, 1) * 100.0::DOUBLE, 2)
        AS missing_cell_rate_pct, COUNT(*) - {distinct} AS duplicate_rows_after_cleaning FROM {table} """


def _required(key: str, name: str, table: str) -> str:
    return f"""SELECT '{key}' AS table_key, '{name}' AS database_table,
        CASE WHEN COUNT(*) > 0 THEN 'Available' ELSE 'Missing or empty' END AS status, COUNT(*) AS row_count FROM {table} """


def _options(label: str, expr: str, source: str) -> str:
    return f"""SELECT DISTINCT '{label}' AS filter, CAST({expr} AS VARCHAR) AS value
        FROM {source} WHERE {expr} IS NOT NULL"""


# Every logical table: key, table expression and columns.
_PROFILED = [
    ("orders", "orders_all", "order_id cust_id store_id order_date order_status net_total discount payment_mode_id"),
    ("order_items", "items", "order_id prod_id quantity gross_amount item_discount_amount net_amount"),
    ("sales_returns", "returned_dated", "return_id order_id prod_id reason refund_amount return_date"),
    ("sales_shipments", "outbound", "shipment_id courier_name status shipped_date delivered_date"),
    ("ads_spend", "ads", "campaign_id platform amount spend_date"),
    ("finance_expenses", "expenses", "exp_cat_id amount expense_date"),
    ("inbound_shipments", "inbound", "shipment_id supplier_id warehouse_id quantity shipped_date arrival_date"),
    ("work_orders", "work_dated", "line_id produced rejected start_timestamp"),
    ("finance_payments", "payments", "payment_id status amount refunded_at refund_reason"),
    ("refund_log", "refunds", "refund_id reason amount refunded_at"),
    ("pay_slips", "slips", "employee_id gross_salary net_salary pf professional_tax income_tax payment_date"),
    ("salary_history", "salaries", "payment_id status amount payment_date"),
    ("support_tickets", "tickets", "ticket_id category created_date resolved_date"),
    ("email_clicks", "emails_dated", "campaign_id sent opened clicked sent_date"),
    ("page_views", "views", "view_id session_id customer_id view_timestamp"),
    ("attendance", "attended_dated", "attendance_id employee_id attendance_date check_in check_out"),
    ("api_requests", "api_dated", "request_id endpoint status_code latency called"),
    ("products", "products", "product_id product_name brand_id cost_price"),
    ("brand", "brands", "brand_id brand_name category_id"),
    ("category", "categories", "category_id category_name"),
    ("inventory", "stock", "product_id store_id quantity_on_hand reorder_level"),
    ("stores", "stores", "store_id store_name region_id"),
    ("warehouses", "zones_named", "warehouse_id name region"),
    ("region", "regions", "region_id region_name state"),
    ("department", "depts", "dept_id dept_name"),
    ("loyalty_tiers", "tiers", "tier_id tier_name"),
    ("customers", "customer_ids", "customer_id"),
    ("loyalty_members", "members", "customer_id tier_id points_balance"),
    ("store_employees", "staff", "employee_id dept_id role salary store_id"),
    ("campaigns", "campaigns", "campaign_id campaign_name budget"),
    ("suppliers", "supplier_names", "supplier_id supplier_name"),
    ("promotions", "promos", "start_date end_date"),
    ("loyalty_redemptions", "redeemed", "redemption_date"),
    ("refund_failures", "failures", "failed_at"),
    ("procedure_calls", "procedures", "called_at status"),
    ("reviews", "ratings", "rating"),
    ("expense_category", "exp_names", "exp_cat_id category_name"),
    ("production_lines", "line_names", "line_id line_name"),
]

_FIRST = "SELECT cust_id, MIN(order_date) AS first_date FROM valid WHERE cust_id IS NOT NULL GROUP BY cust_id"
_SPEND_CAMPAIGNS = f"""SELECT {_MONTH.format("spend_date")} AS month, {_sum("amount")} AS marketing_spend,
    COUNT(DISTINCT campaign_id) AS active_campaigns FROM ads WHERE spend_date IS NOT NULL GROUP BY 1"""
_SOLD_MONTHS = f"SELECT month, {_REVENUE} AS revenue FROM fact WHERE month IS NOT NULL GROUP BY month"


def _indicators() -> dict[str, str]:
    """The documented indicators."""
    return {
        "units_per_order": _sql("fact", f"""SELECT {_sum("quantity")} AS units, {_ORDERS} AS orders,
            {_div(_sum("quantity"), _ORDERS)} AS units_per_order FROM fact"""),
        "new_and_returning_revenue": _sql("fact valid", f"""SELECT month,
            {_sum("CASE WHEN f.cust_id IS NOT NULL AND f.order_date = w.first_date THEN net_amount END")} AS new_revenue,
            {_sum("CASE WHEN f.cust_id IS NOT NULL AND f.order_date <> w.first_date THEN net_amount END")} AS returning_revenue,
            {_sum("CASE WHEN f.cust_id IS NULL THEN net_amount END")} AS unknown_revenue
            FROM fact f LEFT JOIN won w ON w.cust_id = f.cust_id WHERE month IS NOT NULL GROUP BY month""", won=_FIRST),
        "return_rate": _sql("valid returned", f"""SELECT COUNT(DISTINCT v.order_id) AS orders, COUNT(DISTINCT r.order_id) AS returned_orders,
            {_pct("COUNT(DISTINCT r.order_id)", "COUNT(DISTINCT v.order_id)")} AS return_rate_pct
            FROM valid v LEFT JOIN returned r ON r.order_id = v.order_id"""),
        "refund_rate": _sql("payments", f"""SELECT COUNT(*) AS payments, COUNT(refunded_at) AS refunds, {_sum("amount")} AS amount,
            {_sum("CASE WHEN refunded_at IS NOT NULL THEN amount END")} AS refunded_amount,
            {_pct("COUNT(refunded_at)", "COUNT(*)")} AS refund_rate_pct,
            {_pct(_sum("CASE WHEN refunded_at IS NOT NULL THEN amount END"), _sum("amount"))} AS refunded_amount_pct FROM payments"""),
        "failed_refunds": _sql("failures", f"""SELECT {_MONTH.format("failed_at")} AS month, COUNT(*) AS failed_refunds
            FROM failures GROUP BY 1"""),
        "payroll_to_revenue": _sql("fact slips", f"""SELECT COALESCE(m.month, p.month) AS month, revenue, gross_payroll,
            {_pct("gross_payroll", "revenue")} AS payroll_to_revenue_pct
            FROM sold_months m FULL JOIN paid p ON p.month = m.month""",
            sold_months=_SOLD_MONTHS, paid=_payroll("payment_date IS NOT NULL")),
        "sales_velocity": _sql("fact stock catalogue", f"""SELECT v.*, units / days AS units_per_day, inventory_value
            FROM velocity v LEFT JOIN by_category c ON c.category_name = v.category_name""",
            held=_STOCK, by_category=_STOCK_CATEGORY, velocity=f"""SELECT category_name, {_sum("quantity")} AS units,
            CAST(MAX(order_date) AS DATE) - CAST(MIN(order_date) AS DATE) + 1 AS days
            FROM fact WHERE category_name IS NOT NULL GROUP BY category_name"""),
        "web_conversion": _sql("views valid", f"""SELECT COUNT(*) AS visitors, COUNT(w.cust_id) AS buyers,
            {_pct("COUNT(w.cust_id)", "COUNT(*)")} AS conversion_pct
            FROM (SELECT DISTINCT customer_id FROM views WHERE customer_id IS NOT NULL) v
            LEFT JOIN won w ON w.cust_id = v.customer_id""", won=_FIRST),
        "blended_acquisition_cost": _sql("ads valid", f"""SELECT COALESCE(s.month, w.month) AS month, COALESCE(marketing_spend, 0.0::DOUBLE) AS marketing_spend,
            COALESCE(n, 0) AS new_customers,
            {_div("COALESCE(marketing_spend, 0.0::DOUBLE)", "n")} AS cost_per_new_customer FROM spent s FULL JOIN (
            SELECT {_MONTH.format("first_date")} AS month, COUNT(*) AS n FROM won WHERE first_date IS NOT NULL GROUP BY 1) w
            ON w.month = s.month""", spent=_SPEND_CAMPAIGNS, won=_FIRST),
        "campaign_period_trend": _sql("ads fact", """SELECT s.*, revenue FROM spent s LEFT JOIN sold_months m ON m.month = s.month""",
            spent=_SPEND_CAMPAIGNS, sold_months=_SOLD_MONTHS),
        "promotion_uplift": _sql("fact promos", f"""SELECT *, {_pct("promoted_daily_revenue - other_daily_revenue", "other_daily_revenue")}
            AS uplift_pct FROM (SELECT {_avg("CASE WHEN p THEN revenue END")} AS promoted_daily_revenue,
            {_avg("CASE WHEN NOT p THEN revenue END")} AS other_daily_revenue FROM (SELECT SUM(net_amount) AS revenue,
            EXISTS (SELECT 1 FROM promos o WHERE day BETWEEN CAST(o.start_date AS DATE) AND CAST(o.end_date AS DATE)) AS p
            FROM (SELECT *, CAST(order_date AS DATE) AS day FROM fact) d WHERE day IS NOT NULL GROUP BY day) q) r"""),
        "loyalty_redemption_rate": _sql("members redeemed", f"""SELECT COUNT(DISTINCT customer_id) AS members,
            (SELECT COUNT(*) FROM redeemed) AS redemptions,
            {_pct("(SELECT COUNT(*) FROM redeemed)", "COUNT(DISTINCT customer_id)")} AS redemptions_per_100_members FROM members"""),
        "procedure_failures": _sql("procedures", f"""SELECT COUNT(*) AS calls, COUNT(*) FILTER (WHERE status = 'FAILED') AS failures,
            {_pct("COUNT(*) FILTER (WHERE status = 'FAILED')", "COUNT(*)")} AS failure_rate_pct FROM procedures"""),
        "monthly_expenses_all": _sql("expenses", _OPEX),
        "payroll_monthly_all": _sql("slips", _payroll("payment_date IS NOT NULL")),
        "refund_log_all": _sql("refunds", _refund_log("TRUE")),
        "salary_payment_status_all": f"""SELECT o_orderstatus AS status, COUNT(DISTINCT o_orderkey) AS payment_count,
            {_sum(_money("o_totalprice"))} AS amount FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1""",
        "outbound_status_all": _sql("outbound", _delivery("status")),
    }


def _bundle(sql: dict[str, str], results: dict[str, tuple[str, str, str]]) -> str:
    """The rows of several queries as (result, key, measure, value)."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS result, CAST({key} AS VARCHAR) AS key, '{measure}' AS measure, "
        f"CAST({measure} AS DOUBLE) AS value FROM ({sql[query]}) q"
        for name, (query, key, measures) in results.items()
        for measure in measures.split()
    )


def oracle_sql() -> dict[str, str]:
    monthly = {"monthly": _monthly()}
    sql = {
        # Fact, dimension and filters
        "product_dimension": _sql("catalogue", """SELECT product_id, product_name, brand_id,
            CAST(cost_price AS DOUBLE) AS cost_price, brand_name, category_id, category_name FROM catalogue"""),
        "sales_fact": _sql("fact", f"""SELECT order_id, prod_id, cust_id, order_date, order_status,
            CAST(net_total AS DOUBLE) AS net_total, CAST(order_discount_amount AS DOUBLE) AS order_discount_amount,
            CAST(item_discount_amount AS DOUBLE) AS item_discount_amount, CAST(gross_amount AS DOUBLE) AS gross_amount,
            CAST(quantity AS DOUBLE) AS quantity, CAST(net_amount AS DOUBLE) AS net_amount, product_name, brand_name,
            category_name, store_name, region_name, state, {_double("cost")} AS cost,
            {_double("net_amount - cost")} AS profit,
            {_pct(_double("net_amount - cost"), "net_amount")} AS profit_margin_pct, month FROM fact"""),
        "categorised_products": _sql("products brands categories", """SELECT c.category_id, p.product_id,
            p.product_name, CAST(p.cost_price AS DOUBLE) AS cost_price, c.category_name FROM products p
            JOIN brands b ON b.brand_id = p.brand_id JOIN categories c ON c.category_id = b.category_id"""),
        "sales_filtered": _sql("fact", _monthly(where=f"""year(order_date) IN {_YEAR_LIST}
            AND region_name IN {_in(REGIONS)} AND category_name IN {_in(CATEGORIES)}""")),
        "sales_filtered_store_product": _sql("fact", _by_fact("region_name", f"{_ORDERS} AS orders, {_MARGIN}",
            """state IN ('State of ASIA') AND store_name IN ('NATION_2', 'NATION_7', 'NATION_12')
            AND product_name IN ('small ring', 'red widget', 'blue bolt')""")),
        "filter_options": _sql("fact ads outbound zones", " UNION ALL ".join([
            _options("years", "year(order_date)", "fact"), _options("categories", "category_name", "fact"),
            _options("products", "product_name", "fact"), _options("regions", "region_name", "fact"),
            _options("states", "state", "fact"), _options("stores", "store_name", "fact"),
            _options("platforms", "platform", "ads"), _options("shipment_statuses", "status", "outbound"),
            _options("warehouse_regions", "region", "zones")])),
        "valid_orders_by_status": _sql("valid", """SELECT order_status, COUNT(*) AS orders FROM valid
            GROUP BY order_status"""),
        # Sales and customers
        "executive_kpis": _sql("fact", _KPIS),
        "monthly_sales": _sql("fact", _monthly()),
        "monthly_sales_with_cost": _sql("sold", f"""SELECT CAST(date_trunc('month', order_date) AS DATE) AS month,
            {_raw_sum("net_amount")} AS revenue, {_raw_sum("cost")} AS estimated_cost,
            {_raw_sum("net_amount - cost")} AS profit,
            {_pct2(_raw_sum("net_amount - cost"), _raw_sum("net_amount"))} AS profit_margin_pct FROM sold GROUP BY 1"""),
        "product_contribution": _sql("fact", _PRODUCTS),
        "top_products": _sql("sold", f"""SELECT product_name, {_raw_sum("net_amount")} AS revenue,
            {_raw_sum("net_amount - cost")} AS profit,
            {_pct2(_raw_sum("net_amount - cost"), _raw_sum("net_amount"))} AS margin_pct
            FROM sold GROUP BY product_name ORDER BY revenue DESC, product_name LIMIT 20"""),
        "category_contribution": _sql("fact", _CATEGORIES),
        "regional_contribution": _sql("fact", _REGIONS),
        "region_state_sales": _sql("sold stores regions", f"""SELECT region_name, state, {_ORDERS} AS orders,
            {_raw_sum("net_amount")} AS revenue, {_raw_sum("net_amount - cost")} AS profit FROM sold x
            JOIN stores s ON s.store_id = x.store_id JOIN regions r ON r.region_id = s.region_id GROUP BY 1, 2"""),
        "return_reasons": _sql("fact returned", _RETURNS),
        "review_distribution": """SELECT CAST(quality * 3 + toxic + 1 AS BIGINT) AS rating, COUNT(*) AS review_count
            FROM labels GROUP BY 1""",
        "loyalty_by_tier": _sql("members", f"""SELECT 'Tier ' || r_name AS tier, COUNT(DISTINCT customer_id) AS members,
            {_sum("points_balance")} AS points_balance FROM members m JOIN region r ON r.r_regionkey = m.tier_id GROUP BY 1"""),
        "ticket_resolution": _sql("tickets", f"""SELECT category, COUNT(DISTINCT ticket_id) AS ticket_count,
            {_mean_time("created_date", "resolved_date", "3600.0")} AS avg_resolution_hours
            FROM tickets WHERE category IS NOT NULL GROUP BY category"""),
        "rfm_segments": _sql("fact", "SELECT * FROM rfm", **_RFM_PARTS),
        "rfm_segments_by_monetary": _sql("fact", "SELECT * FROM rfm ORDER BY monetary DESC", **_RFM_PARTS),
        "segment_counts": _sql("fact", "SELECT segment, COUNT(DISTINCT cust_id) AS customers FROM rfm GROUP BY segment",
            **_RFM_PARTS),
        "segment_summary": _sql("fact", """SELECT segment, COUNT(DISTINCT cust_id) AS customers,
            CAST(SUM(CAST(CAST(monetary AS VARCHAR) AS DECIMAL(38,6))) AS DOUBLE) AS monetary,
            CAST(SUM(CAST(CAST(clv_proxy AS VARCHAR) AS DECIMAL(38,6))) AS DOUBLE) AS clv_proxy FROM rfm GROUP BY segment""", **_RFM_PARTS),
        "at_risk_customers": _sql("fact", f"SELECT {_AT_RISK} AS at_risk_customers", **_RFM_PARTS),
        "repeat_purchase_rate": _sql("fact", f"""SELECT {_pct("COUNT(*) FILTER (WHERE frequency > 1)", "COUNT(*)")}
            AS repeat_purchase_rate_pct FROM per_customer""", per_customer=_RFM_PARTS["per_customer"]),
        "rfm_base": _sql("items valid", f"""SELECT cust_id, CAST(MAX(last_day) OVER () - last_day AS BIGINT) AS recency_days,
            frequency, monetary FROM (SELECT v.cust_id, CAST(MAX(v.order_date) AS DATE) AS last_day,
            COUNT(DISTINCT v.order_id) AS frequency, {_raw_sum("i.net_amount")} AS monetary FROM items i
            JOIN valid v ON v.order_id = i.order_id GROUP BY v.cust_id) q"""),
        "order_position_in_priority": _sql("payments", """SELECT refund_reason, CAST(amount AS DOUBLE) AS amount, payment_id,
            ROW_NUMBER() OVER (PARTITION BY refund_reason ORDER BY amount, payment_id) AS position FROM payments"""),
        "top_12_products": _sql("fact", f"SELECT * FROM ({_PRODUCTS}) q ORDER BY revenue DESC, product_name LIMIT 12"),
        "top_10_return_reasons": _sql("fact returned",
            f"SELECT * FROM ({_RETURNS}) q ORDER BY refund_value DESC, reason LIMIT 10"),
        "latest_12_months": _sql("fact", f"SELECT * FROM ({_monthly()}) q ORDER BY month DESC LIMIT 12"),
        # Marketing
        "platform_spend": _sql("ads", _PLATFORM),
        "platform_spend_filtered": _sql("ads", f"""SELECT platform, {_sum("amount")} AS spend FROM ads
            WHERE year(spend_date) IN {_YEAR_LIST} AND platform IN {_in(PLATFORMS)} GROUP BY platform"""),
        "monthly_spend": _sql("ads", _SPEND),
        "campaign_pacing": _sql("ads campaigns", f"""SELECT a.campaign_id, actual_spend, campaign_name,
            CAST(budget AS DOUBLE) AS budget, {_double("budget - spent")} AS budget_variance,
            {_pct("actual_spend", "budget")} AS spend_to_budget_pct FROM (SELECT campaign_id, SUM(amount) AS spent,
            {_sum("amount")} AS actual_spend FROM ads GROUP BY campaign_id) a
            LEFT JOIN campaigns c ON c.campaign_id = a.campaign_id"""),
        "campaign_pacing_all": _sql("ads campaigns", f"""SELECT campaign_name, CAST(budget AS DOUBLE) AS budget,
            {_sum("amount")} AS actual_spend, {_pct2(_sum("amount"), "CAST(budget AS DOUBLE)")} AS spend_to_budget_pct
            FROM campaigns c LEFT JOIN ads a ON a.campaign_id = c.campaign_id GROUP BY campaign_name, budget"""),
        "email_performance": _sql("emails campaigns", _EMAIL),
        "email_rates": _sql("emails campaigns", f"""SELECT campaign_name, CAST(SUM(sent) AS BIGINT) AS emails_sent,
            CAST(SUM(opened) AS BIGINT) AS emails_opened, CAST(SUM(clicked) AS BIGINT) AS emails_clicked,
            {_pct2("SUM(opened)", "SUM(sent)")} AS open_rate_pct, {_pct2("SUM(clicked)", "SUM(sent)")} AS ctr_pct,
            {_pct2("SUM(clicked)", "SUM(opened)")} AS ctor_pct FROM emails e
            JOIN campaigns c ON c.campaign_id = e.campaign_id GROUP BY campaign_name"""),
        "first_15_emails": _sql("emails campaigns", f"{_EMAIL} ORDER BY campaign_name LIMIT 15"),
        "spend_sales_trend": _sql("fact ads", _TREND, **monthly, spend=_SPEND),
        "web_engagement": _sql("views", f"""SELECT COUNT(*) FILTER (WHERE who IS NOT NULL) AS identified_sessions,
            COUNT(*) FILTER (WHERE who IS NULL) AS anonymous_sessions, {_div("SUM(pages)", "COUNT(pages)")} AS avg_pages_per_session,
            {_pct("COUNT(*) FILTER (WHERE pages = 1)", "COUNT(*)")} AS single_page_share_pct FROM (SELECT session_id,
            COUNT(DISTINCT view_id) AS pages, MAX(customer_id) AS who FROM views GROUP BY session_id) q"""),
        "marketing_cards": _sql("fact ads emails campaigns", f"""SELECT (SELECT {_double("SUM(CAST(spend AS DECIMAL(38,4)))")}
            FROM platforms) AS marketing_spend, {_avg_rate("open_rate_pct")} AS avg_open_rate_pct,
            {_avg_rate("ctr_pct")} AS avg_ctr_pct, (SELECT {_avg_rate("revenue_per_spend")} FROM trend)
            AS avg_revenue_per_spend FROM mail""", **monthly, spend=_SPEND, platforms=_PLATFORM, mail=_EMAIL, trend=_TREND),
        "spend_and_revenue": _sql("sold ads", """SELECT COALESCE(r.month, s.month) AS month,
            COALESCE(s.marketing_spend, 0) AS marketing_spend, COALESCE(r.revenue, 0) AS revenue,
            COALESCE(r.profit, 0) AS profit FROM r FULL JOIN s ON s.month = r.month""",
            r=f"""SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, {_raw_sum("net_amount")} AS revenue,
            {_raw_sum("net_amount - cost")} AS profit FROM sold GROUP BY 1""",
            s=f"""SELECT CAST(date_trunc('month', spend_date) AS DATE) AS month, {_raw_sum("amount")} AS marketing_spend
            FROM ads GROUP BY 1"""),
        # Finance
        "expense_categories": _sql("expenses exp_names", _EXPENSE),
        "top_12_expense_categories": _sql("expenses exp_names", f"{_EXPENSE} ORDER BY expense DESC, category_name LIMIT 12"),
        "expense_totals": _sql("expenses exp_names", f"""SELECT category_name, {_raw_sum("amount")} AS total_expense
            FROM expenses e LEFT JOIN exp_names n ON n.exp_cat_id = e.exp_cat_id GROUP BY category_name"""),
        "monthly_expenses": _sql("expenses", _OPEX_YEARS),
        "profit_and_loss": _sql("fact expenses", _PNL, **monthly, opex=_OPEX),
        "payment_status": _sql("payments", f"""SELECT status, COUNT(DISTINCT payment_id) AS payment_count,
            {_sum("amount")} AS amount FROM payments WHERE status IS NOT NULL GROUP BY status"""),
        "refund_reasons": _sql("payments", f"""SELECT refund_reason, COUNT(DISTINCT payment_id) AS refund_count,
            {_sum("amount")} AS refund_value FROM payments WHERE refunded_at IS NOT NULL AND refund_reason IS NOT NULL
            GROUP BY refund_reason"""),
        "refund_log": _sql("refunds", _refund_log(f"year(refunded_at) IN {_YEAR_LIST}")),
        "refund_totals": _sql("refunds", f"""SELECT reason, COUNT(*) AS refund_count, {_raw_sum("amount")} AS refund_value
            FROM refunds GROUP BY reason"""),
        "finance_cards": _sql("fact expenses refunds", f"""SELECT
            (SELECT {_double("SUM(CAST(opex AS DECIMAL(38,4)))")} FROM opex) AS opex,
            (SELECT {_double("SUM(CAST(ebitda_proxy AS DECIMAL(38,4)))")} FROM pnl) AS ebitda_proxy,
            {_pct("(SELECT " + _double("SUM(CAST(opex AS DECIMAL(38,4)))") + " FROM opex)", "revenue")} AS cost_to_revenue_pct,
            (SELECT {_double("SUM(CAST(refund_value AS DECIMAL(38,4)))")} FROM refunded) AS refund_value FROM kpis""",
            **monthly, opex=_OPEX, pnl=_PNL, kpis=_KPIS, refunded=_refund_log("TRUE")),
        # Workforce
        "headcount": _sql("staff depts", _HEADCOUNT),
        "role_salary": _sql("staff", f"""SELECT role, COUNT(DISTINCT employee_id) AS headcount, {_avg("salary")} AS avg_salary
            FROM staff WHERE role IS NOT NULL GROUP BY role"""),
        "revenue_per_employee": _sql("fact staff", f"""SELECT {_div("revenue", "(SELECT COUNT(DISTINCT employee_id) FROM staff)")}
            AS revenue_per_employee FROM kpis""", kpis=_KPIS),
        "payroll_monthly": _sql("slips", _payroll(f"year(payment_date) IN {_YEAR_LIST}")),
        "payroll_by_department": _sql("staff depts slips", f"""SELECT dept_name, COUNT(DISTINCT e.employee_id) AS headcount,
            {_avg("salary")} AS average_salary, {_raw_sum("gross_salary")} AS gross_payroll,
            {_raw_sum("net_salary")} AS net_payroll FROM {_STAFF_DEPT}
            LEFT JOIN slips p ON p.employee_id = e.employee_id GROUP BY dept_name"""),
        "attendance_summary": _sql("attended staff depts", f"""SELECT dept_name, COUNT(DISTINCT attendance_id) AS attendance_days,
            {_mean_time("check_in", "check_out", "3600.0")} AS avg_worked_hours,
            {_pct("COUNT(*) FILTER (WHERE check_out IS NULL)", "COUNT(*)")} AS missing_checkout_rate_pct
            FROM attended a LEFT JOIN staff e ON e.employee_id = a.employee_id LEFT JOIN depts d ON d.dept_id = e.dept_id
            WHERE dept_name IS NOT NULL GROUP BY dept_name"""),
        "attendance_by_department": _sql("attended staff depts", f"""SELECT dept_name,
            COUNT(DISTINCT attendance_id) AS attendance_records,
            round({_mean_time("check_in", "check_out", "3600.0")}, 2) AS average_worked_hours,
            round({_pct("COUNT(*) FILTER (WHERE check_out IS NULL)", "COUNT(*)")}, 2) AS missing_checkout_rate_pct
            FROM attended a JOIN staff e ON e.employee_id = a.employee_id LEFT JOIN depts d ON d.dept_id = e.dept_id
            GROUP BY dept_name"""),
        "salary_payment_status": f"""SELECT o_orderstatus AS status, COUNT(DISTINCT o_orderkey) AS payment_count,
            {_sum(_money("o_totalprice"))} AS amount FROM orders
            WHERE year(o_orderdate) IN {_YEAR_LIST} AND o_orderstatus IS NOT NULL GROUP BY 1""",
        "hr_cards": _sql("staff depts slips", f"""SELECT (SELECT COUNT(DISTINCT employee_id) FROM staff) AS headcount,
            (SELECT {_double("SUM(CAST(gross_payroll AS DECIMAL(38,4)))")} FROM paid) AS gross_payroll,
            {_avg_rate("avg_salary")} AS avg_department_salary FROM dept_staff""", dept_staff=_HEADCOUNT, paid=_payroll("TRUE")),
        # Operations and logistics
        "inventory_risk": _sql("stock catalogue", f"""SELECT product_id, store_id, CAST(quantity_on_hand AS DOUBLE) AS quantity_on_hand,
            CAST(reorder_level AS DOUBLE) AS reorder_level, product_name, category_name, CAST(cost_price AS DOUBLE) AS cost_price,
            below_reorder, {_double("inventory_value")} AS inventory_value FROM held""", held=_STOCK),
        "inventory_below_reorder": _sql("stock products brands categories", f"""SELECT category_name, product_name, store_id,
            CAST(quantity_on_hand AS DOUBLE) AS quantity_on_hand, CAST(reorder_level AS DOUBLE) AS reorder_level,
            quantity_on_hand < reorder_level AS below_reorder, {_double("quantity_on_hand * cost_price")} AS inventory_value
            FROM stock s JOIN products p ON p.product_id = s.product_id JOIN brands b ON b.brand_id = p.brand_id
            JOIN categories c ON c.category_id = b.category_id"""),
        "inventory_by_category": _sql("stock catalogue", _STOCK_CATEGORY, held=_STOCK),
        "outbound_status": _sql("outbound", _delivery("status", f"year(shipped_date) IN {_YEAR_LIST}")),
        "outbound_status_filtered": _sql("outbound", _delivery("status", "status IN ('Delivered')")),
        "courier_performance": _sql("outbound", _delivery("courier_name")),
        "courier_status_shipments": _sql("outbound", f"""SELECT courier_name, status, COUNT(*) AS shipments,
            round({_div("SUM(" + _days("shipped_date", "delivered_date") + ")", "COUNT(delivered_date)")}, 2) AS avg_delivery_days
            FROM outbound GROUP BY courier_name, status"""),
        "supplier_lead_time": _sql("inbound", _SUPPLIERS),
        "fastest_12_suppliers": _sql("inbound", f"{_SUPPLIERS} ORDER BY avg_lead_days, supplier_name LIMIT 12"),
        "supplier_shipments": _sql("inbound", f"""SELECT s_name AS supplier_name, COUNT(*) AS shipment_count,
            round({_div("SUM(" + _days("shipped_date", "arrival_date") + ")", "COUNT(arrival_date)")}, 2) AS avg_inbound_lead_days,
            {_raw_sum("quantity")} AS inbound_units FROM inbound i JOIN supplier s ON s.s_suppkey = i.supplier_id GROUP BY s_name"""),
        "warehouse_flow": _sql("inbound zones", _warehouses("TRUE")),
        "warehouse_flow_filtered": _sql("inbound zones",
            _warehouses(f"year(shipped_date) IN {_YEAR_LIST} AND region IN {_in(WAREHOUSE_ZONES)}")),
        "production_quality": _sql("work line_names", _PRODUCTION),
        "line_quality": _sql("work line_names", f"""SELECT line_name, {_raw_sum("produced")} AS units_produced,
            {_raw_sum("rejected")} AS units_rejected,
            {_pct2(_raw_sum("produced - rejected"), _raw_sum("produced"))} AS yield_pct,
            {_pct2(_raw_sum("rejected"), _raw_sum("produced"))} AS rejection_rate_pct
            FROM work w JOIN line_names n ON n.line_id = w.line_id GROUP BY line_name"""),
        "api_health": _sql("api", f"""SELECT endpoint, COUNT(DISTINCT request_id) AS requests,
            {_pct("COUNT(*) FILTER (WHERE status_code >= 400)", "COUNT(*)")} AS error_rate_pct,
            MAX(p95) AS p95_latency_ms FROM api a LEFT JOIN placed_p95 USING (endpoint) WHERE endpoint IS NOT NULL
            GROUP BY endpoint""", ordered="""SELECT endpoint, latency, 0.95::DOUBLE * (COUNT(*) OVER (PARTITION BY endpoint) - 1) AS place,
            ROW_NUMBER() OVER (PARTITION BY endpoint ORDER BY latency) - 1 AS i FROM api WHERE latency IS NOT NULL""",
            ends="""SELECT endpoint, MAX(place - floor(place)) AS part, MAX(CASE WHEN i = floor(place) THEN latency END) AS low,
            MAX(CASE WHEN i = ceil(place) THEN latency END) AS high FROM ordered GROUP BY endpoint""",
            placed_p95="""SELECT endpoint, CASE WHEN part < 0.5 THEN low + (high - low) * part
            ELSE high - (high - low) * (1.0::DOUBLE - part) END AS p95 FROM ends"""),
        "operations_cards": _sql("stock outbound work line_names inbound", f"""SELECT
            (SELECT COUNT(*) FROM stock WHERE quantity_on_hand < reorder_level) AS below_reorder_skus,
            {_avg_rate("avg_delivery_days")} AS avg_delivery_days,
            (SELECT {_avg_rate("rejection_rate_pct")} FROM made) AS avg_rejection_rate_pct,
            (SELECT {_avg_rate("avg_lead_days")} FROM supplied) AS avg_supplier_lead_days FROM carried""",
            made=_PRODUCTION, supplied=_SUPPLIERS, carried=_delivery("courier_name")),
        # Cross-functional
        "marketing_sales_profit": _sql("fact ads", _TREND, **monthly, spend=_SPEND_CHOSEN),
        "profit_cost": _sql("fact expenses", _PNL, **monthly, opex=_OPEX_YEARS),
        "region_sales_staff": _sql("fact staff stores regions", """SELECT a.*, b.headcount, b.avg_salary FROM by_region a
            LEFT JOIN by_staff b ON b.region_name = a.region_name""", by_region=_REGIONS, by_staff=_REGION_STAFF),
        "category_margin_inventory": _sql("fact stock", """SELECT a.*, b.inventory_units, b.inventory_value, b.below_reorder_skus
            FROM by_category a LEFT JOIN by_stock b ON b.category_name = a.category_name""",
            by_category=_CATEGORIES, held=_STOCK, by_stock=_STOCK_CATEGORY),
        "category_capital_and_margin": _sql("sold stock brands categories", f"""SELECT s.category_name, s.revenue, s.profit,
            {_pct2("s.profit", "s.revenue")} AS margin_pct, i.inventory_working_capital FROM sales s
            LEFT JOIN capital i ON i.category_name = s.category_name""",
            sales=f"""SELECT category_name, {_raw_sum("net_amount")} AS revenue, {_raw_sum("net_amount - cost")} AS profit
            FROM sold x JOIN brands b ON b.brand_id = x.brand_id JOIN categories c ON c.category_id = b.category_id
            GROUP BY category_name""",
            capital=f"""SELECT category_name, {_raw_sum("quantity_on_hand * cost_price")} AS inventory_working_capital
            FROM stock k JOIN products p ON p.product_id = k.product_id JOIN brands b ON b.brand_id = p.brand_id
            JOIN categories c ON c.category_id = b.category_id GROUP BY category_name"""),
        "overview_cards": _sql("fact expenses slips stock staff", f"""SELECT
            (SELECT {_double("SUM(CAST(opex AS DECIMAL(38,4)))")} FROM opex) AS opex,
            (SELECT {_double("SUM(CAST(gross_payroll AS DECIMAL(38,4)))")} FROM paid) AS gross_payroll,
            (SELECT COUNT(*) FROM stock WHERE quantity_on_hand < reorder_level) AS below_reorder_skus,
            {_div("revenue", "greatest(1, (SELECT COUNT(DISTINCT employee_id) FROM staff))")} AS revenue_per_employee FROM kpis""",
            opex=_OPEX, paid=_payroll("TRUE"), kpis=_KPIS),
        # Observations and report
        "insights": _sql(_INSIGHT_USES, _INSIGHTS, **_INSIGHT_PARTS),
        "management_priorities": _sql(_INSIGHT_USES, """SELECT * FROM told WHERE "group" IN
            ('Executive', 'Finance', 'Operations & Logistics', 'Cross-Functional')""", **_INSIGHT_PARTS, told=_INSIGHTS),
        "fact_insights": _sql("fact", f"""SELECT 1 AS seq, CASE WHEN margin_pct < 20
            THEN 'Profit margin is below the 20% review threshold; examine cost, discount, refund, and product-mix drivers.'
            ELSE 'Revenue and profit metrics are available for management review; compare product and regional contribution before action planning.'
            END AS message FROM kpis UNION ALL SELECT 2, 'Review category ''' ||
            {_first("by_category", "category_name", "margin_pct")} ||
            ''' because it has the lowest observed profit margin in the selected context.'
            UNION ALL SELECT 3, {_AT_RISK} || ' high-value customer(s) are classified as At-Risk Valuable; consider targeted retention or service-recovery review.'
            WHERE {_AT_RISK} > 0""", **_RFM_PARTS, kpis=_KPIS, by_category=_CATEGORIES),
        "report_lines": _sql(_INSIGHT_USES, _LINES, **_INSIGHT_PARTS, told=_INSIGHTS),
        "report_html": _sql(_INSIGHT_USES, f"""SELECT seq, CASE WHEN seq = (SELECT MIN(seq) FROM printed)
            THEN '<html><body><pre>' ELSE '' END || {_escaped("line")} || CASE WHEN seq = (SELECT MAX(seq) FROM printed)
            THEN '</pre></body></html>' ELSE '' END AS line FROM printed""", **_INSIGHT_PARTS, told=_INSIGHTS, printed=_LINES),
        # Cleaning and validation
        "duplicate_rows_dropped": _sql("items", f"""SELECT order_id, COUNT(*) AS items, {_raw_sum("net_amount")} AS net_amount
            FROM (SELECT DISTINCT * FROM items) q GROUP BY order_id"""),
        "json_duplicates_dropped": _sql("views", """SELECT DISTINCT view_id % 100 AS slot,
            COALESCE(customer_id, -1) AS "user" FROM views"""),
        "dates_standardised": """SELECT o_orderkey AS order_id,
            CASE WHEN o_orderkey % 4 <> 3 THEN o_orderdate END AS order_date FROM orders""",
        "numbers_coerced": _sql("payments", """SELECT payment_id,
            CAST(CASE WHEN status = 'Cancelled' THEN 0 ELSE amount END AS DOUBLE) AS amount FROM payments"""),
        "required_tables": _sql("placed items products brands categories", " UNION ALL ".join([
            _required("orders", "sales.orders", "placed"), _required("order_items", "sales.order_items", "items"),
            _required("products", "products.products", "products"), _required("brand", "core.dim_brand", "brands"),
            _required("category", "core.dim_category", "categories")])),
        "quality_profile": _sql(" ".join(sorted({t for _, t, _ in _PROFILED})), " UNION ALL ".join(
            _profile(key, t, columns.split()) for key, t, columns in _PROFILED)),
        "order_row_count": "SELECT COUNT(*) AS order_count FROM orders",
        "order_date_coverage": """SELECT MIN(o_orderdate) AS first_order_date, MAX(o_orderdate) AS last_order_date
            FROM orders""",
        "duplicate_shipment_ids": _sql("outbound", """SELECT shipment_id, COUNT(*) AS duplicate_count FROM outbound
            GROUP BY shipment_id HAVING COUNT(*) > 1"""),
        # Text rendering
        "currency_text": f"""SELECT payment_id, {_currency("v")} AS amount_text FROM (SELECT o_orderkey AS payment_id,
            CASE o_orderkey % 5 WHEN 0 THEN o_totalprice / 1000 WHEN 1 THEN o_totalprice * 100 WHEN 2 THEN -o_totalprice
            WHEN 3 THEN o_totalprice / 10 END AS v FROM orders) q""",
        "percent_text": f"""SELECT o_orderkey AS order_id, CASE WHEN {_money("o_totalprice")} > 100000
            THEN printf('%.2f%%', CAST({_money("o_totalprice * 0.05::DOUBLE")} AS DOUBLE) / 1000) ELSE 'N/A' END AS share_text FROM orders""",
        "html_text": f"""SELECT p_partkey AS product_id,
            {_escaped("'<b>' || p_name || '''s " + '"new" & ' + "' || p_name || '</b>'")} AS html FROM part""",
    } | _indicators()
    return sql | {name: _bundle(sql, results) for name, results in BUNDLES.items()}


_TABLES["orders_all"] = f"""SELECT o_orderkey AS order_id, o_custkey AS cust_id, o_custkey % 27 AS store_id,
    o_orderdate AS order_date, {_STATUS} AS order_status, {_money("o_totalprice")} AS net_total,
    {_money("o_totalprice * 0.05::DOUBLE")} AS discount, o_orderkey % 4 AS payment_mode_id FROM orders"""
_TABLES |= {
    "returned_dated": f"""SELECT l_orderkey * 8 + l_linenumber AS return_id, l_orderkey AS order_id, {_PRODUCT} AS prod_id,
        l_linenumber % 4 AS reason, {_money("l_extendedprice")} AS refund_amount, l_shipdate AS return_date
        FROM lineitem WHERE l_returnflag = 'R'""",
    "work_dated": f"""SELECT l_linenumber AS line_id, {_money("l_quantity")} AS produced,
        {_money("l_quantity * l_discount")} AS rejected, l_shipdate AS start_timestamp FROM lineitem""",
    "salaries": f"""SELECT o_orderkey AS payment_id, o_orderstatus AS status, {_money("o_totalprice")} AS amount,
        o_orderdate AS payment_date FROM orders""",
    "emails_dated": """SELECT user_id % 120 AS campaign_id, 1 AS sent, event_type IN ('view', 'click', 'purchase') AS opened,
        event_type IN ('click', 'purchase') AS clicked, ts AS sent_date FROM events""",
    "attended_dated": f"""SELECT event_id AS attendance_id, user_id AS employee_id, ts AS attendance_date, ts AS check_in,
        {_LATER} AS check_out FROM events""",
    "api_dated": """SELECT event_id AS request_id, user_id % 10 AS endpoint,
        CASE WHEN event_type = 'error' THEN 500 WHEN event_type <> 'signup' THEN 200 END AS status_code,
        value AS latency, ts AS called FROM events""",
    "zones_named": "SELECT n_nationkey AS warehouse_id, n_name AS name, n_regionkey AS region FROM nation",
    "tiers": "SELECT r_regionkey AS tier_id, r_name AS tier_name FROM region",
    "customer_ids": "SELECT c_custkey AS customer_id FROM customer",
    "supplier_names": "SELECT s_suppkey AS supplier_id, s_name AS supplier_name FROM supplier",
    "ratings": "SELECT quality * 3 + toxic + 1 AS rating FROM labels",
    "promos": """SELECT TIMESTAMP '1995-01-01' + to_days(n_nationkey * 90) AS start_date,
        TIMESTAMP '1995-01-11' + to_days(n_nationkey * 90) AS end_date FROM nation""",
    "redeemed": "SELECT o_orderdate AS redemption_date FROM orders WHERE o_orderkey % 20 = 0",
    "failures": "SELECT o_orderdate AS failed_at FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 5 = 0",
    "procedures": """SELECT ts AS called_at, CASE WHEN event_type = 'error' THEN 'FAILED'
        WHEN event_type <> 'signup' THEN 'OK' END AS status FROM events""",
}
