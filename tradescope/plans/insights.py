"""Rule-based observations as rows of text, each computed from one aggregate row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradescope.dataset import Dataset
from tradescope.functions.text import RUPEE, fixed, grouped
from tradescope.plans.finance import expense_categories, expenses_in_scope
from tradescope.plans.hr import headcount
from tradescope.plans.marketing import ad_spend, platform_spend
from tradescope.plans.operations import production_quality
from tradescope.plans.rfm import AT_RISK, rfm_segments
from tradescope.plans.rollup import SalesRollup, sales_rollup
from tradescope.plans.sales import (
    category_contribution,
    executive_kpis,
    leading,
    product_contribution,
    revenue_and_profit,
)

# --- Fixed values: insight groups and sentences ----------------------------------------
GROUPS = [
    "Executive",
    "Sales & Customer",
    "Marketing",
    "Finance",
    "HR",
    "Operations & Logistics",
    "Cross-Functional",
]
PRIORITY_GROUPS = ["Executive", "Finance", "Operations & Logistics", "Cross-Functional"]
EXECUTIVE = "Selected filters show revenue of {revenue}, profit of {profit}, and a profit margin of {margin}%."
TOP_PRODUCT = "{name} is the highest-revenue product in the selected view and should be monitored for margin protection and availability."
AT_RISK_COUNT = "{count} customers are classified as At-Risk Valuable based on RFM logic; targeted re-engagement can be prioritised."
TOP_PLATFORM = "{name} has the highest marketing spend in the selected period. Review it alongside revenue-per-spend before reallocating budget."
TOP_EXPENSE = "The largest expense category is {name}; it should be reviewed when the cost-to-revenue ratio increases."
TOP_DEPARTMENT = "{name} has the highest headcount. Compare staffing level, average salary, and revenue contribution during workforce planning."
WORST_LINE = "{name} has the highest production rejection rate. Quality checks and root-cause review should be prioritised."
SPEND_REVIEW = "Review marketing spend together with revenue and profit because higher spend does not automatically indicate efficient growth."
CAPITAL_REVIEW = "Review categories with high inventory working capital and lower margins to reduce capital blockage and margin pressure."
NO_FACT = "No valid sales fact records are available for AI-assisted insight generation."
LOW_MARGIN = "Profit margin is below the 20% review threshold; examine cost, discount, refund, and product-mix drivers."
NEUTRAL = "Revenue and profit metrics are available for management review; compare product and regional contribution before action planning."
WEAK_CATEGORY = "Review category '{name}' because it has the lowest observed profit margin in the selected context."
AT_RISK_REVIEW = "{count} high-value customer(s) are classified as At-Risk Valuable; consider targeted retention or service-recovery review."
MARGIN_THRESHOLD = 20
# Columns of the fact that the groups read beside month, revenue and cost.
GROUP_COLUMNS = {
    "Sales & Customer": ["order_id", "cust_id", "order_date", "product_name", "quantity"],
    "Cross-Functional": ["category_name"],
}
# --- End of fixed values ---------------------------------------------------------------


def _sentence(template: str, **parts: Column) -> Column:
    """The template with its named gaps filled by columns."""
    text = F.lit(template)
    for name, value in parts.items():
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    return text


def _row(df: DataFrame, group: str, seq: int, rule: str, message: Column) -> DataFrame:
    return df.select(
        F.lit(GROUPS.index(group) + 1).alias("group_no"),
        F.lit(group).alias("group"),
        F.lit(seq).alias("seq"),
        F.lit(rule).alias("rule_id"),
        message.alias("message"),
    )


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _leader(df: DataFrame, measure: str, descending: bool = True) -> DataFrame:
    """The first row by a measure, its name column called ``name``."""
    name = df.columns[0]
    return leading(df, measure, name, 1, descending).select(F.col(name).alias("name"))


def _at_risk(rfm: DataFrame) -> DataFrame:
    """Number of at-risk customers; no row when there are no customers at all."""
    return rfm.agg(
        F.count_if(F.col("segment") == AT_RISK).alias("n"), F.count(F.lit(1)).alias("customers")
    ).where(F.col("customers") > 0)


def _executive(fact: DataFrame) -> DataFrame:
    margin = F.when(F.col("margin_pct").isNull(), F.lit("nan")).otherwise(
        fixed("margin_pct", 1)
    )
    message = _sentence(
        EXECUTIVE,
        revenue=F.concat(F.lit(RUPEE), grouped("revenue")),
        profit=F.concat(F.lit(RUPEE), grouped("profit")),
        margin=margin,
    )
    return _row(revenue_and_profit(fact), "Executive", 1, "executive_summary", message)


def _rollup_for(fact: DataFrame, groups: Sequence[str]) -> SalesRollup:
    """The fact rolled up by what some of the groups read; for all groups whole, as the report does."""
    wanted = {"month", "net_amount", "cost", *(c for g in groups for c in GROUP_COLUMNS.get(g, []))}
    kept = [c for c in fact.columns if c in wanted]
    narrow = "month" in kept and set(groups) < set(GROUPS)
    return sales_rollup(fact.select(*kept) if narrow else fact)


def build_insights(
    ds: Dataset,
    fact: DataFrame | SalesRollup,
    years: Sequence[int] | None = None,
    platforms: Sequence[str] | None = None,
    rfm: DataFrame | None = None,
    groups: Sequence[str] = GROUPS,
) -> DataFrame:
    """(group_no, group, seq, rule_id, message) over all business areas, or only some ``groups``.

    The fact is rolled up once; what no wanted group needs is not built, and columns that none
    of them reads are not joined.
    """
    sold = fact if isinstance(fact, SalesRollup) else _rollup_for(fact, groups)
    rows = []
    if "Executive" in groups:
        rows.append(_executive(sold.orders))
    if "Sales & Customer" in groups:
        if sold.products is not None:
            top = _leader(product_contribution(sold.products), "revenue")
            rows.append(
                _row(top, "Sales & Customer", 1, "top_product", _sentence(TOP_PRODUCT, name=F.col("name")))
            )
        risky = _at_risk(rfm if rfm is not None else rfm_segments(sold.orders, one_row_per_order=sold.one_row_per_order))
        rows.append(
            _row(risky, "Sales & Customer", 2, "at_risk", _sentence(AT_RISK_COUNT, count=grouped("n")))
        )
    named = []
    if "ads_spend" in ds and "Marketing" in groups:
        platform = platform_spend(ad_spend(ds, years, platforms))
        named.append((platform, "spend", "Marketing", "top_platform", TOP_PLATFORM))
    if "finance_expenses" in ds and "Finance" in groups:
        expense = expense_categories(ds, expenses_in_scope(ds, years))
        named.append((expense, "expense", "Finance", "top_expense", TOP_EXPENSE))
    if "store_employees" in ds and "HR" in groups:
        named.append((headcount(ds), "headcount", "HR", "top_department", TOP_DEPARTMENT))
    if "work_orders" in ds and "Operations & Logistics" in groups:
        lines = production_quality(ds, years)
        named.append(
            (lines, "rejection_rate_pct", "Operations & Logistics", "worst_line", WORST_LINE)
        )
    for df, measure, group, rule, template in named:
        rows.append(_row(_leader(df, measure), group, 1, rule, _sentence(template, name=F.col("name"))))
    if "Cross-Functional" in groups:
        # Both sentences only ask whether their result has a row, that is, its key in the fact.
        asked = [("marketing_sales_profit", sold.orders, "month", SPEND_REVIEW)]
        if sold.categories is not None and "inventory" in ds:
            asked.append(("category_margin_inventory", sold.categories, "category_name", CAPITAL_REVIEW))
        for seq, (rule, part, column, sentence) in enumerate(asked, 1):
            any_row = part.where(F.col(column).isNotNull()).limit(1)
            rows.append(_row(any_row, "Cross-Functional", seq, rule, F.lit(sentence)))
    return _stack(rows).orderBy("group_no", "seq")


def priorities(insights: DataFrame) -> DataFrame:
    """The observations of the four management groups."""
    return insights.where(F.col("group").isin(PRIORITY_GROUPS))


def fact_insights(fact: DataFrame, rfm: DataFrame | None = None) -> DataFrame:
    """(seq, message) from the sales fact alone, which is rolled up once."""
    sold = sales_rollup(fact)
    state = executive_kpis(sold.orders).select(
        "margin_pct", sold.orders.agg(F.count(F.lit(1)).alias("n")).select("n").scalar().alias("n")
    )
    first = state.select(
        F.lit(1).alias("seq"),
        F.when(F.col("n") == 0, NO_FACT)
        .when(F.col("margin_pct") < MARGIN_THRESHOLD, LOW_MARGIN)
        .otherwise(NEUTRAL)
        .alias("message"),
    )
    rows = [first]
    if sold.categories is not None:
        weakest = _leader(category_contribution(sold.categories), "margin_pct", descending=False)
        rows.append(
            weakest.select(
                F.lit(2).alias("seq"), _sentence(WEAK_CATEGORY, name=F.col("name")).alias("message")
            )
        )
    risky = _at_risk(rfm if rfm is not None else rfm_segments(sold.orders)).where(F.col("n") > 0)
    rows.append(
        risky.select(
            F.lit(3).alias("seq"), _sentence(AT_RISK_REVIEW, count=F.col("n")).alias("message")
        )
    )
    return _stack(rows).orderBy("seq")
