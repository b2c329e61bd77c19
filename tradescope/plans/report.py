"""The management report: seven frames and the text, built on one roll-up of the fact."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradescope.dataset import Dataset
from tradescope.functions.text import currency, grouped, percent_text
from tradescope.operators.filters import Filters, filter_sales
from tradescope.operators.staging import stage, staging
from tradescope.plans.cross import cross_functional_results
from tradescope.plans.fact import sales_fact
from tradescope.plans.finance import finance_results
from tradescope.plans.hr import headcount
from tradescope.plans.insights import GROUPS, build_insights
from tradescope.plans.marketing import ad_spend, platform_spend
from tradescope.plans.operations import inventory_risk
from tradescope.plans.rollup import SalesRollup, sales_rollup
from tradescope.plans.sales import executive_kpis, monthly_sales, product_contribution
from tradescope.sources.sinks import write_frames, write_html, write_text

# --- Fixed values: report labels and frame names ---------------------------------------
RULE_WIDTH = 65
INSIGHTS_HEADING = "Management Insights"
# --- End of fixed values ---------------------------------------------------------------

_GROUP_STEP = 100


@dataclass(frozen=True)
class Report:
    lines: DataFrame
    frames: dict[str, DataFrame]


def _heading(kpis: DataFrame, title: str) -> DataFrame:
    texts = [
        F.lit(title),
        F.lit("=" * RULE_WIDTH),
        F.concat(F.lit("Revenue: "), currency("revenue")),
        F.concat(F.lit("Profit: "), currency("profit")),
        F.concat(F.lit("Profit Margin: "), percent_text("margin_pct")),
        F.concat(F.lit("Orders: "), grouped("orders")),
        F.lit(""),
        F.lit(INSIGHTS_HEADING),
    ]
    rows = F.array(
        *[F.struct(F.lit(i).alias("seq"), text.alias("line")) for i, text in enumerate(texts, 1)]
    )
    return kpis.select(F.inline(rows))


def _group_headings(spark: SparkSession) -> DataFrame:
    """An empty line and the name of each group, also of groups without observations."""
    rows = []
    for number, group in enumerate(GROUPS, 1):
        rows += [(number * _GROUP_STEP, ""), (number * _GROUP_STEP + 1, group)]
    return spark.createDataFrame(rows, "seq int, line string")


def report_lines(kpis: DataFrame, insights: DataFrame, title: str) -> DataFrame:
    """(seq, line) rows of the text report."""
    items = insights.select(
        (F.col("group_no") * _GROUP_STEP + 1 + F.col("seq")).alias("seq"),
        F.concat(F.lit("- "), "message").alias("line"),
    )
    return (
        _heading(kpis, title)
        .unionByName(_group_headings(kpis.sparkSession))
        .unionByName(items)
        .orderBy("seq")
    )


def build_report(
    ds: Dataset, fact: DataFrame | SalesRollup, filters: Filters, title: str = "Management Report"
) -> Report:
    """Report over a filtered fact, which is rolled up once for all parts."""
    sold = fact if isinstance(fact, SalesRollup) else sales_rollup(fact)
    kpis = executive_kpis(sold.orders, sold.one_row_per_order)
    insights = build_insights(ds, sold, filters.years, filters.platforms)
    frames = {
        "Executive_Monthly_KPI": monthly_sales(sold.orders),
        "Finance_PnL": finance_results(ds, sold.orders, filters.years)["pnl"],
    }
    if sold.products is not None:
        frames["Sales_Product"] = product_contribution(sold.products)
    cross = cross_functional_results(ds, sold.orders, filters.years, filters.platforms, sold.categories)
    for key in ("region_sales_staff", "category_margin_inventory", "marketing_sales_profit"):
        if key in cross and "Cross_Functional" not in frames:
            frames["Cross_Functional"] = cross[key]
    if "ads_spend" in ds:
        spend = ad_spend(ds, filters.years, filters.platforms)
        frames["Marketing_Platform"] = platform_spend(spend)
    if "store_employees" in ds:
        frames["HR_Headcount"] = headcount(ds)
    if "inventory" in ds:
        frames["Ops_Inventory"] = inventory_risk(ds)
    return Report(report_lines(kpis, insights, title), frames)


def export_report(
    ds: Dataset, root: str, filters: Filters | None = None, title: str = "Management Report"
) -> Report:
    """Roll the filtered fact up once, write frames, text and HTML under ``root``, and clean up.

    The report returned reads the frames and lines that were written.  Without any valid
    sale there is nothing to report on, which is an error.
    """
    chosen = filters or Filters()
    with staging(ds.spark):
        sold = sales_rollup(filter_sales(sales_fact(ds), chosen))
        if sold.orders.isEmpty():
            raise ValueError("no valid sales in the chosen scope: there is nothing to report")
        report = build_report(ds, sold, chosen, title)
        lines = stage(report.lines, "report_lines")
        write_frames(report.frames, f"{root}/frames")
        lines.write.mode("overwrite").parquet(f"{root}/lines")
        write_text(lines, f"{root}/text")
        write_html(lines, f"{root}/html")
    read = ds.spark.read.parquet
    frames = {name: read(f"{root}/frames/{name}") for name in report.frames}
    return Report(read(f"{root}/lines").orderBy("seq"), frames)
