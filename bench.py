"""Time the headline queries (median of three runs) and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default: all cores).
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from verification.catalog import queries

HEADLINE = [
    "executive_kpis", "monthly_sales", "monthly_sales_with_cost", "product_contribution",
    "top_products", "category_contribution", "regional_contribution", "region_state_sales",
    "return_reasons", "rfm_segments", "rfm_base", "campaign_pacing", "email_performance",
    "spend_sales_trend", "web_engagement", "spend_and_revenue", "expense_categories",
    "profit_and_loss", "payment_status", "headcount", "payroll_monthly",
    "payroll_by_department", "attendance_summary", "inventory_by_category",
    "courier_performance", "supplier_lead_time", "production_quality", "api_health",
    "region_sales_staff", "category_margin_inventory", "duplicate_rows_dropped",
    "quality_profile", "insights", "report_lines", "management_priorities", "finance_cards",
    "marketing_cards", "overview_cards", "filter_options", "sales_filtered", "segment_summary",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tradescope-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog = queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        catalog[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in ("executive_kpis", "rfm_segments"):  # JVM warm-up
        run(name)
    seconds = {name: round(median(run(name) for _ in range(RUNS)), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("/", 1)[-1].removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
