"""Values, rows and frames that must not be lost on the way."""

import pytest
from pyspark.sql import functions as F

from tests.helpers import by, dataset, rows
from tradescope.functions import exprs
from tradescope.operators import clean, quality, ranking
from tradescope.operators.staging import stage, staging
from tradescope.plans import finance, hr, marketing, operations, sales
from tradescope.plans.fact import sales_fact
from tradescope.sources import sinks
from tradescope.sources.loader import ready_for_sales


def numbers(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    return [float(r.v) for r in df.select(exprs.number_or_zero("a").alias("v")).collect()]


def test_large_and_small_numbers_stay(spark):
    assert numbers(spark, "1234567890123456.5", "0.00004", "n/a", None, "nan") == [1234567890123456.5, 0.00004, 0, 0, 0]


def test_a_number_out_of_range_is_an_error(spark):
    with pytest.raises(Exception, match="number out of range"):
        numbers(spark, "1" + "0" * 40)


def test_long_frame_names_stay_apart(spark, tmp_path):
    name = "a_report_frame_with_a_name_of_many_letters"
    sinks.write_frames({f"{name}_1": spark.range(1), f"{name}_2": spark.range(2)}, str(tmp_path))
    assert [spark.read.parquet(f"{tmp_path}/{name}_{i}").count() for i in (1, 2)] == [1, 2]
    with pytest.raises(ValueError, match="share a folder"):
        sinks.write_frames({"Sales": spark.range(1), "sales": spark.range(1)}, str(tmp_path))


def test_written_values_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None), (3, 'say "x"')], "id long, text string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    read = spark.read.schema(df.schema).option("header", True).option("escape", "\\").csv(str(tmp_path / "csv"))
    assert sorted(rows(read, "id", "text"), key=str) == sorted(rows(df, "id", "text"), key=str)


def test_a_null_group_is_ranked_too(spark):
    df = spark.createDataFrame([("a", 1), (None, 5), (None, 3)], "g string, v long")
    placed = ranking.position_in_group(df, ["g"], ["v"])
    assert sorted(rows(placed, "g", "v", "position"), key=str) == [("a", 1, 1), (None, 3, 1), (None, 5, 2)]


@pytest.fixture
def bare(spark):
    """Facts whose lookup tables are there but empty."""
    return dataset(
        spark,
        loyalty_members=[{"customer_id": 1, "tier_id": 7, "points_balance": 5}],
        loyalty_tiers=[],
        email_clicks=[{"campaign_id": 3, "emails_sent": 10, "emails_opened": 5, "emails_clicked": 1}],
        campaigns=[],
        finance_expenses=[{"exp_cat_id": 4, "amount": 9, "expense_date": "2024-01-01"}],
        expense_category=[],
        store_employees=[{"employee_id": 1, "dept_id": 2, "salary": 10}],
        department=[],
        attendance=[{"attendance_id": 1, "employee_id": 1}],
        inbound_shipments=[{"shipment_id": 1, "supplier_id": 6, "quantity": 3}],
        suppliers=[],
        work_orders=[{"line_id": 8, "quantity_produced": 10, "rejected_quantity": 1}],
        production_lines=[],
    )


def test_empty_lookups_fall_back_to_the_id(bare):
    assert rows(sales.loyalty_by_tier(bare), "tier", "members") == [(7, 1)]
    assert rows(marketing.email_performance(bare), "campaign_id", "sent") == [(3, 10)]
    assert rows(finance.expense_categories(bare, finance.expenses_in_scope(bare)), "exp_cat_id", "expense") == [(4, 9.0)]
    assert rows(hr.headcount(bare), "dept_id", "headcount") == [(2, 1)]
    assert rows(hr.attendance_summary(bare), "dept_id", "attendance_days") == [(2, 1)]
    inbound = operations.inbound_in_scope(bare, with_warehouse=False)
    assert rows(operations.supplier_lead_time(bare, inbound), "supplier_id", "inbound_units") == [(6, 3.0)]
    assert rows(operations.production_quality(bare), "line_id", "rejection_rate_pct") == [(8, 10.0)]


def test_attendance_without_any_employee_counts_by_employee(spark):
    ds = dataset(spark, attendance=[{"attendance_id": 1, "employee_id": 9}], store_employees=[], department=[])
    assert rows(hr.attendance_summary(ds), "employee_id", "attendance_days") == [(9, 1)]


def test_nested_maps_are_deduplicated_by_content(spark):
    df = spark.sql(
        "SELECT array(map('a', 1, 'b', 2)) x, named_struct('m', map('p', map('k', 1, 'l', 2))) y "
        "UNION ALL SELECT array(map('b', 2, 'a', 1)), named_struct('m', map('p', map('l', 2, 'k', 1))) "
        "UNION ALL SELECT array(map('a', 1)), NULL"
    )
    assert clean.drop_duplicate_rows(df).count() == 2
    profile = quality.profile_table(df, "t").collect()[0]
    assert (profile.rows, profile.duplicate_rows_after_cleaning, profile.missing_cell_rate_pct) == (3, 1, 16.67)


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "a long, b double")
    assert quality.profile_table(df, "t").collect()[0].missing_cell_rate_pct == 25.0


def shop(spark):
    return dataset(
        spark,
        orders=[{"order_id": i, "cust_id": i, "order_date": "2024-01-01", "order_status": "Shipped"} for i in (1, 2)],
        order_items=[{"order_id": i, "prod_id": 5, "quantity": 1, "net_amount": 10} for i in (1, 2)],
        products=[{"product_id": 5, "product_name": n, "brand_id": 1, "cost_price": 1} for n in ("old name", "new name")],
        brand=[{"brand_id": 1, "category_id": 1}],
        category=[{"category_id": 1, "category_name": "c"}],
        sales_returns=[{"return_id": 1, "order_id": 1, "prod_id": 5, "reason": "late", "refund_amount": 4}],
    )


def test_a_return_of_a_product_with_two_names_counts_for_each(spark):
    ds = shop(spark)
    reasons = by(sales.return_reasons(ds, sales_fact(ds, ("category",))), "reason")
    assert (reasons["late"]["refund_value"], reasons["late"]["return_count"]) == (8.0, 1)


def test_an_empty_fact_table_closes_the_gate(spark):
    ds = dataset(spark, orders=[], order_items=[], products=[])
    assert ready_for_sales(ds) and not ready_for_sales(ds, with_rows=True)


def test_a_staging_scope_cleans_up(spark):
    with staging(spark):
        staged = stage(spark.range(3), "numbers")
        assert staged.count() == 3
        (file,) = {f.rsplit("/", 1)[0] for f in staged.inputFiles()}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(file).count()


def jobs(spark, work) -> int:
    """Jobs that ``work`` starts."""
    context = spark.sparkContext
    context.setJobGroup("counted", "counted")
    work()
    found = len(context.statusTracker().getJobIdsForGroup("counted"))
    context.setJobGroup("other", "other")
    return found


def test_building_a_bundle_starts_no_job(spark):
    ds = shop(spark)
    fact = sales_fact(ds)
    assert jobs(spark, lambda: sales.sales_customer_results(ds, fact)) == 0
    assert jobs(spark, lambda: operations.operations_results(ds)) == 0


def test_totals_of_wide_text_numbers(spark):
    df = spark.createDataFrame([("12345678901234567.25",), ("0.75",)], "amount string")
    summed = exprs.with_numbers(df, ["amount"]).agg(F.sum("amount").cast("string").alias("v")).collect()[0].v
    assert summed.rstrip("0") == "12345678901234568."
