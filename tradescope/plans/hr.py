"""Workforce results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradescope.dataset import Dataset, Results
from tradescope.functions.exprs import (
    mean,
    mean_hours,
    mean_rate,
    month_start,
    percent,
    ratio,
    seconds_between,
    share,
    sql_total,
    total,
    with_numbers,
)
from tradescope.operators.filters import by_years
from tradescope.operators.joins import lookup, lookup_table, named_by

_PAY_COLUMNS = ["gross_salary", "net_salary", "pf", "professional_tax", "income_tax"]
_DEDUCTIONS = ["pf", "professional_tax", "income_tax"]


def employees_with_department(ds: Dataset) -> DataFrame:
    return lookup_table(ds.table("store_employees"), ds, "department", "dept_id", suffix="_dept")


def _employees_by_name(ds: Dataset) -> DataFrame:
    """Employees with their department's name, or its id while no department is known."""
    return named_by(ds.table("store_employees"), ds, "department", "dept_id", suffix="_dept")


def _department_column(df: DataFrame, fallback: str = "dept_id") -> str:
    for name in ("dept_name", "dept_id"):
        if name in df.columns:
            return name
    return fallback


def _staff_by(employees: DataFrame, key: str) -> DataFrame:
    return (
        employees.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count_distinct("employee_id").alias("headcount"),
            mean("salary").alias("avg_salary"),
        )
    )


def headcount(ds: Dataset) -> DataFrame:
    employees = _employees_by_name(ds)
    key = _department_column(employees)
    return _staff_by(employees, key).orderBy(F.col("headcount").desc(), key)


def role_salary(ds: Dataset) -> DataFrame:
    employees = employees_with_department(ds)
    key = "role" if "role" in employees.columns else _department_column(employees)
    return _staff_by(employees, key).orderBy(F.col("avg_salary").desc_nulls_last(), key)


def revenue_per_employee(ds: Dataset, kpis: DataFrame) -> DataFrame:
    """Revenue of the KPI row over the number of employees."""
    staff = ds.table("store_employees").agg(F.count_distinct("employee_id").alias("n"))
    return kpis.select(
        ratio(F.col("revenue"), staff.select("n").scalar()).alias("revenue_per_employee")
    )


def payroll_monthly(ds: Dataset, years: Sequence[int] | None = None) -> DataFrame:
    """Gross and net pay and all deductions of a month, in one aggregation."""
    slips = with_numbers(by_years(ds.table("pay_slips"), ["payment_date"], years), _PAY_COLUMNS)
    present = [c for c in _DEDUCTIONS if c in slips.columns]
    sums = [F.sum(c).alias(c) for c in present]
    monthly = (
        slips.withColumn("month", month_start("payment_date"))
        .where(F.col("month").isNotNull())
        .groupBy("month")
        .agg(
            total("gross_salary").alias("gross_payroll"),
            total("net_salary").alias("net_payroll"),
            *sums,
        )
    )
    deducted = F.lit(0)
    for name in present:
        deducted = deducted + F.col(name)
    return (
        monthly.withColumn("deductions", deducted.cast("double"))
        .withColumn("deduction_rate_pct", percent(F.col("deductions"), F.col("gross_payroll")))
        .drop(*present)
    )


def attendance_summary(ds: Dataset, years: Sequence[int] | None = None) -> DataFrame:
    records = by_years(ds.table("attendance"), ["attendance_date"], years).withColumn(
        "worked_seconds", seconds_between("check_in", "check_out")
    )
    if ds.has_rows("store_employees"):
        staff = _employees_by_name(ds)
        records = lookup(records, staff, "employee_id", ["dept_name", "dept_id"])
    key = _department_column(records, "employee_id")
    return (
        records.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count_distinct("attendance_id").alias("attendance_days"),
            mean_hours("worked_seconds").alias("avg_worked_hours"),
            share(F.col("check_out").isNull()).alias("missing_checkout_rate_pct"),
        )
    )


def salary_payment_status(ds: Dataset, years: Sequence[int] | None = None) -> DataFrame:
    history = by_years(ds.table("salary_history"), ["payment_date"], years)
    return (
        history.where(F.col("status").isNotNull())
        .groupBy("status")
        .agg(
            F.count_distinct("payment_id").alias("payment_count"),
            total("amount").alias("amount"),
        )
    )


def hr_results(
    ds: Dataset, kpis: DataFrame, years: Sequence[int] | None = None
) -> Results:
    results: dict[str, Callable[[], DataFrame]] = {}
    if "store_employees" in ds:
        results["headcount"] = lambda: headcount(ds)
        results["role_salary"] = lambda: role_salary(ds)
        results["revenue_per_employee"] = lambda: revenue_per_employee(ds, kpis)
    if "pay_slips" in ds:
        results["payroll_monthly"] = lambda: payroll_monthly(ds, years)
    if "attendance" in ds:
        results["attendance"] = lambda: attendance_summary(ds, years)
    if "salary_history" in ds:
        results["salary_payment_status"] = lambda: salary_payment_status(ds, years)
    return Results(results)


def hr_cards(ds: Dataset, departments: DataFrame, payroll: DataFrame) -> DataFrame:
    """Headcount, gross payroll and mean of the department averages, as one row."""
    gross = payroll.agg(total(F.col("gross_payroll").cast("decimal(38,4)")).alias("v"))
    average = departments.agg(mean_rate("avg_salary").alias("v"))
    staff = ds.table("store_employees").agg(F.count_distinct("employee_id").alias("headcount"))
    return staff.select(
        "headcount",
        gross.select("v").scalar().alias("gross_payroll"),
        average.select("v").scalar().alias("avg_department_salary"),
    )


# --- SQL reports -------------------------------------------------------------------------


def payroll_by_department(ds: Dataset) -> DataFrame:
    """Payroll per department with salaries averaged over the pay slips of each employee.

    The slips are added up per employee before the join, with their number as the weight
    of the employee's salary, so a long pay history never multiplies employee rows.
    """
    slips = (
        ds.table("pay_slips")
        .where(F.col("employee_id").isNotNull())
        .groupBy("employee_id")
        .agg(
            F.count(F.lit(1)).alias("slips"),
            F.sum("gross_salary").alias("gross"),
            F.sum("net_salary").alias("net"),
        )
    )
    joined = lookup(employees_with_department(ds), slips, "employee_id")
    # An employee without slips still appears once.
    weight = F.coalesce(F.col("slips"), F.lit(1))
    paid = F.col("salary").isNotNull()
    return (
        joined.groupBy("dept_name")
        .agg(
            F.count_distinct("employee_id").alias("headcount"),
            ratio(
                F.sum(F.col("salary") * weight), F.sum(F.when(paid, weight))
            ).alias("average_salary"),
            sql_total("gross").alias("gross_payroll"),
            sql_total("net").alias("net_payroll"),
        )
        .orderBy(F.col("gross_payroll").desc_nulls_last(), "dept_name")
    )


def attendance_by_department(ds: Dataset) -> DataFrame:
    """Recorded attendance of known employees; hours and rate rounded to two places."""
    staff = employees_with_department(ds).select("employee_id", "dept_name")
    records = ds.table("attendance").withColumn(
        "worked_seconds", seconds_between("check_in", "check_out")
    )
    return (
        records.join(staff, "employee_id")
        .groupBy("dept_name")
        .agg(
            F.count_distinct("attendance_id").alias("attendance_records"),
            F.round(mean_hours("worked_seconds"), 2).alias("average_worked_hours"),
            F.round(share(F.col("check_out").isNull()), 2).alias("missing_checkout_rate_pct"),
        )
        .orderBy(F.col("average_worked_hours").desc_nulls_first(), "dept_name")
    )
