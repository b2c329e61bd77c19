"""Finance results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradescope.dataset import Dataset, Results
from tradescope.functions.exprs import month_start, percent, sql_total, total, with_numbers
from tradescope.operators.filters import by_years
from tradescope.operators.joins import lookup, lookup_table
from tradescope.plans.sales import monthly_revenue_profit, monthly_sales

_EXACT = "decimal(38,4)"


def expenses_in_scope(ds: Dataset, years: Sequence[int] | None = None) -> DataFrame:
    return with_numbers(by_years(ds.table("finance_expenses"), ["expense_date"], years), ["amount"])


def expense_categories(ds: Dataset, expenses: DataFrame) -> DataFrame:
    """Expense per category, added up per id before the name is looked up."""
    if not ds.has_rows("expense_category") or "exp_cat_id" not in expenses.columns:
        key = "category_name" if "category_name" in expenses.columns else "exp_cat_id"
        named = expenses
    else:
        per_id = expenses.groupBy("exp_cat_id").agg(F.sum("amount").alias("amount"))
        named = lookup_table(per_id, ds, "expense_category", "exp_cat_id", ["category_name"])
        key = "category_name" if "category_name" in named.columns else "exp_cat_id"
    return (
        named.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(total("amount").alias("expense"))
        .orderBy(F.col("expense").desc(), key)
    )


def monthly_expenses(expenses: DataFrame) -> DataFrame:
    return (
        expenses.withColumn("month", month_start("expense_date"))
        .where(F.col("month").isNotNull())
        .groupBy("month")
        .agg(total("amount").alias("opex"))
    )


def profit_and_loss(fact: DataFrame, opex: DataFrame | None) -> DataFrame:
    """Monthly sales with operating expense, EBITDA proxy and cost-to-revenue ratio."""
    pnl = monthly_sales(fact)
    if opex is None:
        pnl = pnl.withColumn("opex", F.lit(0.0))
    else:
        pnl = lookup(pnl, opex, "month").fillna({"opex": 0.0})
    return pnl.withColumns(
        {
            "ebitda_proxy": F.col("profit") - F.col("opex"),
            "cost_to_revenue_pct": percent(F.col("opex"), F.col("revenue")),
        }
    ).orderBy("month")


def _status_column(payments: DataFrame) -> str:
    return "status" if "status" in payments.columns else payments.columns[-1]


def payment_status(ds: Dataset) -> DataFrame:
    payments = ds.table("finance_payments")
    key = _status_column(payments)
    return (
        payments.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count_distinct("payment_id").alias("payment_count"),
            total("amount").alias("amount"),
        )
    )


def refund_reasons(ds: Dataset) -> DataFrame:
    payments = ds.table("finance_payments")
    key = "refund_reason" if "refund_reason" in payments.columns else _status_column(payments)
    return (
        payments.where(F.col("refunded_at").isNotNull() & F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count_distinct("payment_id").alias("refund_count"),
            total("amount").alias("refund_value"),
        )
        .orderBy(F.col("refund_value").desc(), key)
    )


def refund_log(ds: Dataset, years: Sequence[int] | None = None) -> DataFrame:
    log = by_years(ds.table("refund_log"), ["refunded_at"], years)
    return (
        log.where(F.col("reason").isNotNull())
        .groupBy("reason")
        .agg(
            F.count_distinct("refund_id").alias("refund_count"),
            total("amount").alias("refund_value"),
        )
        .orderBy(F.col("refund_value").desc(), "reason")
    )


def finance_results(
    ds: Dataset, fact: DataFrame, years: Sequence[int] | None = None
) -> Results:
    results: dict[str, Callable[[], DataFrame]] = {}
    expenses = expenses_in_scope(ds, years) if "finance_expenses" in ds else None
    opex = monthly_expenses(expenses) if expenses is not None else None
    if expenses is not None:
        results["expense_categories"] = lambda: expense_categories(ds, expenses)
        results["monthly_expenses"] = lambda: opex
    results["pnl"] = lambda: profit_and_loss(fact, opex)
    if "finance_payments" in ds:
        results["payment_status"] = lambda: payment_status(ds)
        if "refunded_at" in ds["finance_payments"].columns:
            results["refund_reasons"] = lambda: refund_reasons(ds)
    if "refund_log" in ds:
        results["refund_log"] = lambda: refund_log(ds, years)
    return Results(results)


def finance_cards(opex: DataFrame, fact: DataFrame, refunds: DataFrame) -> DataFrame:
    """Operating expense, EBITDA proxy, cost-to-revenue and refund value, as one row.

    All but the refunds follow from one monthly aggregate of the fact.  Sales without a
    month count as revenue but not in the EBITDA proxy, months without sales only as
    expense.
    """

    def exact(value: Column) -> Column:
        return total(value.cast(_EXACT))

    sold = monthly_revenue_profit(fact).withColumn("sold", F.lit(True))
    margin = F.when(
        F.col("sold") & F.col("month").isNotNull(),
        F.col("profit") - F.coalesce("opex", F.lit(0.0)),
    )
    returned = refunds.agg(exact(F.col("refund_value")).alias("v")).select("v").scalar()
    return sold.join(opex, "month", "full_outer").agg(
        exact(F.col("opex")).alias("opex"),
        exact(margin).alias("ebitda_proxy"),
        exact(F.col("revenue")).alias("revenue"),
    ).withColumn("refund_value", returned).select(
        "opex",
        "ebitda_proxy",
        percent(F.col("opex"), F.col("revenue")).alias("cost_to_revenue_pct"),
        "refund_value",
    )


# --- SQL reports -------------------------------------------------------------------------


def expense_totals(ds: Dataset) -> DataFrame:
    """Expense per category; expenses without a known category form their own group."""
    per_id = ds.table("finance_expenses").groupBy("exp_cat_id").agg(F.sum("amount").alias("amount"))
    return (
        lookup_table(per_id, ds, "expense_category", "exp_cat_id", ["category_name"])
        .groupBy("category_name")
        .agg(sql_total("amount").alias("total_expense"))
        .orderBy(F.col("total_expense").desc_nulls_first(), "category_name")
    )


def refund_totals(ds: Dataset) -> DataFrame:
    return (
        ds.table("refund_log")
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("refund_count"), sql_total("amount").alias("refund_value"))
        .orderBy(F.col("refund_value").desc_nulls_first(), "reason")
    )
