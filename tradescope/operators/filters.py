"""Business filters, written so that they reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradescope.dataset import Dataset
from tradescope.functions.exprs import NTZ

# Order states that count as a sale.
VALID_ORDER_STATUSES = ("Delivered", "Shipped", "Out for Delivery", "Processing")


@dataclass(frozen=True)
class Filters:
    """Selections of a dashboard run; an empty list means no restriction."""

    years: Sequence[int] = field(default_factory=tuple)
    categories: Sequence[str] = field(default_factory=tuple)
    products: Sequence[str] = field(default_factory=tuple)
    regions: Sequence[str] = field(default_factory=tuple)
    states: Sequence[str] = field(default_factory=tuple)
    stores: Sequence[str] = field(default_factory=tuple)
    platforms: Sequence[str] = field(default_factory=tuple)
    shipment_statuses: Sequence[str] = field(default_factory=tuple)
    warehouse_regions: Sequence[str] = field(default_factory=tuple)


def valid_orders(orders: DataFrame) -> DataFrame:
    return where_in(orders, "order_status", VALID_ORDER_STATUSES)


def where_in(df: DataFrame, column: str, selected: Iterable) -> DataFrame:
    selected = list(selected or ())
    if not selected or column not in df.columns:
        return df
    return df.where(F.col(column).isin(selected))


def _year_runs(years: Iterable[int]) -> list[tuple[int, int]]:
    """Consecutive years merged into [first, last + 1) ranges."""
    runs: list[tuple[int, int]] = []
    for year in sorted(set(years)):
        if runs and runs[-1][1] == year:
            runs[-1] = (runs[-1][0], year + 1)
        else:
            runs.append((year, year + 1))
    return runs


def in_years(column: Column, dtype: T.DataType, years: Iterable[int]) -> Column:
    """Date ranges rather than ``year(column)``, so row groups can be skipped."""
    if isinstance(dtype, T.StringType):
        column, type_name = column.try_cast(NTZ), NTZ
    else:
        type_name = dtype.simpleString()

    def start_of(year: int) -> Column:
        return F.lit(f"{year:04d}-01-01").cast(type_name)

    ranges = [(column >= start_of(a)) & (column < start_of(b)) for a, b in _year_runs(years)]
    return reduce(or_, ranges)


def by_years(df: DataFrame, date_columns: Sequence[str], years: Iterable[int] | None) -> DataFrame:
    """Keep the years by the first of ``date_columns`` the table has; null dates drop out."""
    years = list(years or ())
    present = [c for c in date_columns if c in df.columns]
    if not years or not present:
        return df
    name = present[0]
    return df.where(in_years(F.col(name), df.schema[name].dataType, years))


def filter_sales(fact: DataFrame, filters: Filters) -> DataFrame:
    df = by_years(fact, ["order_date"], filters.years)
    for column, selected in (
        ("category_name", filters.categories),
        ("product_name", filters.products),
        ("region_name", filters.regions),
        ("state", filters.states),
        ("store_name", filters.stores),
    ):
        df = where_in(df, column, selected)
    return df


def available_values(df: DataFrame, column: str, label: str) -> DataFrame:
    """Distinct non-null values of a column as (filter, value) text rows."""
    return (
        df.where(F.col(column).isNotNull())
        .select(F.lit(label).alias("filter"), F.col(column).cast("string").alias("value"))
        .distinct()
    )


def filter_options(ds: Dataset, fact: DataFrame) -> DataFrame:
    """Every choice the nine filters offer, long form, sorted.

    The five fact columns are unpivoted first, so the fact is read once for all of them.
    """
    labels = {
        "category_name": "categories",
        "product_name": "products",
        "region_name": "regions",
        "state": "states",
        "store_name": "stores",
    }
    choices = [
        F.struct(F.lit(label).alias("filter"), F.col(c).cast("string").alias("value"))
        for c, label in labels.items()
        if c in fact.columns
    ]
    if "order_date" in fact.columns:
        year = F.year(F.col("order_date").cast("date")).cast("string")
        choices.append(F.struct(F.lit("years").alias("filter"), year.alias("value")))
    options = (
        fact.select(F.inline(F.array(*choices))).where(F.col("value").isNotNull()).distinct()
    )
    for key, column, label in (
        ("ads_spend", "platform", "platforms"),
        ("sales_shipments", "status", "shipment_statuses"),
        ("warehouses", "region", "warehouse_regions"),
    ):
        if key in ds and column in ds[key].columns:
            options = options.unionByName(available_values(ds[key], column, label))
    return options.orderBy("filter", "value")
