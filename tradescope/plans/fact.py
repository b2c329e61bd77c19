"""The product dimension and the sales fact at order-item grain."""

from __future__ import annotations

from collections.abc import Collection, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradescope.dataset import Dataset
from tradescope.functions.exprs import month_start, percent, with_numbers
from tradescope.operators.filters import valid_orders
from tradescope.operators.joins import lookup, lookup_table
from tradescope.registry import MONEY

# Order columns that the fact carries, and the columns filled with zero.
ORDER_COLUMNS = [
    "order_id", "cust_id", "store_id", "order_date", "order_status",
    "gross_total", "discount_amount", "net_total", "payment_mode_id",
]
ZERO_FILLED = ["quantity", "net_amount", "cost_price", "gross_amount", "item_discount_amount"]


DIMENSIONS = ("brand", "category", "stores", "region")


def product_dimension(ds: Dataset, dimensions: Collection[str] = DIMENSIONS) -> DataFrame:
    """Products with their brand and category; the category may hang off the brand."""
    products = ds.table("products")
    # The brand is also the way to a category the product row itself does not name.
    if "brand" in dimensions or ("category" in dimensions and "category_id" not in products.columns):
        products = lookup_table(products, ds, "brand", "brand_id", suffix="_brand")
    if "category" in dimensions:
        products = lookup_table(products, ds, "category", "category_id", suffix="_category")
    return products


def categorised_products(ds: Dataset) -> DataFrame:
    """Products whose brand and category are both known (the SQL reports' inner chain)."""
    products, brands = ds.table("products"), ds.table("brand")
    if "category_id" in brands.columns:
        products = products.drop("category_id")
        brands = brands.select("brand_id", "category_id")
    else:
        brands = brands.select("brand_id")
    categories = ds.table("category").select("category_id", "category_name")
    return products.join(brands, "brand_id").join(categories, "category_id")


def _item_side(ds: Dataset, dimensions: Collection[str]) -> DataFrame:
    """Order items with their product; an unknown product leaves its columns null."""
    items = ds.table("order_items").withColumnRenamed("discount_amount", "item_discount_amount")
    if "products" not in ds or "prod_id" not in items.columns:
        return items
    products = product_dimension(ds, dimensions)
    return lookup(items, products, "prod_id", suffix="_product", right_key="product_id")


def _order_side(ds: Dataset, dimensions: Collection[str], taken: list[str]) -> DataFrame:
    """Valid orders with their store and region; names the items use get a suffix."""
    orders = valid_orders(ds.table("orders"))
    orders = orders.select(*[c for c in ORDER_COLUMNS if c in orders.columns])
    orders = orders.withColumnRenamed("discount_amount", "order_discount_amount")
    if "order_date" in orders.columns:
        # Here rather than on the items, of which there are several per order.
        orders = orders.withColumn("month", month_start("order_date"))
    if "stores" in dimensions or "region" in dimensions:
        orders = lookup_table(orders, ds, "stores", "store_id", suffix="_store", taken=taken)
    if "region" in dimensions:
        orders = lookup_table(orders, ds, "region", "region_id", suffix="_region", taken=taken)
    own = ("order_id", "month")
    clashes = {c: f"{c}_order" for c in orders.columns if c in taken and c not in own}
    return orders.withColumnsRenamed(clashes)


def _amount(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(0).cast(MONEY)


def sales_fact(ds: Dataset, dimensions: Collection[str] = DIMENSIONS) -> DataFrame:
    """Items of valid orders with product, store and region attributes.

    Every lookup happens on the side that owns its key, and items meet orders last.  The
    fact therefore leaves this function partitioned by order, and a distinct count of
    orders per group needs no second shuffle of the items.  An item whose product is
    unknown keeps its revenue and gets cost zero.  ``dimensions`` names the lookups that
    are wanted beside the product itself; leaving out unused ones saves their joins.
    """
    items = _item_side(ds, dimensions).drop("month")
    fact = items.join(_order_side(ds, dimensions, items.columns), "order_id")
    fact = with_numbers(fact, ZERO_FILLED)
    cost = _amount(fact, "quantity") * _amount(fact, "cost_price")
    profit = _amount(fact, "net_amount") - cost
    return fact.withColumns(
        {
            "cost": cost,
            "profit": profit,
            "profit_margin_pct": percent(profit, _amount(fact, "net_amount")),
        }
    )


def sales_fact_of_parts(parts: Iterable[Dataset], dimensions: Collection[str] = DIMENSIONS) -> DataFrame:
    """The fact of orders and items that are stored in parts, each order in one part whole.

    Every part is joined by itself: bucketed rows without a shuffle, those of hot orders with a
    small order table that Spark broadcasts by its size or splits as skewed.
    """
    facts = [sales_fact(part, dimensions) for part in parts]
    return reduce(DataFrame.unionByName, facts)


def inner_sales(
    ds: Dataset, products: DataFrame | None = None, places: DataFrame | None = None
) -> DataFrame:
    """The narrow fact of the SQL reports: items whose product is unknown are left out.

    With ``places`` (by store_id), orders of unknown stores are left out as well.
    """
    if products is None:
        products = ds.table("products")
    orders = valid_orders(ds.table("orders"))
    orders = orders.select("order_id", "cust_id", "store_id", "order_date")
    if places is not None:
        orders = orders.join(places, "store_id")
    items = ds.table("order_items").select("order_id", "prod_id", "quantity", "net_amount")
    priced = items.join(products.withColumnRenamed("product_id", "prod_id"), "prod_id")
    return priced.join(orders, "order_id").withColumn(
        "cost", F.col("quantity") * F.col("cost_price")
    )
