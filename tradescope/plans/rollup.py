"""The sales fact rolled up once, for everything that only adds it up.

Sums and latest dates of the fact can be added up in two steps, and distinct orders can be
counted from rows of one order each.  So one GROUPING SETS aggregate (orders with their
month, region and customer; products; categories) stands for the fact in every sentence,
card and frame, and the join below it is computed once and never staged at item grain.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradescope.operators.prints import count_prints, fingerprint
from tradescope.operators.staging import stage_once

# What an order, a product and a category row say about themselves.
_ORDER = ("order_id", "month", "region_name", "cust_id")
_NAMES = ("product_name", "category_name")
_MEASURES = {"quantity": F.sum, "net_amount": F.sum, "cost": F.sum, "order_date": F.max}


@dataclass(frozen=True)
class SalesRollup:
    """Frames that take the fact's place where only sums, latest dates and distinct orders are read.

    ``orders`` has one row per order (and month, region and customer, should an order have
    several), with their columns; ``products`` and ``categories`` one per name, or None where
    the fact does not have the name.  All carry quantity, net_amount, cost and order_date, as far
    as the fact has them.  A fact without order ids has ``orders`` by the other columns alone.
    """

    orders: DataFrame
    products: DataFrame | None
    categories: DataFrame | None

    @cached_property
    def one_row_per_order(self) -> bool:
        """Whether no order id is on several rows of ``orders``, so that counting rows counts orders.

        Looked up once, by fingerprints; two orders of one fingerprint would only count as not so.
        """
        if "order_id" not in self.orders.columns:
            return False
        prints = self.orders.where("order_id IS NOT NULL").select(
            F.lit(0).alias("_table"), fingerprint(F.xxhash64("order_id")).alias("_print"), F.lit(0).cast("long").alias("_nulls")
        )
        return not count_prints(prints).agg(F.count("_print").alias("several")).first().several


def sales_rollup(fact: DataFrame) -> SalesRollup:
    """Roll the fact up and write the result down; the fact is read once.

    Items of one order, product or category are added up before they travel, so a hot one is
    a single row a task.  Sums stay decimals.
    """
    order = [c for c in _ORDER if c in fact.columns]
    names = [c for c in _NAMES if c in fact.columns]
    sets = [[F.col(c) for c in order], *([F.col(n)] for n in names)]
    keys = [F.col(c) for c in (*order, *names)]
    measures = [m for m in _MEASURES if m in fact.columns]
    rolled = fact.groupingSets(sets, *keys).agg(
        F.grouping_id().alias("_set"), *[_MEASURES[m](m).alias(m) for m in measures]
    )
    staged = stage_once(rolled, "sales_rollup")
    # A bit for every key that is not in the set, the first key's the highest.
    width = len(order) + len(names)
    everything = (1 << width) - 1

    def of(columns: list[str]) -> DataFrame:
        held = sum(1 << (width - 1 - [*order, *names].index(c)) for c in columns)
        return staged.where(F.col("_set") == everything - held).select(*columns, *measures)

    by_name = {n: of([n]) for n in names}
    return SalesRollup(of(order), by_name.get("product_name"), by_name.get("category_name"))
