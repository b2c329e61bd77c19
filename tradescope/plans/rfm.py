"""Recency-frequency-monetary segmentation of customers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradescope.dataset import Dataset
from tradescope.functions.exprs import (
    days_between_dates,
    percent,
    ratio,
    score_1_to_5,
    seconds_between,
    total,
    whole_days,
)
from tradescope.operators.filters import valid_orders
from tradescope.operators.ranking import position_in_group
from tradescope.operators.selection import FEW, decimal_keys, select_places
from tradescope.operators.staging import stage_once

# Segment names.
CHAMPIONS, LOYAL, AT_RISK = "Champions", "Loyal", "At-Risk Valuable"
NEEDS_ATTENTION, OTHERS = "Needs Attention", "Others"

RFM_COLUMNS = [
    "cust_id", "last_order", "frequency", "monetary", "recency_days",
    "r_score", "f_score", "m_score", "rfm_total", "segment", "clv_proxy",
]


def customer_values(sales: DataFrame, one_row_per_order: bool = False) -> DataFrame:
    """Last order, distinct orders and spend per customer, the unknown one included.

    With ``one_row_per_order`` rows are counted, which moves no order ids.
    """
    count = F.count if one_row_per_order else F.count_distinct
    return sales.groupBy("cust_id").agg(
        F.max("order_date").alias("last_order"),
        count("order_id").alias("frequency"),
        F.sum("net_amount").alias("monetary"),
    )


_MEASURES = {"r": "recency_days", "f": "frequency", "m": "monetary"}
_PARTS = ("_v0", "_v1", "_v2")


def _share(measure: str, position: Column, size: Column) -> Column:
    """Rank share of a position among ``size``: recent, frequent and valuable customers come last."""
    return F.lit(1.0) - ratio(position, size) if measure == "r" else ratio(position, size)


def _cut_place(cut: int, measure: str, size: int) -> Column:
    """How many customers, counted from the least value, stand on the near side of a cut.

    For recency these are the ones scored at least ``6 - cut``, for the others those scored
    at most ``cut``.  Rounding moves a cut by less than the two places looked at around it.
    """

    def near(position: Column) -> Column:
        score = score_1_to_5(_share(measure, position, F.lit(size)))
        return score >= 6 - cut if measure == "r" else score <= cut

    middle = int((cut - 0.5 if measure == "r" else cut + 0.5) / 5 * size)
    around = [F.lit(p).cast("long") for p in range(max(1, middle - 2), min(size, middle + 2) + 1)]
    return F.coalesce(F.array_max(F.filter(F.array(*around), near)), F.lit(0)) if around else F.lit(0)


def _scores(customers: DataFrame, sizes: dict[str, int], few: int, bits: int) -> dict[str, Column]:
    """The three scores of a row of ``customers``, from exact positions by (value, cust_id).

    A score asks only whether a customer stands beyond four cuts of the order, so the
    (value, cust_id) at each cut is found by counting, and every customer is compared with
    these twelve rows.  ``customers`` has the parts of its measures (``decimal_keys``) beside
    them; ``sizes`` has the number of customers that each measure is ranked among.
    """
    measures = F.array(
        *[F.struct(F.lit(m).alias("measure"), *[F.col(f"{m}{p}").alias(p) for p in _PARTS]) for m in _MEASURES]
    )
    id_key = F.col("cust_id").cast("long").alias("_id")
    long = customers.select(id_key, F.inline(measures)).where(F.col("_v0").isNotNull())
    wanted = {}
    for cut in range(1, 5):
        recent, often, much = (_cut_place(cut, m, sizes[m]) - F.lit(1) for m in _MEASURES)
        wanted[str(cut)] = F.when(F.col("measure") == "r", recent).when(F.col("measure") == "f", often).otherwise(much)
    keys = [*_PARTS, "_id"]
    found = select_places(long, ["measure"], keys, wanted, few, bits).collect()
    scores = {}
    for m in _MEASURES:
        # Before a cut without customers everyone is beyond it; nobody is beyond the last one's.
        passed = F.lit(sum(row.measure == m and row.place < 0 for row in found))
        own = F.struct(*[F.col(f"{m}{p}").alias(p) for p in _PARTS], id_key)
        for row in found:
            if row.measure == m and 0 <= row.place < row["_n"] - 1:
                cut = F.struct(*[F.lit(row[k]).cast("long").alias(k) for k in keys])
                passed += (own > cut).cast("int")
        score = F.lit(5) - passed if m == "r" else F.lit(1) + passed
        scores[f"{m}_score"] = F.when(F.col(f"{m}{_PARTS[0]}").isNotNull(), score)
    return scores


def _scores_by_position(customers: DataFrame, sizes: dict[str, int], slots: int | None) -> DataFrame:
    """The scores of customers whose ids are no integers, by the position of every row.

    The three measures become rows of one narrow table, so all positions come out of a
    single range shuffle; a value shared by many customers is cut by ``cust_id``.
    """
    measures = F.array(
        *[
            F.struct(F.lit(m).alias("measure"), F.col(c).cast("decimal(38,8)").alias("value"))
            for m, c in _MEASURES.items()
        ]
    )
    long = customers.select("cust_id", F.inline(measures)).where(F.col("value").isNotNull())
    placed = position_in_group(long, ["measure"], ["value", "cust_id"], slots=slots)

    def position(measure: str) -> Column:
        return F.max(F.when(F.col("measure") == measure, F.col("position")))

    ranked = placed.groupBy("cust_id").agg(*[position(m).alias(m) for m in _MEASURES])
    return ranked.select(
        "cust_id", *[score_1_to_5(_share(m, F.col(m), F.lit(sizes[m]))).alias(f"{m}_score") for m in _MEASURES]
    )


def _segment() -> Column:
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return (
        F.when((r >= 4) & (f >= 4) & (m >= 4), CHAMPIONS)
        .when((r >= 3) & (f >= 3), LOYAL)
        .when((r <= 2) & (m >= 4), AT_RISK)
        .when((r <= 2) & (f <= 2), NEEDS_ATTENTION)
        .otherwise(OTHERS)
    )


def rfm_segments(
    fact: DataFrame, slots: int | None = None, by_monetary: bool = False, few: int = FEW, bits: int = 16,
    one_row_per_order: bool = False,
) -> DataFrame:
    """Scores 1..5 by rank share, segment and lifetime-value proxy per customer.

    ``by_monetary`` sorts the customers by spend, the largest first.  Cuts between scores are
    found by counting (``few`` and ``bits`` as in ``select_places``) where customer ids are
    integers; other ids are put in order, in ``slots`` ranges.

    The per-customer values are staged, because they are read three times and cost the
    fact's shuffle.  A customer without an order date gets no recency score.
    """
    values = stage_once(customer_values(fact, one_row_per_order), "customers")
    known = F.col("cust_id").isNotNull()
    # What the customers are measured against.  Orders without a customer still move the
    # reference date.
    overall = values.agg(
        F.struct(F.max("last_order").alias("latest"), F.max(F.when(known, F.col("frequency"))).alias("most_orders")).alias("overall")
    ).scalar()
    dated = F.count_if(known & F.col("last_order").isNotNull())
    counted = values.agg(dated.alias("dated"), F.count_if(known).alias("customers")).first()
    sizes = {"r": counted.dated, "f": counted.customers, "m": counted.customers}
    customers = values.where(known).withColumn(
        "recency_days", whole_days(seconds_between("last_order", overall["latest"]))
    )
    most_orders = F.greatest(overall["most_orders"], F.lit(1))
    weight = F.lit(1.0) + F.col("frequency") / most_orders.cast("double")
    if isinstance(customers.schema["cust_id"].dataType, T.IntegralType):
        parts = {f"{m}{p}": c for m, v in _MEASURES.items() for p, c in zip(_PARTS, decimal_keys(v), strict=True)}
        customers = customers.withColumns(parts)
        scored = customers.withColumns(_scores(customers, sizes, few, bits))
    else:
        scored = customers.join(_scores_by_position(customers, sizes, slots), "cust_id", "left")
    segments = scored.select(
        "cust_id",
        "last_order",
        "frequency",
        F.col("monetary").cast("double").alias("monetary"),
        "recency_days",
        "r_score",
        "f_score",
        "m_score",
        (F.col("r_score") + F.col("f_score") + F.col("m_score")).alias("rfm_total"),
        _segment().alias("segment"),
        (F.col("monetary").cast("double") * weight).alias("clv_proxy"),
    )
    if by_monetary:
        return segments.orderBy(F.col("monetary").desc_nulls_last(), "cust_id")
    return segments


def segment_counts(rfm: DataFrame) -> DataFrame:
    return rfm.groupBy("segment").agg(F.count_distinct("cust_id").alias("customers"))


def segment_summary(rfm: DataFrame) -> DataFrame:
    exact = "decimal(38,6)"
    return (
        rfm.groupBy("segment")
        .agg(
            F.count_distinct("cust_id").alias("customers"),
            total(F.col("monetary").cast(exact)).alias("monetary"),
            total(F.col("clv_proxy").cast(exact)).alias("clv_proxy"),
        )
        .orderBy(F.col("monetary").desc(), "segment")
    )


def repeat_purchase_rate(customers: DataFrame) -> DataFrame:
    """Share of customers with more than one order, as one row."""
    repeat = F.count_if(F.col("frequency") > 1)
    return customers.agg(percent(repeat, F.count(F.lit(1))).alias("repeat_purchase_rate_pct"))


def at_risk_customers(rfm: DataFrame) -> DataFrame:
    return rfm.agg(F.count_if(F.col("segment") == AT_RISK).alias("at_risk_customers"))


def rfm_base(ds: Dataset) -> DataFrame:
    """The SQL report's customer table: every group counts, the null customer too."""
    orders = valid_orders(ds.table("orders")).select("order_id", "cust_id", "order_date")
    items = ds.table("order_items").select("order_id", "net_amount")
    values = stage_once(customer_values(items.join(orders, "order_id")), "customers")
    latest = values.agg(F.max("last_order").alias("latest")).select("latest").scalar()
    return values.select(
        "cust_id",
        days_between_dates("last_order", latest).cast("long").alias("recency_days"),
        "frequency",
        F.col("monetary").cast("double").alias("monetary"),
    ).orderBy(F.col("monetary").desc_nulls_first(), "cust_id")
