"""Operations and logistics results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradescope.dataset import Dataset, Results
from tradescope.functions.exprs import (
    RATE,
    days_between_dates,
    mean,
    mean_days,
    mean_rate,
    numeric,
    percent,
    percent_2dp,
    ratio,
    seconds_between,
    share,
    sql_total,
    total,
    with_numbers,
)
from tradescope.operators.filters import by_years, where_in
from tradescope.operators.joins import lookup, lookup_table, named_by
from tradescope.operators.selection import group_percentile
from tradescope.plans.fact import categorised_products, product_dimension

# Fixed value: lowest HTTP status that counts as an error.
ERROR_STATUS = 400


def _known(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull())


def _shipments(ds: Dataset, key: str, years: Sequence[int] | None) -> DataFrame:
    return by_years(ds.table(key), ["shipped_date", _END_DATE[key]], years)


_END_DATE = {"sales_shipments": "delivered_date", "inbound_shipments": "arrival_date"}


def inventory_positions(ds: Dataset) -> DataFrame:
    """Inventory rows with product attributes, reorder flag and value."""
    rows = ds.table("inventory")
    if "products" in ds:
        details = ["product_name", "category_name", "cost_price"]
        rows = lookup(rows, product_dimension(ds), "product_id", details)
    rows = with_numbers(rows, ["quantity_on_hand", "reorder_level"])
    price = numeric(rows, "cost_price") if "cost_price" in rows.columns else F.lit(0)
    return rows.withColumns(
        {
            "below_reorder": F.col("quantity_on_hand") < F.col("reorder_level"),
            "inventory_value": F.col("quantity_on_hand") * price,
        }
    )


def inventory_risk(ds: Dataset) -> DataFrame:
    """Inventory by value, ties by product and store, so that many equal values still spread."""
    rows = inventory_positions(ds)
    ties = [c for c in ("product_id", "store_id") if c in rows.columns]
    return rows.orderBy(F.col("inventory_value").desc_nulls_last(), *ties)


def inventory_by_category(ds: Dataset) -> DataFrame:
    return (
        _known(inventory_positions(ds), "category_name")
        .groupBy("category_name")
        .agg(
            total("quantity_on_hand").alias("inventory_units"),
            total("inventory_value").alias("inventory_value"),
            F.count_if("below_reorder").alias("below_reorder_skus"),
        )
    )


def outbound_shipments(
    ds: Dataset, years: Sequence[int] | None = None, statuses: Sequence[str] | None = None
) -> DataFrame:
    shipments = where_in(_shipments(ds, "sales_shipments", years), "status", statuses)
    return shipments.withColumn(
        "delivery_seconds", seconds_between("shipped_date", "delivered_date")
    )


def _delivery_by(outbound: DataFrame, key: str) -> DataFrame:
    return (
        _known(outbound, key)
        .groupBy(key)
        .agg(
            F.count_distinct("shipment_id").alias("shipments"),
            mean_days("delivery_seconds").alias("avg_delivery_days"),
        )
    )


def outbound_status(outbound: DataFrame) -> DataFrame:
    return _delivery_by(outbound, "status")


def courier_performance(outbound: DataFrame) -> DataFrame:
    return _delivery_by(outbound, "courier_name").orderBy(
        F.col("shipments").desc(), "courier_name"
    )


def inbound_in_scope(
    ds: Dataset,
    years: Sequence[int] | None = None,
    warehouse_regions: Sequence[str] | None = None,
    with_warehouse: bool = True,
) -> DataFrame:
    """Inbound shipments with lead time and, unless nobody asks for them, warehouse attributes."""
    inbound = _shipments(ds, "inbound_shipments", years)
    if with_warehouse or warehouse_regions:
        details = ["name", "region", "capacity_sqft"]
        inbound = lookup_table(inbound, ds, "warehouses", "warehouse_id", details)
        inbound = where_in(inbound, "region", warehouse_regions)
    return inbound.withColumn("lead_seconds", seconds_between("shipped_date", "arrival_date"))


def supplier_lead_time(ds: Dataset, inbound: DataFrame) -> DataFrame:
    named = named_by(inbound, ds, "suppliers", "supplier_id", ["supplier_name"])
    key = "supplier_name" if "supplier_name" in named.columns else "supplier_id"
    return (
        _known(named, key)
        .groupBy(key)
        .agg(
            total("quantity").alias("inbound_units"),
            mean_days("lead_seconds").alias("avg_lead_days"),
            F.count_distinct("shipment_id").alias("shipments"),
        )
        .orderBy(F.col("avg_lead_days").asc_nulls_last(), key)
    )


def warehouse_flow(inbound: DataFrame) -> DataFrame:
    """Units and mean lead time per region of shipments that already know their warehouse."""
    return (
        _known(inbound, "region")
        .groupBy("region")
        .agg(
            total("quantity").alias("inbound_units"),
            mean_days("lead_seconds").alias("avg_lead_days"),
        )
    )


def region_flow(
    ds: Dataset, years: Sequence[int] | None = None, warehouse_regions: Sequence[str] | None = None
) -> DataFrame:
    """Units and mean lead time per warehouse region, added up per warehouse before the lookup."""
    inbound = _shipments(ds, "inbound_shipments", years).withColumn(
        "lead_seconds", seconds_between("shipped_date", "arrival_date")
    )
    per_warehouse = inbound.groupBy("warehouse_id").agg(
        F.sum("quantity").alias("quantity"),
        F.sum("lead_seconds").alias("lead_seconds"),
        F.count("lead_seconds").alias("timed"),
    )
    placed = lookup_table(per_warehouse, ds, "warehouses", "warehouse_id", ["region"])
    return (
        _known(where_in(placed, "region", warehouse_regions), "region")
        .groupBy("region")
        .agg(
            total("quantity").alias("inbound_units"),
            (ratio(F.sum("lead_seconds"), F.sum("timed")) / F.lit(86400.0)).alias("avg_lead_days"),
        )
    )


def production_quality(ds: Dataset, years: Sequence[int] | None = None) -> DataFrame:
    """Output per line with the mean of the work orders' own rejection and yield rates."""
    orders = by_years(ds.table("work_orders"), ["start_timestamp"], years)
    produced, rejected = F.col("quantity_produced"), F.col("rejected_quantity")
    rates = {
        "rejection": percent(rejected, produced).cast(RATE),
        "yield": percent(produced - rejected, produced).cast(RATE),
    }
    # Added up per line id before the line's name is looked up.
    sums = [F.sum(c).alias(name) for name, c in rates.items()]
    counts = [F.count(c).alias(f"{name}_n") for name, c in rates.items()]
    per_line = orders.groupBy("line_id").agg(
        F.sum(produced).alias("made"), F.sum(rejected).alias("bad"), *sums, *counts
    )
    named = named_by(per_line, ds, "production_lines", "line_id", ["line_name"])
    key = "line_name" if "line_name" in named.columns else "line_id"
    return (
        _known(named, key)
        .groupBy(key)
        .agg(
            total("made").alias("produced"),
            total("bad").alias("rejected"),
            ratio(F.sum("rejection"), F.sum("rejection_n")).alias("rejection_rate_pct"),
            ratio(F.sum("yield"), F.sum("yield_n")).alias("yield_pct"),
        )
        .orderBy(F.col("produced").desc(), key)
    )


def api_health(
    ds: Dataset, years: Sequence[int] | None = None, approximate: bool = False
) -> DataFrame:
    """Requests, error share and 95th percentile latency per endpoint.

    The percentile is exact, found by counting; ``approximate`` trades its passes over the
    latencies for a bounded sketch.
    """
    requests = _known(by_years(ds.table("api_requests"), ["timestamp"], years), "endpoint")
    failed = F.coalesce(F.col("status_code").try_cast("long") >= ERROR_STATUS, F.lit(False))
    measures = [
        F.count_distinct("request_id").alias("requests"),
        share(failed).alias("error_rate_pct"),
    ]
    latency = F.col("response_time_ms").try_cast("double")
    timed = requests.withColumn("response_time_ms", latency)
    if approximate:
        measures.append(
            F.percentile_approx("response_time_ms", 0.95, 10_000).alias("p95_latency_ms")
        )
        return timed.groupBy("endpoint").agg(*measures)
    p95 = group_percentile(timed, "endpoint", "response_time_ms", 0.95, "p95_latency_ms")
    return timed.groupBy("endpoint").agg(*measures).join(p95, "endpoint", "left")


def operations_results(
    ds: Dataset,
    years: Sequence[int] | None = None,
    shipment_statuses: Sequence[str] | None = None,
    warehouse_regions: Sequence[str] | None = None,
) -> Results:
    results: dict[str, Callable[[], DataFrame]] = {}
    if "inventory" in ds:
        results["inventory_risk"] = lambda: inventory_risk(ds)
        if "category_name" in inventory_positions(ds).columns:
            results["inventory_by_category"] = lambda: inventory_by_category(ds)
    if "sales_shipments" in ds:
        outbound = outbound_shipments(ds, years, shipment_statuses)
        results["outbound_status"] = lambda: outbound_status(outbound)
        results["courier"] = lambda: courier_performance(outbound)
    if "inbound_shipments" in ds:
        inbound = inbound_in_scope(ds, years, warehouse_regions)
        results["supplier_lead"] = lambda: supplier_lead_time(ds, inbound)
        if "region" in inbound.columns:
            results["warehouse_flow"] = lambda: region_flow(ds, years, warehouse_regions)
    if "work_orders" in ds:
        results["production"] = lambda: production_quality(ds, years)
    if "api_requests" in ds:
        results["api_health"] = lambda: api_health(ds, years)
    return Results(results)


def operations_cards(
    ds: Dataset, courier: DataFrame, production: DataFrame, supplier: DataFrame
) -> DataFrame:
    """Items below reorder level and means over couriers, lines and suppliers, as one row."""

    def mean_of(df: DataFrame, name: str) -> Column:
        return df.agg(mean_rate(name).alias("v")).select("v").scalar()

    low = inventory_positions(ds).agg(F.count_if("below_reorder").alias("below_reorder_skus"))
    return low.select(
        "below_reorder_skus",
        mean_of(courier, "avg_delivery_days").alias("avg_delivery_days"),
        mean_of(production, "rejection_rate_pct").alias("avg_rejection_rate_pct"),
        mean_of(supplier, "avg_lead_days").alias("avg_supplier_lead_days"),
    )


# --- SQL reports -------------------------------------------------------------------------


def inventory_below_reorder(ds: Dataset) -> DataFrame:
    """Inventory of products with a known brand and category, items to reorder first."""
    side = categorised_products(ds).select("product_id", "product_name", "category_name", "cost_price")
    return (
        ds.table("inventory")
        .join(side, "product_id")
        .select(
            "category_name",
            "product_name",
            "store_id",
            F.col("quantity_on_hand").cast("double").alias("quantity_on_hand"),
            F.col("reorder_level").cast("double").alias("reorder_level"),
            (F.col("quantity_on_hand") < F.col("reorder_level")).alias("below_reorder"),
            (F.col("quantity_on_hand") * F.col("cost_price")).cast("double").alias("inventory_value"),
        )
        .orderBy(
            F.col("below_reorder").desc_nulls_first(),
            F.col("inventory_value").desc_nulls_first(),
            "product_name",
            "store_id",
        )
    )


def supplier_shipments(ds: Dataset) -> DataFrame:
    """Shipments, mean lead days and units per supplier name, added up by id before the names come in."""
    days = days_between_dates("shipped_date", "arrival_date").cast("long")
    per_id = (
        ds.table("inbound_shipments")
        .withColumn("lead_days", days)
        .groupBy("supplier_id")
        .agg(
            F.count(F.lit(1)).alias("shipments"),
            F.sum("lead_days").alias("days"),
            F.count("lead_days").alias("dated"),
            F.sum("quantity").alias("units"),
        )
    )
    names = ds.table("suppliers").select("supplier_id", "supplier_name")
    return (
        per_id.join(names, "supplier_id")
        .groupBy("supplier_name")
        .agg(
            F.sum("shipments").alias("shipment_count"),
            F.round(ratio(F.sum("days"), F.sum("dated")), 2).alias("avg_inbound_lead_days"),
            sql_total("units").alias("inbound_units"),
        )
        .orderBy(F.col("avg_inbound_lead_days").asc_nulls_last(), "supplier_name")
    )


def courier_status_shipments(ds: Dataset) -> DataFrame:
    days = days_between_dates("shipped_date", "delivered_date").cast("long")
    return (
        ds.table("sales_shipments")
        .withColumn("delivery_days", days)
        .groupBy("courier_name", "status")
        .agg(
            F.count(F.lit(1)).alias("shipments"),
            F.round(mean("delivery_days"), 2).alias("avg_delivery_days"),
        )
        .orderBy(F.col("shipments").desc(), "courier_name", "status")
    )


def line_quality(ds: Dataset) -> DataFrame:
    """Yield and rejection per line as ratios of the summed quantities."""
    per_line = (
        ds.table("work_orders")
        .groupBy("line_id")
        .agg(
            F.sum("quantity_produced").alias("made"),
            F.sum("rejected_quantity").alias("bad"),
            F.sum(F.col("quantity_produced") - F.col("rejected_quantity")).alias("good"),
        )
    )
    lines = ds.table("production_lines").select("line_id", "line_name")
    made, bad, good = F.sum("made"), F.sum("bad"), F.sum("good")
    return (
        per_line.join(lines, "line_id")
        .groupBy("line_name")
        .agg(
            made.cast("double").alias("units_produced"),
            bad.cast("double").alias("units_rejected"),
            percent_2dp(good, made).alias("yield_pct"),
            percent_2dp(bad, made).alias("rejection_rate_pct"),
        )
        .orderBy(F.col("rejection_rate_pct").desc_nulls_first(), "line_name")
    )
