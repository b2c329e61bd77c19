import pytest
from pyspark.sql import functions as F

from tests.helpers import by, dataset, frame, physical_plan, rows
from tradescope.dataset import Dataset
from tradescope.operators import clean, quality
from tradescope.operators.clean import DIGEST, with_digest
from tradescope.operators.filters import Filters, filter_sales, by_years, in_years
from tradescope.operators.prints import count_prints
from tradescope.plans.fact import sales_fact


def test_json_rows_that_differ_in_key_order_are_duplicates(spark):
    df = spark.createDataFrame(
        [(1, '{"a":1,"b":{"x":2,"y":[1,2]}}'), (1, '{"b": {"y":[1,2],"x":2}, "a": 1}'),
         (1, '{"a":1,"b":{"x":2,"y":[2,1]}}'), (2, "not json"), (2, "not json"), (3, None), (3, None)],
        "id int, payload string",
    )
    kept = clean.drop_duplicate_rows(df, ["payload"])
    assert sorted(r.id for r in kept.collect()) == [1, 1, 2, 3]
    originals = {r.payload for r in df.collect()}
    assert {r.payload for r in kept.collect()} <= originals


def test_maps_are_compared_by_content(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) m UNION ALL SELECT map('b', 2, 'a', 1) UNION ALL SELECT map('a', 2)")
    assert clean.drop_duplicate_rows(df).count() == 2


def test_dedup_scope(spark):
    item = {"order_id": 1, "prod_id": 2, "quantity": 1}
    order = {"order_id": 1, "order_date": "2024-01-01"}
    ds = dataset(spark, order_items=[item, item], orders=[order, order])
    counts = {
        mode: {k: df.count() for k, df in clean.clean_dataset(ds, mode).items()}
        for mode in ("all", "dated", "none")
    }
    assert counts["all"] == {"order_items": 1, "orders": 1}
    assert counts["dated"] == {"order_items": 2, "orders": 1}
    assert counts["none"] == {"order_items": 2, "orders": 2}
    with pytest.raises(ValueError):
        clean.clean_dataset(ds, "some")


def test_dates_are_standardised_by_table(spark):
    raw = spark.createDataFrame([(1, "2024-01-05"), (2, "bad")], "order_id long, order_date string")
    cleaned = clean.clean_dataset(Dataset(spark, {"orders": raw}))["orders"]
    assert dict(cleaned.dtypes)["order_date"] == "timestamp_ntz"
    assert by(cleaned, "order_id")[2]["order_date"] is None


def test_required_tables_report(spark):
    ds = dataset(spark, orders=[{"order_id": 1}], products=[])
    report = by(quality.validate_required(ds), "table_key")
    assert report["orders"]["status"] == "Available" and report["orders"]["row_count"] == 1
    assert report["products"]["status"] == report["brand"]["status"] == "Missing or empty"
    assert report["orders"]["database_table"] == "sales.orders"
    assert len(report) == 5
    assert quality.validate_required(ds, "dashboard").count() == 6


def test_quality_profile(spark):
    ds = dataset(
        spark,
        suppliers=[{"supplier_id": 1}, {"supplier_id": 1}, {"supplier_id": 2, "supplier_name": "b"}],
        brand=[],
    )
    profile = rows(quality.quality_profile(ds), "table_key", "rows", "columns", "missing_cell_rate_pct", "duplicate_rows_after_cleaning")
    assert profile == [("brand", 0, 3, 0.0, 0), ("suppliers", 3, 2, 33.33, 1)]


def test_duplicate_keys_and_coverage(spark):
    orders = frame(
        spark, "orders",
        *[{"order_id": i, "order_date": f"2024-0{i}-01"} for i in (1, 2, 2, 3, 3, 3)],
    )
    assert rows(quality.duplicate_keys(orders, "order_id"), "order_id", "duplicate_count") == [(3, 3), (2, 2)]
    span = quality.date_coverage(orders, "order_date").collect()[0]
    assert (span.first_order_date.month, span.last_order_date.month) == (1, 3)


def test_catalog_views(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS probe_ns")
    spark.range(3).write.mode("overwrite").saveAsTable("probe_ns.numbers")
    assert "probe_ns" in [r.schema_name for r in quality.schemas(spark).collect()]
    assert rows(quality.tables(spark, ["probe_ns"]), "table_schema", "table_name") == [("probe_ns", "numbers")]
    assert by(quality.tables_per_schema(spark), "table_schema")["probe_ns"]["table_count"] == 1
    spark.sql("DROP SCHEMA probe_ns CASCADE")


def test_year_filter_uses_the_first_date_column_and_drops_nulls(spark):
    shipments = frame(
        spark, "sales_shipments",
        {"shipment_id": 1, "shipped_date": "2023-12-31T23:59:59", "delivered_date": "2024-01-02"},
        {"shipment_id": 2, "shipped_date": "2024-01-01", "delivered_date": "2024-01-02"},
        {"shipment_id": 3, "delivered_date": "2024-01-02"},
    )
    kept = by_years(shipments, ["missing", "shipped_date", "delivered_date"], [2024])
    assert [r.shipment_id for r in kept.collect()] == [2]
    assert by_years(shipments, ["shipped_date"], []).count() == 3


def test_year_filter_on_text_and_plain_timestamps(spark):
    text = spark.createDataFrame([("2024-05-01",), ("x",), ("2025-01-01",)], "d string")
    assert by_years(text, ["d"], [2024]).count() == 1
    zoned = spark.sql("SELECT timestamp'2024-12-31 23:00:00' d UNION ALL SELECT timestamp'2025-01-01 00:00:00'")
    assert by_years(zoned, ["d"], [2024]).count() == 1
    day = spark.sql("SELECT date'2024-12-31' d")
    assert day.where(in_years(F.col("d"), day.schema["d"].dataType, [2024, 2025])).count() == 1


def test_empty_selection_keeps_everything_and_lists_combine_with_and(spark):
    ds = dataset(
        spark,
        orders=[{"order_id": i, "order_status": "Shipped", "order_date": f"202{i}-01-01", "store_id": i} for i in (1, 2)],
        order_items=[{"order_id": i, "net_amount": 10} for i in (1, 2)],
        stores=[{"store_id": i, "store_name": f"S{i}", "region_id": 1} for i in (1, 2)],
        region=[{"region_id": 1, "region_name": "North"}],
    )
    fact = sales_fact(ds)
    assert filter_sales(fact, Filters()).count() == 2
    assert filter_sales(fact, Filters(years=[2021, 2022], stores=["S2"])).count() == 1
    assert filter_sales(fact, Filters(regions=["North"], stores=["S3"])).count() == 0


# --- Copies in two phases -------------------------------------------------------------------


def test_digests_tell_nulls_columns_and_zeros_apart(spark):
    schema = "a string, b string, c double, d map<string,int>"
    rows = [(None, "x", 0.0, {"k": 1, "l": 2}), ("x", None, 0.0, {"l": 2, "k": 1}), ("x", None, -0.0, {"k": 1, "l": 2}), (None, None, float("nan"), None)]
    marked, keys = with_digest(spark.createDataFrame(rows, schema))
    prints = [tuple(r[c] for c in DIGEST) for r in marked.collect()]
    assert prints[1] == prints[2] and len(set(prints)) == 3 and keys == ["a", "b", "c", "_key_0"]


def test_different_rows_of_one_digest_both_stay(spark, monkeypatch):
    """Every digest forced to be the same: only whole rows decide then."""
    def blind(df, json_columns=None):
        return [F.lit(1).cast("long").alias(c) for c in DIGEST]

    rows = spark.createDataFrame([(i % 7, "v" if i % 2 else None) for i in range(100)], "a int, b string").repartition(3)
    want = sorted(map(str, rows.distinct().collect()))
    plain = quality.profile_table(rows, "t").collect()
    for module in (clean, quality):
        monkeypatch.setattr(module, "digest_columns", blind)
    assert sorted(map(str, clean.drop_duplicate_rows(rows).collect())) == want
    assert quality.profile_table(rows, "t").collect() == plain and plain[0].duplicate_rows_after_cleaning == 86


def test_few_copies_among_many_rows(spark):
    """Only the rows with copies are compared whole; nothing else is lost or doubled."""
    rows = spark.range(2000).selectExpr("id", "cast(id % 3 AS string) AS k")
    doubled = rows.union(rows.where("id % 50 = 0")).union(rows.where("id = 7")).repartition(5)
    kept = clean.drop_duplicate_rows(doubled)
    assert "LeftAnti" in physical_plan(kept) and sorted(r.id for r in kept.collect()) == list(range(2000))


def test_clean_rows_are_not_shuffled(spark, tmp_path):
    """Without copies the rows come back as they were scanned."""
    spark.range(1000).selectExpr("id", "repeat('x', 500) AS wide").write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    kept = clean.drop_duplicate_rows(rows)
    assert "Exchange" not in physical_plan(kept) and kept.count() == 1000


def test_the_profile_moves_digests_only(spark, tmp_path, monkeypatch):
    spark.range(1000).selectExpr("id", "repeat('x', 500) AS wide").write.parquet(f"{tmp_path}/t")
    staged = []
    real = quality.stage
    monkeypatch.setattr(quality, "stage", lambda df, label: staged.append(df) or real(df, label))
    rows = spark.read.parquet(f"{tmp_path}/t")
    got = quality.quality_profile(Dataset(spark, {"t": rows, "empty": rows.limit(0)})).collect()
    assert [tuple(r) for r in got] == [("empty", 0, 2, 0.0, 0), ("t", 1000, 2, 0.0, 0)]
    exchanged = [line for line in physical_plan(staged[0]).splitlines() if "Exchange" in line]
    # The table's number, two longs of digest, and the two numbers added up for them.
    assert exchanged and all("wide" not in line for line in exchanged)
    aggregates = [line for line in physical_plan(staged[0]).splitlines() if "partial_count" in line and "keys=[_table" in line]
    assert aggregates and all("wide" not in line for line in aggregates)


def test_packed_fingerprints_are_counted_exactly(spark):
    """Against a plain count: several tables in a task, slots across batches, a hot one, chunks of few rows."""
    rows = spark.range(0, 6000, 1, 3).selectExpr(
        "cast(id % 2 AS int) AS _table",
        "CASE WHEN id % 3 = 0 THEN 1152921504606846975 WHEN id % 5 = 0 THEN id div 20 ELSE xxhash64(id) >>> 4 END AS _print",
        "id % 4 AS _nulls",
    )
    for chunk in (1, 100, 1 << 20):
        got = count_prints(rows, chunk).collect()
        several = sorted((r["_table"], r["_print"]) for r in got if r["_print"] is not None)
        plain = rows.groupBy("_table", "_print").count().collect()
        assert several == sorted((r["_table"], r["_print"]) for r in plain if r["count"] > 1)
        for number in (0, 1):
            sums = [r for r in got if r["_table"] == number]
            assert sum(r["_rows"] for r in sums) == 3000
            assert sum(r["_nulls"] for r in sums) == rows.where(f"_table = {number}").agg(F.sum("_nulls")).first()[0]
            assert sum(r["_once"] for r in sums) == sum(r["count"] == 1 and r["_table"] == number for r in plain)


def test_the_profile_sends_no_row_of_its_own(spark, tmp_path, monkeypatch):
    """Before the exchange the fingerprints are in records of a slot; nothing else is exchanged for them."""
    staged = []
    real = quality.stage
    monkeypatch.setattr(quality, "stage", lambda df, label: staged.append(df) or real(df, label))
    few, many = spark.range(900), spark.range(900).selectExpr("id % 100 AS id")
    ds = Dataset(spark, {"few": few.union(few.where("id % 90 = 0")).repartition(3), "many": many.repartition(3)})
    got = {r.table_key: tuple(r) for r in quality.quality_profile(ds).collect()}
    assert got["few"] == ("few", 910, 1, 0.0, 10) and got["many"] == ("many", 900, 1, 0.0, 800)
    exchanged = [line for line in physical_plan(staged[0]).splitlines() if "Exchange hashpartitioning" in line]
    assert sum("_slot" in line for line in exchanged) == 1 and not any("_digest" in line for line in exchanged)


def test_shared_fingerprints_of_different_rows(spark, monkeypatch):
    """Fingerprints that pairs of rows share wrongly, in a table that is compared whole and in one that is not."""
    def narrow(df, json_columns=None):
        return [F.when(F.col("a") < 20, F.col("a").cast("long").bitwiseAND(~1)).otherwise(F.col("a").cast("long")).bitwiseAND(2**40 - 1).alias(c) for c in DIGEST]

    monkeypatch.setattr(quality, "fingerprint", lambda digest: digest)
    for module in (clean, quality):
        monkeypatch.setattr(module, "digest_columns", narrow)
    for size in (25, 400):
        profile = quality.profile_table(spark.range(size).selectExpr("id AS a").repartition(3), "t").collect()[0]
        assert (profile.rows, profile.duplicate_rows_after_cleaning) == (size, 0)
