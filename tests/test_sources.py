import glob
from datetime import datetime
from pathlib import Path
from urllib.parse import urlparse

import duckdb

from tests.helpers import dataset, physical_plan, rows
from tradescope.operators.filters import Filters, by_years
from tradescope.operators.staging import drop_staged, stage, stage_root
from tradescope.plans.fact import sales_fact
from tradescope.plans.report import export_report
from tradescope.registry import selected_specs, table_specs
from tradescope.sources import sinks
from tradescope.sources.catalog import CatalogSource, save_bucketed
from tradescope.sources.jdbc import (
    BlockSplit,
    DateSplit,
    HistogramSplit,
    PostgresConnection,
    PostgresSource,
    Split,
    histogram_split,
    probe_session,
)
from tradescope.sources.loader import load, ready_for_sales
from tradescope.sources.parquet import ParquetSource, write_lake
from tradescope.validate import validate


def small_shop(spark):
    return dataset(
        spark,
        orders=[{"order_id": i, "cust_id": i % 3, "order_status": "Shipped", "order_date": f"20{20 + i % 4}-01-01"} for i in range(40)],
        order_items=[{"order_id": i % 40, "prod_id": i % 5, "quantity": 1, "net_amount": i} for i in range(120)],
        products=[{"product_id": i, "product_name": f"P{i}", "brand_id": 1, "cost_price": 1} for i in range(5)],
        brand=[{"brand_id": 1, "category_id": 1}],
        category=[{"category_id": 1, "category_name": "C"}],
    )


def test_registry():
    assert len(table_specs()) == 49 and len(table_specs("validation")) == 25
    assert sum(s.required for s in table_specs().values()) == 6
    assert sum(s.required for s in table_specs("validation").values()) == 5
    assert set(table_specs()) - set(selected_specs()) == {"page_views", "web_events"}
    assert table_specs()["sales_returns"].qualified_name == "sales.returns"


def test_load_reports_what_is_missing(spark, tmp_path):
    write_lake(small_shop(spark), str(tmp_path))
    source = ParquetSource(spark, str(tmp_path))
    ds, notes = load(source, keys=["orders", "order_items", "products", "stores", "customers", "nonsense"])
    assert set(ds) == {"orders", "order_items", "products"} and ready_for_sales(ds)
    severities = dict(rows(notes, "table_key", "severity"))
    assert severities == {"stores": "warning", "customers": "error", "nonsense": "warning"}
    _, notes = load(source, keys=["customers"], profile="validation")
    assert rows(notes, "severity") == [("warning",)]


def test_whole_profile_loads_without_the_large_tables(spark, tmp_path):
    write_lake(small_shop(spark), str(tmp_path))
    ds, notes = load(ParquetSource(spark, str(tmp_path)))
    assert len(ds) + notes.count() == 47


def test_year_filter_reaches_the_scan(spark, tmp_path):
    write_lake(small_shop(spark), str(tmp_path))
    orders = ParquetSource(spark, str(tmp_path)).read(table_specs()["orders"])
    plan = physical_plan(by_years(orders, ["order_date"], [2021, 2022]).select("order_id"))
    assert "GreaterThanOrEqual(order_date,2021-01-01T00:00)" in plan
    assert "LessThan(order_date,2023-01-01T00:00)" in plan
    assert "ReadSchema: struct<order_id:bigint,order_date:timestamp_ntz>" in plan


def test_bucketed_tables_join_without_a_shuffle(spark):
    save_bucketed(small_shop(spark), {"orders": "order_id", "order_items": "order_id"}, 4)
    ds, _ = load(CatalogSource(spark), keys=["orders", "order_items"], dedup="none")
    previous = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fact = sales_fact(ds)
        assert "SortMergeJoin" in physical_plan(fact) and "Exchange" not in physical_plan(fact)
        assert fact.count() == 120
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", previous)
        spark.sql("DROP SCHEMA sales CASCADE")


def test_postgres_options(spark):
    connection = PostgresConnection("db.example", 5432, "my db", "me@x", "p:w/d")
    source = PostgresSource(spark, connection, {"orders": Split("order_id", "0", "900", 9)})
    orders = table_specs()["orders"]
    options = source.options(orders, source.split(orders))
    assert options["url"] == "jdbc:postgresql://db.example:5432/my%20db?sslmode=require"
    assert options["dbtable"] == '"sales"."orders"' and options["password"] == "p:w/d"
    assert options["partitionColumn"] == "order_id" and options["numPartitions"] == "9"
    assert "partitionColumn" not in source.options(table_specs()["stores"])
    assert table_specs()["inventory"].split == "product_id"
    assert table_specs()["reviews"].split == "review_date"
    assert table_specs()["web_events"].split == "event_timestamp"
    bare = {key for key, spec in table_specs().items() if spec.split is None}
    assert bare == {key for key, spec in table_specs().items() if not spec.schema}
    for spec in table_specs().values():
        assert spec.split is None or spec.split in spec.schema.names
    expected = 'SELECT min("order_id") AS low, max("order_id") AS high FROM "sales"."orders"'
    assert source.bounds_query(orders, "order_id") == expected
    assert "p:w/d" not in repr(connection)


def test_date_ranges_cover_every_row_once():
    split = DateSplit("day", datetime(2024, 1, 1), datetime(2024, 1, 9), 4)
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT CAST('2023-12-30' AS TIMESTAMP) + to_hours(range * 5) AS day FROM range(80)")
    con.execute("INSERT INTO t VALUES (NULL), ('2024-01-01'), ('2024-01-09'), ('2024-01-03')")
    counts = [con.execute(f"SELECT count(*) FROM t WHERE {p}").fetchall()[0][0] for p in split.predicates()]
    assert len(counts) == 4 and sum(counts) == 84 and all(counts)
    assert DateSplit("day", datetime(2024, 1, 1), datetime(2024, 1, 1), 4).predicates() == ["1 = 1"]


def read_sizes(values: str, predicates: list[str]) -> tuple[list[int], int]:
    """Rows per read of a table with the column v, and rows of the table."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE t AS {values}")
    sizes = [con.execute(f"SELECT count(*) FROM t WHERE {p}").fetchall()[0][0] for p in predicates]
    return sizes, con.execute("SELECT count(*) FROM t").fetchall()[0][0]


def quantiles(values: list, buckets: int) -> list[str]:
    return [str(values[min(len(values) - 1, len(values) * k // buckets)]) for k in range(buckets + 1)]


def test_sparse_ids_are_read_in_equal_shares():
    # Squares: ranges of equal width would put a third of the rows into the first of nine reads.
    squares = [i * i for i in range(10_000)]
    split = histogram_split("v", "bigint", quantiles(squares, 100), [], 0.1, 8, 0)
    sizes, total = read_sizes(
        "SELECT range * range AS v FROM range(10000) UNION ALL SELECT NULL FROM range(1000)", split.predicates()
    )
    assert len(sizes) == 8 and sum(sizes) == total == 11_000 and max(sizes) < 2 * min(sizes) + 1000


def test_a_hot_id_is_read_apart_by_blocks():
    split = histogram_split("v", "integer", quantiles(list(range(-5000, 5000)), 100), [("77", 0.4), ("-3", 0.01)], 0.0, 10, 900)
    assert split.hot == (("77", 4),) and split.blocks == 900
    hot = [p for p in split.predicates() if p.startswith('"v" = ')]
    assert len(hot) == 4 and hot[0] == "\"v\" = '77' AND ctid < '(225,0)'::tid"
    assert hot[1] == "\"v\" = '77' AND ctid >= '(225,0)'::tid AND ctid < '(450,0)'::tid"
    table = (
        "SELECT range - 5000 AS v FROM range(10000) UNION ALL SELECT 77 FROM range(6666) UNION ALL SELECT NULL FROM range(5)"
    )
    others = [p for p in split.predicates() if p not in hot]
    sizes, total = read_sizes(table, [*others, "\"v\" = '77'"])
    assert sum(sizes) == total and max(sizes[:-1]) < 2 * min(sizes[:-1])
    # Without blocks (a partitioned table) the value is one read.
    assert HistogramSplit("v", ("5",), (("77", 4),)).predicates()[-1] == "\"v\" = '77'"
    sizes, total = read_sizes(table, HistogramSplit("v", (), (("77", 4),)).predicates())
    assert sum(sizes) == total


def test_dates_are_read_in_equal_shares_unless_only_the_server_knows_their_order():
    days = [f"2024-01-{1 + i // 40:02d} {i % 24:02d}:00:00" for i in range(1000)]
    split = histogram_split("v", "timestamp without time zone", quantiles(sorted(days), 50), [], 0.0, 5, 0)
    table = "SELECT CAST(printf('2024-01-%02d %02d:00:00', 1 + range // 40, range % 24) AS TIMESTAMP) AS v FROM range(1000)"
    sizes, total = read_sizes(table, split.predicates())
    assert len(sizes) == 5 and sum(sizes) == total and max(sizes) < 2 * min(sizes)
    for bounds in (["2024-01-01", "10000-01-01"], ["0044-03-15 BC", "2024-01-01"], ["01/02/2024", "03/02/2024"]):
        assert histogram_split("v", "date", bounds, [], 0.0, 5, 0) is None
    assert histogram_split("v", "text", ["1", "10", "9"], [], 0.0, 5, 0) is None
    assert histogram_split("v", "bigint", [], [], 0.0, 5, 0) is None
    assert histogram_split("v", "bigint", ["1", "2"], [], 0.0, 5, 0) is None


def test_block_ranges():
    assert BlockSplit(0, 4).predicates() == BlockSplit(1, 4).predicates()[:1] == ["1 = 1"]
    assert BlockSplit(8, 4).predicates() == [
        "ctid < '(2,0)'::tid",
        "ctid >= '(2,0)'::tid AND ctid < '(4,0)'::tid",
        "ctid >= '(4,0)'::tid AND ctid < '(6,0)'::tid",
        "ctid >= '(6,0)'::tid",
    ]


class Answers(PostgresSource):
    """A source whose server answers are given."""

    def __init__(self, spark, answers):
        super().__init__(spark, PostgresConnection("nowhere.invalid", 1, "d", "u", "p"), parts=4)
        self.answers, self.asked = answers, []

    def _query(self, text):
        self.asked.append(text)
        return self.spark.createDataFrame(*self.answers[len(self.asked) - 1])


STATISTICS = (
    "bounds array<string>, common_values array<string>, common_shares array<double>, empty_share double, "
    "kind string, blocks long"
)


def test_every_table_is_split_by_what_the_server_knows(spark):
    for spec in table_specs().values():
        if spec.split is None:
            source = Answers(spark, [([(64,)], "blocks long")])
            assert source.split(spec) == BlockSplit(64, 4)
            assert source.asked == [source.blocks_query(spec)] and f"'{quoted(spec)}'::regclass" in source.asked[0]
            continue
        source = Answers(spark, [([(["1", "5", "9", "70", "71"], None, None, 0.0, "bigint", 12)], STATISTICS)])
        assert source.split(spec) == HistogramSplit(spec.split, ("5", "9", "70"), (), 12)
        assert f"attname = '{spec.split}'" in source.asked[0] and f"tablename = '{spec.name}'" in source.asked[0]


def quoted(spec) -> str:
    return f'"{spec.namespace}"."{spec.name}"'


def test_tables_without_statistics_are_split_between_their_bounds(spark):
    orders = table_specs()["orders"]
    source = Answers(spark, [([], STATISTICS), ([(3, 90)], "low long, high long")])
    assert source.split(orders) == Split("order_id", "3", "90", 4)
    source = Answers(spark, [([], STATISTICS), ([(None, None)], "low long, high long")])
    assert source.split(orders) is None
    bare = table_specs()["transcripts"]
    assert Answers(spark, [([(0,)], "blocks long")]).split(bare) is None


def test_an_unreachable_database_is_reported(spark):
    # No JDBC driver is installed here, so opening the table fails at once.
    source = PostgresSource(spark, PostgresConnection("nowhere.invalid", 1, "d", "u", "p"))
    ds, notes = load(source, keys=["orders"])
    assert len(ds) == 0 and rows(notes, "table_key", "severity") == [("orders", "error")]


def test_session_probe(spark):
    status = probe_session(spark).collect()[0]
    assert status.database == "default" and status.db_user and status.server_time


def test_staging_uses_the_shared_folder(spark):
    staged = stage(spark.range(5), "numbers")
    assert staged.count() == 5
    assert staged.inputFiles()[0].removeprefix("file://").removeprefix("file:").startswith(stage_root(spark))


def test_dropping_staged_tables_leaves_other_applications_alone(spark, tmp_path):
    own = Path(urlparse(stage(spark.range(3), "numbers").inputFiles()[0]).path)
    foreign = own.parents[2] / "other-application" / "numbers"
    foreign.mkdir(parents=True, exist_ok=True)
    drop_staged(spark)
    assert not own.exists() and foreign.exists()
    foreign.rmdir()


def test_csv_sink(spark, tmp_path):
    sinks.write_csv(spark.range(2), str(tmp_path / "out"))
    text = "".join(open(f).read() for f in glob.glob(f"{tmp_path}/out/*.csv"))
    assert text.count("id\n") >= 1 and "0\n" in text and "1\n" in text


def staged_folders(spark) -> set[str]:
    root = Path(urlparse(stage_root(spark)).path) / "tradescope" / spark.sparkContext.applicationId
    return {p.name for p in root.glob("*")} if root.exists() else set()


def test_export_report(spark, tmp_path):
    before = staged_folders(spark)
    report = export_report(small_shop(spark), str(tmp_path / "r"), Filters(years=[2021]))
    assert set(report.frames) == {"Executive_Monthly_KPI", "Sales_Product", "Finance_PnL", "Cross_Functional"}
    assert spark.read.parquet(f"{tmp_path}/r/frames/Executive_Monthly_KPI").count() == 1
    assert "marketing_spend" in spark.read.parquet(f"{tmp_path}/r/frames/Cross_Functional").columns
    assert report.frames["Sales_Product"].count() > 0 and report.lines.count() > 8
    assert staged_folders(spark) == before
    (text_file,) = glob.glob(f"{tmp_path}/r/text/*.txt")
    lines = open(text_file).read().splitlines()
    assert lines[0] == "Management Report" and "Orders: 10" in lines
    (html_file,) = glob.glob(f"{tmp_path}/r/html/*.txt")
    html = open(html_file).read()
    assert html.startswith("<html><body><pre>") and html.rstrip().endswith("</pre></body></html>")
    assert "Sales &amp; Customer" in html


def test_validation_run(spark, tmp_path):
    write_lake(small_shop(spark), str(tmp_path / "lake"))
    validate(spark, str(tmp_path / "lake"), str(tmp_path / "out"))
    required = spark.read.option("header", True).csv(f"{tmp_path}/out/required_tables")
    assert {r.status for r in required.collect()} == {"Available"}
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/quality_profile").count() == 5
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/load_report").count() == 20
