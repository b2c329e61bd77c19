"""A lake kept up to date by date ranges, against one written anew."""

import os
from pathlib import Path

import pytest

from tests.helpers import frame, rows
from tradescope.registry import table_specs
from tradescope.sources import refresh
from tradescope.sources.loader import load
from tradescope.sources.parquet import ParquetSource, write_lake
from tradescope.sources.refresh import refresh_lake


def order(i, date, status="Shipped"):
    return {"order_id": i, "cust_id": 1, "order_date": date, "order_status": status}


def add_file(spark, raw: Path, name: str, *records: dict, key: str = "orders") -> Path:
    """One more raw file of a table."""
    folder = raw / table_specs()[key].namespace / table_specs()[key].name
    scratch = raw.parent / f"scratch-{name}"
    frame(spark, key, *records).coalesce(1).write.mode("overwrite").parquet(str(scratch))
    (part,) = scratch.glob("part-*.parquet")
    folder.mkdir(parents=True, exist_ok=True)
    target = folder / f"{name}.parquet"
    target.write_bytes(part.read_bytes())
    return target


def lake_files(lake: Path, key: str = "orders") -> set[str]:
    folder = lake / table_specs()[key].namespace / table_specs()[key].name
    return {f"{p.parent.name}/{p.name}" for p in folder.rglob("*.parquet")}


def ranges_of(files: set[str]) -> set[str]:
    return {f.split("/")[0].removeprefix("lake_range=") for f in files}


def content(spark, folder: Path, key: str = "orders") -> list:
    return sorted(map(repr, ParquetSource(spark, str(folder)).read(table_specs()[key]).collect()))


def check_whole(spark, raw: Path, lake: Path, key: str = "orders") -> None:
    """The lake holds what a load of all raw files gives."""
    ds, _ = load(ParquetSource(spark, str(raw)), keys=[key])
    fresh = lake.parent / f"whole-{len(list(lake.parent.iterdir()))}"
    write_lake(ds, str(fresh))
    assert content(spark, lake, key) == content(spark, fresh, key)


@pytest.fixture
def shop(spark, tmp_path):
    raw, lake = tmp_path / "raw", tmp_path / "lake"
    add_file(spark, raw, "a", *(order(i, f"2024-0{1 + i % 3}-05") for i in range(30)), order(90, None))
    add_file(spark, raw, "b", *(order(i, "2024-05-01") for i in range(100, 120)))
    return ParquetSource(spark, str(raw)), raw, lake


def run(source, lake, **options):
    return refresh_lake(source, str(lake), keys=["orders"], **options).first()


def test_an_appended_file_rewrites_its_ranges_alone(spark, shop):
    source, raw, lake = shop
    first = run(source, lake)
    assert (first.message, first.files_read, first.ranges_replaced) == ("refreshed", 2, 5)
    assert str(first.high) == "2024-05-01 00:00:00"
    check_whole(spark, raw, lake)
    before = lake_files(lake)
    assert ranges_of(before) == {"202401", "202402", "202403", "202405", "0"}
    # A copy of an old order, a new one of an old month and one of a new month.
    add_file(spark, raw, "c", order(1, "2024-02-05"), order(300, "2024-02-09"), order(301, "2024-06-01"))
    second = run(source, lake)
    assert (second.files_read, second.files_gone, second.ranges_replaced) == (2, 0, 2)
    after = lake_files(lake)
    assert ranges_of(before ^ after) == {"202402", "202406"}
    check_whole(spark, raw, lake)
    assert str(second.high) == "2024-06-01 00:00:00"


def test_a_repeated_run_rewrites_nothing(spark, shop):
    source, _, lake = shop
    run(source, lake)
    before = {p: p.stat().st_mtime_ns for p in lake.rglob("*") if p.is_file()}
    again = run(source, lake)
    assert (again.message, again.files_read, again.ranges_replaced) == ("unchanged", 0, 0)
    assert {p: p.stat().st_mtime_ns for p in lake.rglob("*") if p.is_file()} == before


def test_files_without_a_touched_range_are_not_opened(spark, shop):
    source, raw, lake = shop
    run(source, lake)
    untouched = raw / "sales" / "orders" / "b.parquet"
    state = untouched.stat()
    untouched.write_bytes(b"x" * state.st_size)
    os.utime(untouched, ns=(state.st_atime_ns, state.st_mtime_ns))
    add_file(spark, raw, "c", order(300, "2024-02-09"))
    assert run(source, lake).files_read == 2
    assert "order_id=300" in " ".join(content(spark, lake))


def test_files_that_went_or_changed(spark, shop):
    source, raw, lake = shop
    add_file(spark, raw, "c", order(7, "2024-07-01"), order(1, "2024-02-05"))
    run(source, lake)
    # The only file of May goes, July moves to August; the copy of order 1 goes with it.
    (raw / "sales" / "orders" / "b.parquet").unlink()
    add_file(spark, raw, "c", order(7, "2024-08-01"), order(8, "2024-08-02"))
    done = run(source, lake)
    assert done.files_gone == 1 and done.ranges_replaced == 4
    assert ranges_of(lake_files(lake)) == {"202401", "202402", "202403", "202408", "0"}
    check_whole(spark, raw, lake)


@pytest.mark.parametrize("moment", ["_replace", "announced", "data"])
def test_an_interrupted_refresh_is_finished_by_the_next(spark, shop, monkeypatch, moment):
    source, raw, lake = shop
    run(source, lake)
    added = add_file(spark, raw, "c", order(300, "2024-02-09"), order(301, "2024-06-01"))
    table = refresh._Table
    with monkeypatch.context() as patch:

        def broken(self, *args):
            raise RuntimeError("lost")

        if moment == "data":
            whole = table._replace

            def replaced(self, *args):
                whole(self, *args)
                raise RuntimeError("lost")

            patch.setattr(table, "_replace", replaced)
        else:
            patch.setattr(table, "_replace" if moment == "_replace" else "_announce", broken)
        with pytest.raises(RuntimeError, match="lost"):
            run(source, lake)
    # The file that came is gone again before the next run.
    added.unlink()
    run(source, lake)
    check_whole(spark, raw, lake)
    assert run(source, lake).message == "unchanged"


def test_tables_without_dates_other_settings_and_missing_tables(spark, tmp_path):
    raw, lake = tmp_path / "raw", tmp_path / "lake"
    add_file(spark, raw, "a", {"brand_id": 1, "category_id": 1}, {"brand_id": 1, "category_id": 1}, key="brand")
    source = ParquetSource(spark, str(raw))
    report = refresh_lake(source, str(lake), keys=["brand", "stores", "orders"])
    assert rows(report, "table_key", "severity") == [("brand", "info"), ("stores", "warning"), ("orders", "error")]
    assert len(content(spark, lake, "brand")) == 1
    add_file(spark, raw, "b", {"brand_id": 2, "category_id": 1}, key="brand")
    refresh_lake(source, str(lake), keys=["brand"])
    check_whole(spark, raw, lake, "brand")
    # Copies are kept from here on: the whole table is written.
    done = refresh_lake(source, str(lake), keys=["brand"], dedup="none").first()
    assert done.message == "refreshed" and len(content(spark, lake, "brand")) == 3
    with pytest.raises(ValueError, match="unknown grain"):
        refresh_lake(source, str(lake), grain="week")


def test_an_empty_table_fills_up_and_runs_empty(spark, tmp_path):
    raw, lake = tmp_path / "raw", tmp_path / "lake"
    add_file(spark, raw, "a")
    source = ParquetSource(spark, str(raw))
    assert run(source, lake).ranges_replaced == 0 and content(spark, lake) == []
    filled = add_file(spark, raw, "b", order(1, "2024-01-01"), order(2, None))
    run(source, lake, grain="day")
    assert ranges_of(lake_files(lake)) == {"20240101", "0"} and len(content(spark, lake)) == 2
    filled.unlink()
    run(source, lake, grain="day")
    assert content(spark, lake) == []
