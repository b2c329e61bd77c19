"""Fault-tolerant loading of many tables; reads stay lazy."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tradescope.dataset import Dataset
from tradescope.operators.clean import clean_dataset
from tradescope.registry import TableSpec, selected_specs, table_specs

REPORT_SCHEMA = "table_key string, severity string, message string"
UNMAPPED = "no table of the registry has this key"

# The tables without which no sales fact can be built.
GATE_TABLES = ("orders", "order_items", "products")


class Source(Protocol):
    spark: SparkSession

    def read(self, spec: TableSpec) -> DataFrame: ...


def load(
    source: Source,
    keys: Iterable[str] | None = None,
    include_large: bool = False,
    profile: str = "dashboard",
    dedup: str = "all",
    json_columns: dict[str, list[str]] | None = None,
) -> tuple[Dataset, DataFrame]:
    """Open and clean the tables that can be opened; report the others.

    An unknown key and a missing optional table are warnings, a missing required table is
    an error; neither stops the load.
    """
    specs = table_specs(profile)
    requested = list(keys) if keys is not None else list(selected_specs(include_large, profile))
    opened: dict[str, DataFrame] = {}
    notes: list[tuple[str, str, str]] = []
    for key in requested:
        spec = specs.get(key)
        if spec is None:
            notes.append((key, "warning", UNMAPPED))
            continue
        try:
            opened[key] = source.read(spec)
        except (PySparkException, Py4JError) as problem:
            severity = "error" if spec.required else "warning"
            notes.append((key, severity, f"{spec.qualified_name} could not be opened: {problem}"))
    report = source.spark.createDataFrame(notes, REPORT_SCHEMA)
    return clean_dataset(Dataset(source.spark, opened), dedup, json_columns), report


def ready_for_sales(ds: Dataset, with_rows: bool = False) -> bool:
    """Whether the tables of the sales fact are there and, if asked, none of them is empty."""
    return all(ds.has_rows(key) if with_rows else key in ds for key in GATE_TABLES)
