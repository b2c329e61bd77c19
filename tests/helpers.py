"""Small frames and the comparison with DuckDB."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from tradescope.dataset import Dataset
from tradescope.registry import table_specs


def frame(spark, key: str, *rows: dict):
    """A table of the registry from dictionaries; missing columns are null."""
    schema = table_specs()[key].schema
    kinds = {f.name: f.dataType.typeName() for f in schema}

    def cell(name, value):
        if value is None:
            return None
        if kinds[name] == "decimal":
            return Decimal(str(value))
        if kinds[name] == "timestamp_ntz" and isinstance(value, str):
            return datetime.fromisoformat(value)
        return value

    data = [tuple(cell(f.name, row.get(f.name)) for f in schema) for row in rows]
    return spark.createDataFrame(data, schema)


def dataset(spark, **tables) -> Dataset:
    return Dataset(spark, {key: frame(spark, key, *rows) for key, rows in tables.items()})


def rows(df, *columns):
    return [tuple(row[c] for c in columns) for row in df.collect()]


def by(df, key: str) -> dict:
    return {row[key]: row.asDict() for row in df.collect()}


def physical_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def sorted_values(columns, records):
    """Rows as sorted tuples of printed values, columns in name order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def printed(value):
        return "" if value is None or value != value else repr(value)

    return sorted(columns), sorted(tuple(printed(r[i]) for i in order) for r in records)
