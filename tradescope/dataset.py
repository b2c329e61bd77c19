"""A set of logical tables, each a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from tradescope.registry import table_specs


class Dataset(Mapping[str, DataFrame]):
    """Tables by key; a table may be given as a function that opens it on first use."""

    def __init__(
        self, spark: SparkSession, tables: Mapping[str, DataFrame | Callable[[], DataFrame]]
    ):
        self.spark = spark
        self._tables = dict(tables)
        self._filled: dict[str, bool] = {}

    def __getitem__(self, key: str) -> DataFrame:
        table = self._tables[key]
        if callable(table):
            table = self._tables[key] = table()
        return table

    def __contains__(self, key: object) -> bool:
        return key in self._tables

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)

    def table(self, key: str) -> DataFrame:
        """The table, or an empty frame with the registry's columns when it is absent."""
        if key in self._tables:
            return self[key]
        return self.spark.createDataFrame([], table_specs()[key].schema)

    def has_rows(self, key: str) -> bool:
        """Whether the table is there and not empty; looked up once."""
        if key not in self._filled:
            self._filled[key] = key in self._tables and not self[key].isEmpty()
        return self._filled[key]

    def with_tables(self, **tables: DataFrame) -> Dataset:
        return Dataset(self.spark, {**self._tables, **tables})

    def map(self, fn) -> Dataset:
        """A dataset with ``fn(key, frame)`` applied to every table."""
        return Dataset(self.spark, {key: fn(key, df) for key, df in self.items()})


class Results(Mapping[str, DataFrame]):
    """Named results, each built when it is first asked for."""

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]):
        self._builders = dict(builders)
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __contains__(self, name: object) -> bool:
        return name in self._builders

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)
