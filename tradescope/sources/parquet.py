"""Tables kept as Parquet, one path per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradescope.dataset import Dataset
from tradescope.registry import TableSpec, table_specs
from tradescope.sources.catalog import clustered_by_date

# The folder column of a lake that is kept up to date by date ranges; no column of its tables.
RANGE = "lake_range"


class ParquetSource:
    """Reads ``<root>/<namespace>/<name>``; opening a table reads its footer only."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, spec: TableSpec) -> str:
        return f"{self.root}/{spec.namespace}/{spec.name}"

    def read(self, spec: TableSpec) -> DataFrame:
        return self.spark.read.parquet(self.path(spec)).drop(RANGE)


def write_lake(ds: Dataset, root: str, by_date: bool = True) -> None:
    """Write cleaned tables once; later runs scan them with pushed filters and no clean-up.

    With ``by_date`` each dated table is laid out by its first date column.
    """
    for key, df in ds.items():
        spec = table_specs()[key]
        dates = [c for c in spec.date_columns if c in df.columns]
        laid_out = clustered_by_date(df, dates[0]) if by_date and dates else df
        laid_out.write.mode("overwrite").parquet(
            f"{root.rstrip('/')}/{spec.namespace}/{spec.name}"
        )
