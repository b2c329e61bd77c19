"""Tables registered in the Spark catalog, one schema per namespace."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradescope.dataset import Dataset
from tradescope.registry import TableSpec, table_specs


# The side table with the rows of hot keys.
HOT = "_hot"


class CatalogSource:
    """Reads ``<namespace>.<name>`` from the session's catalog, with its hot rows if it has some.

    ``part`` reads one side only: the ``bucketed`` rows or the ``hot`` ones.
    """

    def __init__(self, spark: SparkSession, part: str = "all"):
        if part not in ("all", "bucketed", "hot"):
            raise ValueError(f"unknown part: {part}")
        self.spark = spark
        self.part = part

    def read(self, spec: TableSpec) -> DataFrame:
        name = spec.qualified_name
        if not self.spark.catalog.tableExists(name + HOT):
            return self.spark.read.table(name)
        if self.part == "hot":
            return self.spark.read.table(name + HOT)
        rows = self.spark.read.table(name)
        return rows if self.part == "bucketed" else rows.unionByName(self.spark.read.table(name + HOT))


def hot_keys(df: DataFrame, column: str, share: float) -> tuple[list, bool]:
    """The values that more than ``share`` of the rows hold, and whether null is one; exact.

    A summary of frequent items names the candidates in one pass without a shuffle of the
    rows, a second pass counts them.  There are fewer than 1 / ``share`` of them.
    """
    # The summary is off by at most 3.5 rows in ``tracked``; an eighth of the share is allowed here.
    wanted, tracked = math.ceil(2 / share), math.ceil(32 / share)
    name = f"`{column}`"
    found = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(name).isNull()).alias("empty"),
        F.expr(f"approx_top_k({name}, {wanted}, {tracked})").alias("top"),
    ).first()
    most = found.rows * share
    candidates = [r.item for r in found.top if r.item is not None]
    counted = df.where(F.col(name).isin(candidates)).groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return sorted(r.value for r in counted.where(F.col("n") > most).collect()), found.empty > most


def save_bucketed(ds: Dataset, keys: dict[str, str], buckets: int, hot_share: float | None = None) -> None:
    """Save tables bucketed by a column, for instance orders and order_items by order_id.

    Tables bucketed alike join without a shuffle.  Adaptive execution cannot split a
    bucket; where one key may hold a large part of the rows, give ``hot_share``: a key with more
    than this share of the rows of any of the tables goes to a side table ``<name>_hot`` in
    all of them, so both sides can be joined apart (``parts``, ``plans.fact.sales_fact_of_parts``).
    All columns of ``keys`` have to be of one kind then.
    """
    spark = ds.spark
    hot: list = []
    nulls = False
    if hot_share is not None:
        found = [hot_keys(ds[key], column, hot_share) for key, column in keys.items()]
        hot = sorted({value for values, _ in found for value in values})
        nulls = any(empty for _, empty in found)
    for key, column in keys.items():
        name = table_specs()[key].qualified_name
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {table_specs()[key].namespace}")
        rows = ds[key]
        if hot_share is None:
            spark.sql(f"DROP TABLE IF EXISTS {name}{HOT}")
        else:
            value = F.col(f"`{column}`")
            apart = F.when(value.isNull(), F.lit(nulls)).otherwise(value.isin(hot))
            rows.where(apart).write.mode("overwrite").saveAsTable(name + HOT)
            rows = rows.where(~apart)
        # One shuffle by the bucket column first, so that each task writes whole buckets.
        grouped = rows.repartition(buckets, column)
        writer = grouped.write.bucketBy(buckets, column).sortBy(column)
        writer.mode("overwrite").saveAsTable(name)


def parts(ds: Dataset, keys: Iterable[str]) -> list[Dataset]:
    """The dataset twice: with the bucketed rows of the tables of ``keys``, and with their hot rows."""
    specs = [table_specs()[key] for key in keys]
    sides = (CatalogSource(ds.spark, part) for part in ("bucketed", "hot"))
    return [ds.with_tables(**{spec.key: side.read(spec) for spec in specs}) for side in sides]


def clustered_by_date(df: DataFrame, column: str) -> DataFrame:
    """Rows in date ranges, so that a year filter skips whole files.

    A hash of the row follows the date in the range key, which splits a date that many
    rows share.
    """
    hashable = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    spread = F.xxhash64(*hashable)
    return df.repartitionByRange(F.col(column), spread).sortWithinPartitions(column)
