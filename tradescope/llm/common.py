"""Helpers the training-data operators share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradescope.operators.staging import stage

# The Unicode property White_Space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0           "
    "     　"
)
_UNIT = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")

# Words held by a worker between batches; beyond it the memory starts anew.
MEMORY_ENTRIES = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kind(df: DataFrame, column: str) -> str:
    """The column's type as DDL text."""
    return df.schema[column].dataType.simpleString()


def units(text: str) -> list[str]:
    """The text cut before every run of white space.

    No pre-token of the tokenizers in use spans such a cut, so each unit can be split and
    encoded on its own, and equal units only once.
    """
    return _UNIT.findall(text)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column as strings, null as the empty string."""
    return [t or "" for t in batch.column(column).to_pylist()]


def fresh(name: str, df: DataFrame) -> str:
    """A column name like ``name`` that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def forget(memory: dict, most: int = MEMORY_ENTRIES) -> None:
    """Empty a worker's memory once it is full, so that it stays bounded."""
    if len(memory) > most:
        memory.clear()


def running_starts(df: DataFrame, order: list, weight: str, out: str, label: str) -> DataFrame:
    """Add ``out``: the sum of ``weight`` (long, not null) over all rows before this one.

    ``order`` (columns or sort expressions) should tell rows apart, so that range
    partitioning can split any run of equal keys.  Rows are summed inside their range
    partition, and only one total per partition meets in a single task.
    """
    fields = ", ".join(f"{c} {t}" for c, t in df.dtypes)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes) + total
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ends - sizes), pa.array(np.full(len(sizes), part, np.int32))],
                names=[*batch.schema.names, "_start", "_part"],
            )

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = stage(ranged.mapInArrow(number, f"{fields}, _start long, _part int"), label)
    totals = numbered.groupBy("_part").agg(F.sum(weight).alias("_total"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    return numbered.join(before, "_part").withColumn(out, F.col("_start") + F.col("_before")).drop(
        "_start", "_part", "_before"
    )
