"""Exact positions inside groups of any size.

A plain ``row_number() over (partition by g order by v)`` sorts each group in one task,
so a single large group decides the run time.  Here the rows are range-partitioned on
(group, order) instead, which cuts a large group into many partitions; the position of a
row is its place inside its partition plus the size of the group's earlier partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradescope.operators.staging import stage

_ROW = "_row"
_SLOT = "_slot"
# monotonically_increasing_id keeps the partition number above bit 33 and the row below.
_ROW_BITS = 33


def _sorted_slots(df: DataFrame, keys: list[str], slots: int | None) -> DataFrame:
    ranged = df.repartitionByRange(slots, *keys) if slots else df.repartitionByRange(*keys)
    numbered = ranged.sortWithinPartitions(*keys).withColumn(
        _ROW, F.monotonically_increasing_id()
    )
    # The sampled range bounds are only stable once the rows are written down.
    return stage(numbered, "ranked").withColumn(_SLOT, F.shiftright(_ROW, _ROW_BITS))


def _earlier_slots(slotted: DataFrame, group: list[str], size: Column) -> DataFrame:
    """Per group and slot: rows before it in the group, and the slot's first row."""
    per_slot = slotted.groupBy(*group, _SLOT).agg(
        size.alias("_size"), F.min(_ROW).alias("_first")
    )
    before = Window.partitionBy(*group).orderBy(_SLOT).rowsBetween(Window.unboundedPreceding, -1)
    return per_slot.select(
        *group,
        _SLOT,
        "_first",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
    )


def _with_offsets(slotted: DataFrame, offsets: DataFrame, group: list[str]) -> DataFrame:
    """Every row with the offsets of its group and slot; a null group finds its own."""
    renamed = offsets.withColumnsRenamed({c: f"_group_{i}" for i, c in enumerate(group)})
    renamed = renamed.withColumnRenamed(_SLOT, "_offset_slot")
    same = slotted[_SLOT] == renamed["_offset_slot"]
    for i, c in enumerate(group):
        same = same & slotted[c].eqNullSafe(renamed[f"_group_{i}"])
    return slotted.join(renamed, same).drop("_offset_slot", *(f"_group_{i}" for i in range(len(group))))


def position_in_group(
    df: DataFrame, group: list[str], order: list[str], out: str = "position", slots: int | None = None
) -> DataFrame:
    """Add the 1-based position of each row in its group, ascending by ``order``.

    ``order`` must be unique inside a group.  Rows whose group is null form a group, as in
    a SQL window.
    """
    slotted = _sorted_slots(df, [*group, *order], slots)
    offsets = _earlier_slots(slotted, group, F.count(F.lit(1)))
    position = F.col("_before") + F.col(_ROW) - F.col("_first") + F.lit(1)
    return (
        _with_offsets(slotted, offsets, group)
        .withColumn(out, position)
        .drop(_ROW, _SLOT, "_before", "_first")
    )


def running_total(
    df: DataFrame, group: list[str], order: list[str], weight: str, out: str, slots: int | None = None
) -> DataFrame:
    """Add the sum of ``weight`` over the rows of the group up to and including this one."""
    slotted = _sorted_slots(df, [*group, *order], slots)
    offsets = _earlier_slots(slotted, group, F.sum(weight))
    inside = Window.partitionBy(*group, _SLOT).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        _with_offsets(slotted, offsets, group)
        .withColumn(out, F.col("_before") + F.sum(weight).over(inside))
        .drop(_ROW, _SLOT, "_before", "_first")
    )
