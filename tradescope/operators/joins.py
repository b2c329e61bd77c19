"""The left lookup join used throughout.

No broadcast hint is given: Catalyst broadcasts a side only when its measured size is
under the session's threshold and otherwise shuffles both sides, where adaptive skew
handling may split a hot key on the left.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame

from tradescope.dataset import Dataset


def lookup(
    left: DataFrame,
    right: DataFrame,
    on: str,
    columns: list[str] | None = None,
    suffix: str = "_right",
    right_key: str | None = None,
    taken: Collection[str] = (),
) -> DataFrame:
    """Left join ``right`` by key, keeping ``columns`` of it (all of them by default).

    A name that both sides share, or that is ``taken`` elsewhere, gets ``suffix`` on the
    right.
    """
    key = right_key or on
    wanted = [c for c in right.columns if c != key and (columns is None or c in columns)]
    renamed = {c: c + suffix for c in wanted if c in left.columns or c in taken}
    side = right.select(key, *wanted).withColumnsRenamed(renamed)
    if key == on:
        return left.join(side, on, "left")
    if key not in left.columns:
        return left.join(side, left[on] == side[key], "left")
    side = side.withColumnRenamed(key, "_key")
    return left.join(side, left[on] == side["_key"], "left").drop("_key")


def named_by(
    left: DataFrame,
    ds: Dataset,
    key: str,
    on: str,
    columns: list[str] | None = None,
    suffix: str = "_right",
) -> DataFrame:
    """``lookup_table``, but a table without rows counts as missing, so the id stays the name."""
    return lookup_table(left, ds, key, on, columns, suffix) if ds.has_rows(key) else left


def lookup_table(
    left: DataFrame,
    ds: Dataset,
    key: str,
    on: str,
    columns: list[str] | None = None,
    suffix: str = "_right",
    taken: Collection[str] = (),
) -> DataFrame:
    """``lookup`` into a table of the dataset; a no-op when table or key is missing."""
    if key not in ds or on not in left.columns or on not in ds[key].columns:
        return left
    return lookup(left, ds[key], on, columns, suffix, taken=taken)
