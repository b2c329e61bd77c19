"""Cleaning: date standardisation and exact-row de-duplication."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradescope.dataset import Dataset
from tradescope.functions.exprs import to_timestamp
from tradescope.operators.staging import stage
from tradescope.registry import table_specs

# Columns of a row's digest.
DIGEST = ("_digest_high", "_digest_low")


def standardise_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: to_timestamp(df, c) for c in columns if c in df.columns})


def canonical_json(c: Column) -> Column:
    """JSON text with object keys in a fixed order; other text passes through."""
    return F.coalesce(F.to_json(F.try_parse_json(c)), c)


def _unordered(dtype: T.DataType) -> bool:
    """Whether values of the type cannot be grouped by as they are, at any depth."""
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return True
    if isinstance(dtype, T.ArrayType):
        return _unordered(dtype.elementType)
    return isinstance(dtype, T.StructType) and any(_unordered(f.dataType) for f in dtype)


def _grouping_form(value: Column, dtype: T.DataType) -> Column:
    """A value that can be grouped by and is equal for equal content.

    Maps become sorted arrays of entries and variants text, inside arrays and structs too.
    """
    if not _unordered(dtype):
        return value
    if isinstance(dtype, T.VariantType):
        return F.to_json(value)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: _grouping_form(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        fields = [_grouping_form(value[f.name], f.dataType).alias(f.name) for f in dtype]
        return F.when(value.isNotNull(), F.struct(*fields))
    entries = F.transform(
        F.map_entries(value),
        lambda e: F.struct(
            _grouping_form(e["key"], dtype.keyType).alias("key"),
            _grouping_form(e["value"], dtype.valueType).alias("value"),
        ),
    )
    return F.array_sort(entries)


def _duplicate_key(df: DataFrame, name: str, json_columns: list[str]) -> Column:
    if name in json_columns:
        return canonical_json(F.col(name))
    return _grouping_form(F.col(name), df.schema[name].dataType)


def _needs_key(df: DataFrame, json_columns: list[str]) -> list[str]:
    return [f.name for f in df.schema if _unordered(f.dataType) or f.name in json_columns]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def digest_columns(df: DataFrame, json_columns: list[str] | None = None) -> list[Column]:
    """The 128-bit digest of a row, as the columns ``DIGEST``.

    It is taken over the grouping forms of the cells.  Which cells are null is hashed as well,
    since a hash of several columns passes over nulls.
    """
    cells = [_duplicate_key(df, c, json_columns or []) for c in df.columns]
    empty = [F.col(_quoted(c)).isNull().cast("long") for c in df.columns]
    nulls = [
        reduce(lambda bits, cell: bits * 2 + cell, empty[i : i + 60], F.lit(0).cast("long")) for i in range(0, len(empty), 60)
    ]
    hashes = (F.xxhash64(*nulls, *cells), F.xxhash64(*reversed(cells), *nulls, F.lit(7)))
    return [h.alias(c) for h, c in zip(hashes, DIGEST, strict=True)]


def with_digest(df: DataFrame, json_columns: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The rows with their digest, and the columns to compare rows by.

    Columns that cannot be compared as they are get a grouping form beside them.
    """
    forms = {c: f"_key_{i}" for i, c in enumerate(_needs_key(df, json_columns or []))}
    added = [_duplicate_key(df, c, json_columns or []).alias(form) for c, form in forms.items()]
    marked = df.select("*", *added, *digest_columns(df, json_columns))
    return marked, [forms.get(c, c) for c in df.columns]


def drop_duplicate_rows(df: DataFrame, json_columns: list[str] | None = None) -> DataFrame:
    """One of each set of identical rows; nested values compare by content, not key order.

    Two phases.  Digests of the rows are counted when this is called: sixteen bytes a row
    travel, added up before they do.  Then only rows whose digest occurs more than once
    travel and are compared whole, so different rows of one digest stay.  Their copies are
    dropped before that shuffle as well as after it, so a row that is repeated without end
    reaches one task only once per input partition.  Where most digests occur more than once,
    all rows are compared whole at once, with the same result.
    """
    marked, keys = with_digest(df, json_columns)
    digest = list(DIGEST)
    counted = df.select(*digest_columns(df, json_columns)).groupBy(*digest).agg(F.count(F.lit(1)).alias("_times"))
    several = F.col("_times") > 1
    # Digests that occur once become one row.
    either = [F.when(several, F.col(c)).alias(c) for c in digest]
    folded = stage(counted.groupBy(*either).agg(F.count(F.lit(1)).alias("_digests")), "repeated")
    known = F.col(digest[0]).isNotNull()
    sizes = folded.groupBy(known.alias("repeated")).agg(F.sum("_digests").alias("n")).collect()
    many, once = (sum(r.n for r in sizes if r.repeated is kind) for kind in (True, False))
    if not many:
        return df
    if many > once:
        return marked.dropDuplicates(keys).select(*map(_quoted, df.columns))
    repeated = folded.where(known).select(*digest)
    alone = marked.join(repeated, digest, "left_anti")
    copied = marked.join(repeated, digest, "left_semi").dropDuplicates(keys)
    return alone.unionByName(copied).select(*map(_quoted, df.columns))


def clean_table(
    df: DataFrame,
    key: str,
    dedup: str = "all",
    json_columns: list[str] | None = None,
) -> DataFrame:
    spec = table_specs().get(key)
    dates = spec.date_columns if spec else []
    cleaned = standardise_dates(df, dates)
    if dedup == "all" or (dedup == "dated" and dates):
        return drop_duplicate_rows(cleaned, json_columns)
    return cleaned


def clean_dataset(
    ds: Dataset, dedup: str = "all", json_columns: dict[str, list[str]] | None = None
) -> Dataset:
    """Clean every table.

    ``dedup``: ``all`` tables, only the ``dated`` ones (tables with a date column), or
    ``none``.
    """
    if dedup not in ("all", "dated", "none"):
        raise ValueError(f"unknown dedup mode: {dedup}")
    nested = json_columns or {}
    # Looking for copies reads a table, so each is cleaned when it is first asked for.
    return Dataset(ds.spark, {key: partial(_cleaned, ds, key, dedup, nested.get(key)) for key in ds})


def _cleaned(ds: Dataset, key: str, dedup: str, json_columns: list[str] | None) -> DataFrame:
    return clean_table(ds[key], key, dedup, json_columns)
