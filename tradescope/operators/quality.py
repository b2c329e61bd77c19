"""Validation and profiling of the loaded tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradescope.dataset import Dataset
from tradescope.operators.clean import DIGEST, digest_columns, with_digest
from tradescope.operators.prints import count_prints, fingerprint
from tradescope.operators.staging import stage
from tradescope.registry import table_specs

# Status labels of the required-table check.
AVAILABLE, MISSING = "Available", "Missing or empty"


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def row_count(df: DataFrame, out: str = "row_count") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(out))


def validate_required(ds: Dataset, profile: str = "validation") -> DataFrame:
    """One row per required table: key, database table, status and row count."""
    rows = []
    for key, spec in table_specs(profile).items():
        if not spec.required:
            continue
        counted = row_count(ds.table(key))
        rows.append(
            counted.select(
                F.lit(key).alias("table_key"),
                F.lit(spec.qualified_name).alias("database_table"),
                F.when(F.col("row_count") > 0, AVAILABLE).otherwise(MISSING).alias("status"),
                "row_count",
            )
        )
    return _stack(rows)


def _null_cells(df: DataFrame) -> Column:
    """Cells of a row that hold nothing, NaN included."""

    def missing(field: T.StructField) -> Column:
        empty = F.col(field.name).isNull()
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            empty = empty | F.isnan(field.name)
        return empty.cast("long")

    return reduce(lambda a, b: a + b, map(missing, df.schema))


def _prints(number: int, df: DataFrame, json_columns: list[str] | None) -> DataFrame:
    high = digest_columns(df, json_columns)[0]
    return df.select(F.lit(number).alias("_table"), fingerprint(high).alias("_print"), _null_cells(df).alias("_nulls"))


def _whole_rows(folded: DataFrame, number: int, df: DataFrame, json_columns: list[str] | None, every: bool) -> DataFrame:
    """Number of different rows among those whose fingerprint occurs more than once, or among ``every`` row."""
    marked, keys = with_digest(df, json_columns)
    compared = [F.col(f"`{k}`") for k in keys]
    if not every:
        marked = marked.withColumn("_print", fingerprint(F.col(DIGEST[0])))
        repeated = folded.where((F.col("_table") == number) & F.col("_print").isNotNull()).select("_print")
        marked = marked.join(repeated, "_print", "left_semi")
        # Where rows have met by their fingerprint, they are compared where they are.
        compared = [F.col("_print"), *compared]
    return (
        marked.groupBy(*compared)
        .agg(F.lit(1).alias("_one"))
        .agg(F.count(F.lit(1)).alias("_different"))
        .select(F.lit(number).alias("_table"), "_different")
    )


def _profiles(tables: list[tuple[str, DataFrame, list[str] | None]]) -> DataFrame:
    """The profile rows of tables: six bytes of fingerprint a row travel, and whole rows of repeated ones.

    All tables are counted in one pass, when this is called: fingerprints that occur once fold
    into one row a table, the others keep theirs.  What shares a fingerprint is then compared
    whole; so is a table with more rows of repeated fingerprints than others, at once and without a join.
    """
    rows = reduce(DataFrame.union, (_prints(i, df, nested) for i, (_, df, nested) in enumerate(tables)))
    sums = [F.sum(c).alias(c) for c in ("_rows", "_nulls", "_once")]
    folded = stage(count_prints(rows).groupBy("_table", "_print").agg(*sums, F.count("_print").alias("_several")), "profile")
    of_table = folded.groupBy("_table").agg(
        F.sum("_rows").alias("rows"), F.sum("_nulls").alias("nulls"), F.sum("_once").alias("once"), F.sum("_several").alias("several")
    )
    # At most a row a table.
    doubtful = {r["_table"]: r["rows"] > 2 * r["once"] for r in of_table.where("several > 0").collect()}
    names = folded.sparkSession.createDataFrame(
        [(i, key, len(df.columns), doubtful.get(i, False)) for i, (key, df, _) in enumerate(tables)],
        "_table int, table_key string, columns long, every boolean",
    )
    measured = names.join(of_table, "_table", "left")
    if doubtful:
        whole = _stack(
            [_whole_rows(folded, i, df, nested, doubtful[i]) for i, (_, df, nested) in enumerate(tables) if i in doubtful]
        )
        measured = measured.join(whole, "_table", "left")
    else:
        measured = measured.withColumn("_different", F.lit(0))
    # Where every row was compared, the others are among them.
    measured = measured.withColumn("once", F.when(~F.col("every"), F.col("once")))
    zero = F.lit(0)
    measured = measured.select(
        "table_key",
        F.coalesce("rows", zero).alias("rows"),
        "columns",
        F.coalesce("nulls", zero).alias("nulls"),
        (F.coalesce("once", zero) + F.coalesce("_different", zero)).alias("distinct_rows"),
    )
    cells = F.greatest(F.col("rows") * F.col("columns"), F.lit(1))
    missing = F.col("nulls").cast("double") / cells * F.lit(100.0)
    return measured.select(
        "table_key",
        "rows",
        "columns",
        # rint rounds the binary value half to even; bround would round its printed form.
        (F.rint(missing * F.lit(100.0)) / F.lit(100.0)).alias("missing_cell_rate_pct"),
        (F.col("rows") - F.col("distinct_rows")).alias("duplicate_rows_after_cleaning"),
    )


def profile_table(df: DataFrame, key: str, json_columns: list[str] | None = None) -> DataFrame:
    """Rows, columns, missing-cell rate and remaining duplicates of one table."""
    return _profiles([(key, df, json_columns)])


def quality_profile(ds: Dataset, json_columns: dict[str, list[str]] | None = None) -> DataFrame:
    """The profile of every table, by table key."""
    nested = json_columns or {}
    tables = [(key, df, nested.get(key)) for key, df in ds.items()]
    return _profiles(tables).orderBy("table_key")


def date_coverage(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias(f"first_{column}"), F.max(column).alias(f"last_{column}"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("duplicate_count"))
        .where(F.col("duplicate_count") > 1)
        .orderBy(F.col("duplicate_count").desc(), key)
    )


# --- Catalog views of the tables a session has registered -----------------------------


def schemas(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW SCHEMAS").select(F.col("namespace").alias("schema_name")).orderBy("schema_name")


def tables(spark: SparkSession, schema_names: list[str] | None = None) -> DataFrame:
    """(table_schema, table_name) of the base tables, optionally of some schemas only."""
    wanted = schema_names or [db.name for db in spark.catalog.listDatabases()]
    rows = [
        (db.name, table.name)
        for db in spark.catalog.listDatabases()
        if db.name in wanted
        for table in spark.catalog.listTables(db.name)
        if not table.isTemporary
    ]
    listing = spark.createDataFrame(rows, "table_schema string, table_name string")
    return listing.orderBy("table_schema", "table_name")


def tables_per_schema(spark: SparkSession) -> DataFrame:
    return (
        tables(spark)
        .groupBy("table_schema")
        .agg(F.count(F.lit(1)).alias("table_count"))
        .orderBy("table_schema")
    )
