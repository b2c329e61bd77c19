"""Loading only what changed: a lake of cleaned tables kept up to date by date ranges.

A manifest beside the lake names every raw file with its size and time, and says which
date ranges its rows fall into and up to which date.  A refresh opens the files that came
or changed, and then those that share a range with them or with a file that went; only
these ranges are cleaned again and replaced.  Rows that are equal have equal dates, so
dropping copies inside the ranges is the same as dropping them in the whole table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from datetime import datetime
from uuid import uuid4

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradescope.functions.exprs import to_timestamp
from tradescope.operators.clean import clean_table
from tradescope.operators.staging import Store, stage, staging
from tradescope.registry import TableSpec, selected_specs, table_specs
from tradescope.sources.catalog import clustered_by_date
from tradescope.sources.parquet import RANGE, ParquetSource

REPORT_SCHEMA = (
    "table_key string, severity string, message string, "
    "files_read int, files_gone int, ranges_replaced int, high timestamp_ntz"
)
# One line per raw file and range; a file without rows has one line with no rows.
MANIFEST_SCHEMA = (
    f"file string, size long, modified long, {RANGE} int, n_rows long, high timestamp_ntz, settings string"
)
GRAINS = ("year", "month", "day")
# The range of rows without a date, and of tables without a date column.
UNDATED = 0


def refresh_lake(
    source: ParquetSource,
    root: str,
    keys: Iterable[str] | None = None,
    include_large: bool = False,
    dedup: str = "all",
    json_columns: dict[str, list[str]] | None = None,
    grain: str = "month",
) -> DataFrame:
    """Bring the lake at ``root`` up to date with the raw tables; a row per table of what was done.

    The result reads like that of ``write_lake`` over ``load`` with the same ``dedup`` and
    ``json_columns``, through ``ParquetSource``.  Ranges are the ``grain`` (year, month or
    day) of a table's first date column; rows without a date are a range of their own, and
    a table without dates is one range.  Where nothing changed, nothing is written.

    A first run, another schema and other settings write the whole table.  A refresh that was
    interrupted is finished by the next one.  A raw table that cannot be opened is reported as
    in ``load`` and its part of the lake stays as it is.  Readers of a range that is being
    replaced may fail and can be run again.  The driver holds one entry per raw file and one per
    range, no rows.
    """
    if grain not in GRAINS:
        raise ValueError(f"unknown grain: {grain}")
    specs, spark = table_specs(), source.spark
    report = []
    for key in keys if keys is not None else selected_specs(include_large):
        try:
            raw = source.read(specs[key])
        except (PySparkException, Py4JError) as problem:
            severity = "error" if specs[key].required else "warning"
            report.append((key, severity, f"{specs[key].qualified_name} could not be opened: {problem}", 0, 0, 0, None))
            continue
        with staging(spark):
            table = _Table(spark, specs[key], raw, root.rstrip("/"), dedup, (json_columns or {}).get(key), grain)
            report.append((key, *table.refresh()))
    return spark.createDataFrame(report, REPORT_SCHEMA)


def _files(df: DataFrame) -> dict[str, tuple[int, int]]:
    """Size and time of every file below a frame, by the name its rows carry."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = {}
    for i in range(leaves.size()):
        states = leaves.apply(i).relation().location().allFiles()
        for k in range(states.size()):
            state = states.apply(k)
            name = path(state.getPath().toString()).toUri().toString()
            found[name] = (state.getLen(), state.getModificationTime())
    return found


class _Table:
    """One table of the lake and its manifest."""

    def __init__(
        self,
        spark: SparkSession,
        spec: TableSpec,
        raw: DataFrame,
        root: str,
        dedup: str,
        json_columns: list[str] | None,
        grain: str,
    ):
        self.spark, self.spec, self.raw = spark, spec, raw
        self.dedup, self.json_columns, self.grain = dedup, json_columns, grain
        self.date = next((c for c in spec.date_columns if c in raw.columns), None)
        self.folder = f"{root}/{spec.namespace}/{spec.name}"
        self.notes = f"{root}/_manifest/{spec.namespace}/{spec.name}"
        self.store = Store.of(spark)
        wanted = repr((raw.schema.json(), dedup, sorted(json_columns or []), grain, self.date))
        self.settings = hashlib.sha256(wanted.encode()).hexdigest()

    def refresh(self) -> tuple:
        now = _files(self.raw)
        version, known = self._known()
        pending = self._pending()
        before = {r.file: (r.size, r.modified) for r in known.select("file", "size", "modified").distinct().collect()}
        fresh = [f for f in now if before.get(f) != now[f]]
        stale = [f for f in before if now.get(f) != before[f]]
        gone = sum(f not in now for f in stale)
        if version and not fresh and not stale and not pending:
            return "info", "unchanged", 0, 0, 0, _high(known)
        lines = stage(self._lines(fresh, now).unionByName(known.where(~F.col("file").isin(stale))), "manifest")
        filled = lines.where("n_rows > 0")
        if known.where("n_rows > 0").isEmpty() or filled.isEmpty():
            # Nothing of what is there stays.
            self.store.delete(self.notes)
            self._write_whole(filled.isEmpty())
            read, replaced = len(now), filled.select(RANGE).distinct().count()
        else:
            touched = known.where(F.col("file").isin(stale)).unionByName(lines.where(F.col("file").isin(fresh)))
            ranges = {r[RANGE] for r in touched.where("n_rows > 0").select(RANGE).distinct().collect()} | pending
            concerned = filled.where(F.col(RANGE).isin(list(ranges)))
            files = [r.file for r in concerned.select("file").distinct().collect()]
            left = {r[RANGE] for r in concerned.select(RANGE).distinct().collect()}
            self._announce(ranges)
            self._replace(files, ranges)
            for emptied in ranges - left:
                self.store.delete(f"{self.folder}/{RANGE}={emptied}")
            read, replaced = len(files), len(ranges)
        lines.coalesce(1).write.parquet(f"{self.notes}/state-{version + 1:09d}")
        # From here on the new manifest counts.
        for name in self._names("pending-") + [n for n in self._names("state-") if int(n[6:]) <= version]:
            self.store.delete(f"{self.notes}/{name}")
        return "info", "refreshed", read, gone, replaced, _high(lines)

    # --- rows ----------------------------------------------------------------------

    def _range(self, df: DataFrame) -> Column:
        if self.date is None:
            return F.lit(UNDATED)
        date = to_timestamp(df, self.date)
        number = F.year(date)
        if self.grain != "year":
            number = number * 100 + F.month(date)
        if self.grain == "day":
            number = number * 100 + F.dayofmonth(date)
        return F.coalesce(number, F.lit(UNDATED))

    def _cleaned(self, rows: DataFrame) -> DataFrame:
        cleaned = clean_table(rows, self.spec.key, self.dedup, self.json_columns)
        laid_out = clustered_by_date(cleaned, self.date) if self.date else cleaned
        return laid_out.withColumn(RANGE, self._range(laid_out))

    def _write_whole(self, empty: bool) -> None:
        rows = self._cleaned(self.raw)
        if empty:
            # A file for the columns; partitions would leave none.
            rows.drop(RANGE).limit(0).write.mode("overwrite").parquet(self.folder)
        else:
            rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(RANGE).parquet(self.folder)

    def _replace(self, files: list[str], ranges: set[int]) -> None:
        held = self.raw.where(F.col("_metadata.file_path").isin(files))
        rows = self._cleaned(held.where(self._range(held).isin(list(ranges))))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RANGE).parquet(self.folder)

    # --- the manifest --------------------------------------------------------------

    def _lines(self, fresh: list[str], now: dict[str, tuple[int, int]]) -> DataFrame:
        states = self.spark.createDataFrame([(f, *now[f]) for f in fresh], "file string, size long, modified long")
        rows = self.raw if len(fresh) == len(now) else self.raw.where(F.col("_metadata.file_path").isin(fresh))
        high = to_timestamp(rows, self.date) if self.date else F.lit(None).cast("timestamp_ntz")
        found = rows.select(F.col("_metadata.file_path").alias("file"), self._range(rows).alias(RANGE), high.alias("high"))
        counts = found.groupBy("file", RANGE).agg(F.count(F.lit(1)).alias("n_rows"), F.max("high").alias("high"))
        return states.join(counts, "file", "left").select(
            "file", "size", "modified", F.coalesce(RANGE, F.lit(UNDATED)).alias(RANGE),
            F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), "high", F.lit(self.settings).alias("settings"),
        )

    def _names(self, kind: str) -> list[str]:
        """Finished folders of one kind beside the lake, in order."""
        files, notes = self.store.at(self.notes)
        if not files.exists(notes):
            return []
        names = (s.getPath().getName() for s in files.listStatus(notes))
        whole = (n for n in names if files.exists(self.store.at(f"{self.notes}/{n}/_SUCCESS")[1]))
        return sorted(n for n in whole if n.startswith(kind))

    def _known(self) -> tuple[int, DataFrame]:
        """The manifest that counts and its version; none (0) where the table is to be written whole."""
        states = self._names("state-")
        if states:
            version = int(states[-1].removeprefix("state-"))
            known = self.spark.read.schema(MANIFEST_SCHEMA).parquet(f"{self.notes}/{states[-1]}")
            if known.where(F.col("settings") != self.settings).isEmpty():
                # A half-written successor.
                self.store.delete(f"{self.notes}/state-{version + 1:09d}")
                return version, known
        self.store.delete(self.notes)
        return 0, self.spark.createDataFrame([], MANIFEST_SCHEMA)

    def _announce(self, ranges: set[int]) -> None:
        """Note which ranges are about to be replaced, for whoever finds this refresh interrupted."""
        noted = self.spark.createDataFrame([(r,) for r in sorted(ranges)], f"{RANGE} int")
        noted.coalesce(1).write.parquet(f"{self.notes}/pending-{uuid4().hex}")

    def _pending(self) -> set[int]:
        found = (self.spark.read.parquet(f"{self.notes}/{n}").collect() for n in self._names("pending-"))
        return {r[RANGE] for rows in found for r in rows}


def _high(lines: DataFrame) -> datetime | None:
    return lines.agg(F.max("high").alias("high")).first().high
