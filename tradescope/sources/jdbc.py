"""Tables in PostgreSQL, read through Spark's JDBC source."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from datetime import datetime
from decimal import Decimal
from urllib.parse import quote, urlencode

from pyspark.sql import DataFrame, SparkSession

from tradescope.registry import TableSpec


@dataclass(frozen=True)
class PostgresConnection:
    host: str
    port: int
    database: str
    user: str
    password: str
    sslmode: str = "require"

    def options(self) -> dict[str, str]:
        """Reader options; user and password stay out of the URL, so they need no quoting."""
        query = urlencode({"sslmode": self.sslmode})
        return {
            "url": f"jdbc:postgresql://{self.host}:{int(self.port)}/{quote(self.database, safe='')}?{query}",
            "user": str(self.user),
            "password": str(self.password),
            "driver": "org.postgresql.Driver",
        }

    def __repr__(self) -> str:
        return f"PostgresConnection({self.user}@{self.host}:{self.port}/{self.database})"


@dataclass(frozen=True)
class Split:
    """How a large table is cut into parallel range reads on a numeric or date column."""

    column: str
    lower: str
    upper: str
    parts: int

    def options(self) -> dict[str, str]:
        return {
            "partitionColumn": self.column,
            "lowerBound": str(self.lower),
            "upperBound": str(self.upper),
            "numPartitions": str(self.parts),
        }


@dataclass(frozen=True)
class DateSplit:
    """How a table without an id is cut into parallel reads: by ranges of a date column.

    Given to the reader as conditions, since its own ranges take no zone-less timestamps.
    """

    column: str
    lower: datetime
    upper: datetime
    parts: int

    def predicates(self) -> list[str]:
        """One condition per read; the first also takes rows without a date."""
        name, step = _quoted(self.column), (self.upper - self.lower) / self.parts
        edges = [self.lower + step * k for k in range(1, self.parts)] if step else []
        if not edges:
            return ["1 = 1"]
        return _between(name, edges)


@dataclass(frozen=True)
class HistogramSplit:
    """How a table is cut into reads of about equal size: at quantiles the server knows.

    ``edges`` ascend; a value in ``hot`` alone fills reads of its own, which are cut once more
    by ranges of ``blocks`` blocks of the table.  Out-of-date statistics make the reads uneven, never
    incomplete: the outer ranges are open.
    """

    column: str
    edges: tuple[str, ...]
    # Hot values with the number of reads each is to have.
    hot: tuple[tuple[str, int], ...] = ()
    blocks: int = 0

    def predicates(self) -> list[str]:
        name = _quoted(self.column)
        ranges = _between(name, list(self.edges)) if self.edges else ["1 = 1"]
        if not self.hot:
            return ranges
        values = ", ".join(f"'{value}'" for value, _ in self.hot)
        others = [f"({r}) AND ({name} NOT IN ({values}) OR {name} IS NULL)" for r in ranges]
        apart = [
            f"{name} = '{value}' AND {part}" if part else f"{name} = '{value}'"
            for value, reads in self.hot
            for part in (BlockSplit(self.blocks, reads).predicates() if self.blocks else [""])
        ]
        return others + apart


@dataclass(frozen=True)
class BlockSplit:
    """How a table with neither id nor date is cut: by ranges of its physical blocks.

    The server scans only the blocks of a range (PostgreSQL 14 or later).  A row that is
    updated while the table is read moves to another block, as it may move between ranges of
    any column that is updated.
    """

    blocks: int
    parts: int

    def predicates(self) -> list[str]:
        edges = sorted({self.blocks * k // self.parts for k in range(1, self.parts)} - {0})
        if not edges:
            return ["1 = 1"]
        at = [f"'({e},0)'::tid" for e in edges]
        inner = [f"ctid >= {a} AND ctid < {b}" for a, b in zip(at, at[1:], strict=False)]
        return [f"ctid < {at[0]}", *inner, f"ctid >= {at[-1]}"]


def _between(name: str, edges: list) -> list[str]:
    """One condition per range between ascending edges; the first also takes nulls."""
    inner = [f"{name} >= '{a}' AND {name} < '{b}'" for a, b in zip(edges, edges[1:], strict=False)]
    return [f"{name} < '{edges[0]}' OR {name} IS NULL", *inner, f"{name} >= '{edges[-1]}'"]


# Server types whose values are ordered here as the server orders them: by number, or as ISO text.
_NUMBERS = ("smallint", "integer", "bigint", "numeric")
_DATES = ("date", "timestamp without time zone")
_ISO = re.compile(r"\d{4}-\d\d-\d\d( \d\d:\d\d:\d\d(\.\d+)?)?")


def histogram_split(
    column: str,
    kind: str,
    bounds: list[str],
    common: list[tuple[str, float]],
    empty_share: float,
    parts: int,
    blocks: int,
) -> HistogramSplit | None:
    """Equal-count ranges from a column's statistics; None where those say too little.

    ``bounds`` cut the values that are not ``common`` into shares of equal size, ``common`` holds
    frequent values with their share of all rows.  A common value that fills more than
    one read by itself is read apart.  Values whose order is only known to the server (other
    types, dates before the year 1 or after 9999) give none.
    """
    values = [*bounds, *(value for value, _ in common)]
    if kind not in _NUMBERS and not (kind in _DATES and all(_ISO.fullmatch(v) for v in values)):
        return None
    order = Decimal if kind in _NUMBERS else str
    hot = tuple((value, math.ceil(share * parts)) for value, share in common if share * parts > 1)
    # Share of rows from a value up to the next one.
    shares = {value: share for value, share in common if share * parts <= 1}
    rest = max(0.0, 1.0 - empty_share - sum(share for _, share in common))
    for value in bounds[:-1]:
        shares[value] = shares.get(value, 0.0) + rest / (len(bounds) - 1)
    left = max(1, parts - sum(reads for _, reads in hot))
    total, reached, level, edges = sum(shares.values()), 0.0, 0, []
    for value in sorted(shares, key=order):
        due = int(reached * left / total + 1e-9) if total else 0
        if due > level:
            edges.append(value)
            level = due
        reached += shares[value]
    return HistogramSplit(column, tuple(edges), hot, blocks) if edges or hot else None


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


AnySplit = Split | DateSplit | HistogramSplit | BlockSplit


def quoted_name(spec: TableSpec) -> str:
    return f"{_quoted(spec.namespace)}.{_quoted(spec.name)}"


class PostgresSource:
    """Whole-table reads; filters and column lists of the plan are pushed to the server.

    A table is read in ``parts`` ranges of its registry's split column (an id or a date)
    side by side: ranges of about equal size where the server has statistics of the column
    (after ANALYZE), else ranges of equal width between its bounds.  A table with neither id
    nor date is read in ranges of its blocks.  ``splits`` overrules this for a table.  Rows
    without a value belong to the first range.

    The reads are statements of their own, so what is written meanwhile may be seen by some of
    them only.
    """

    def __init__(
        self,
        spark: SparkSession,
        connection: PostgresConnection,
        splits: dict[str, AnySplit] | None = None,
        parts: int = 64,
        fetch_size: int = 10_000,
    ):
        self.spark = spark
        self.connection = connection
        self.splits = splits or {}
        self.parts = parts
        self.fetch_size = fetch_size

    def _query(self, text: str) -> DataFrame:
        reader = self.spark.read.format("jdbc").options(**self.connection.options())
        return reader.option("query", text).load()

    def bounds_query(self, spec: TableSpec, column: str) -> str:
        name = _quoted(column)
        return f"SELECT min({name}) AS low, max({name}) AS high FROM {quoted_name(spec)}"

    def statistics_query(self, spec: TableSpec, column: str) -> str:
        """The server's statistics of a column as texts, with the number of blocks of the table."""
        place = f"schemaname = {_text(spec.namespace)} AND tablename = {_text(spec.name)}"
        return (
            "SELECT histogram_bounds::text::text[] AS bounds, most_common_vals::text::text[] AS common_values, "
            "most_common_freqs::float8[] AS common_shares, null_frac::float8 AS empty_share, "
            f"({self.type_query(spec, column)}) AS kind, "
            f"({self.blocks_query(spec)}) AS blocks FROM pg_stats "
            f"WHERE {place} AND attname = {_text(column)} AND NOT inherited"
        )

    def type_query(self, spec: TableSpec, column: str) -> str:
        place = f"table_schema = {_text(spec.namespace)} AND table_name = {_text(spec.name)}"
        return f"SELECT data_type FROM information_schema.columns WHERE {place} AND column_name = {_text(column)}"

    def blocks_query(self, spec: TableSpec) -> str:
        """The number of blocks of a table; 0 for views and partitioned tables."""
        name = _text(quoted_name(spec))
        return f"SELECT pg_relation_size({name}::regclass) / current_setting('block_size')::int AS blocks"

    def split(self, spec: TableSpec) -> AnySplit | None:
        """The split of a table, from one row of statistics; none for an empty table."""
        column = spec.split
        if spec.key in self.splits:
            return self.splits[spec.key]
        if column is None:
            blocks = self._query(self.blocks_query(spec)).first()
            return BlockSplit(blocks["blocks"], self.parts) if blocks and blocks["blocks"] else None
        known = self._query(self.statistics_query(spec, column)).first()
        if known is not None:
            common = list(zip(known["common_values"] or [], known["common_shares"] or [], strict=True))
            shares = known["bounds"] or [], common, known["empty_share"]
            found = histogram_split(column, known["kind"], *shares, self.parts, known["blocks"])
            if found is not None:
                return found
        bounds = self._query(self.bounds_query(spec, column)).first()
        if bounds is None or bounds["low"] is None:
            return None
        if isinstance(bounds["low"], datetime):
            return DateSplit(column, bounds["low"], bounds["high"], self.parts)
        return Split(column, str(bounds["low"]), str(bounds["high"]), self.parts)

    def options(self, spec: TableSpec, split: Split | None = None) -> dict[str, str]:
        chosen = {
            **self.connection.options(),
            "dbtable": quoted_name(spec),
            "fetchsize": str(self.fetch_size),
            "preferTimestampNTZ": "true",
        }
        if split:
            chosen.update(split.options())
        return chosen

    def read(self, spec: TableSpec) -> DataFrame:
        split = self.split(spec)
        if split is not None and not isinstance(split, Split):
            options = self.options(spec)
            place = options.pop("url"), options.pop("dbtable")
            return self.spark.read.jdbc(*place, predicates=split.predicates(), properties=options)
        return self.spark.read.format("jdbc").options(**self.options(spec, split)).load()

    def probe(self) -> DataFrame:
        """Database, user and server time, as one row."""
        return self._query(
            "SELECT current_database() AS database, current_user AS db_user, "
            "CURRENT_TIMESTAMP AS server_time"
        )


def probe_session(spark: SparkSession) -> DataFrame:
    """The same status row for the Spark catalog."""
    return spark.sql(
        "SELECT current_database() AS database, current_user() AS db_user, "
        "current_timestamp() AS server_time"
    )
