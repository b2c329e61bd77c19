"""Column helpers: coercion, safe ratios, calendar and duration arithmetic, totals.

Money and quantities are summed as decimals, so a total does not depend on the order in
which tasks deliver their rows; it becomes a double only when it leaves the aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Any number written as text: 28 digits before the point and 10 behind it.
NUMBER = T.DecimalType(38, 10)
NTZ = "timestamp_ntz"
# Digits kept when a per-row rate is averaged exactly.
RATE = T.DecimalType(28, 10)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number_or_zero(c: Column | str, dtype: T.DataType = NUMBER) -> Column:
    """Numeric value of ``c``; text that is not a number, and null, count as zero.

    A number that does not fit ``dtype`` is an error, never a zero; so is one too small for
    its digits, unless it is zero.
    """
    value = col(c).try_cast("double")
    no_number = value.isNull() | F.isnan(value)
    too_large = F.raise_error(F.concat(F.lit("number out of range: "), col(c).cast("string")))
    wide = F.coalesce(col(c).try_cast(NUMBER), too_large.cast(NUMBER))
    fitting = F.coalesce(wide.try_cast(dtype), too_large.cast(dtype))
    vanished = (value != 0) & (fitting == 0)
    kept = F.when(vanished, too_large.cast(dtype)).otherwise(fitting)
    return F.when(no_number, F.lit(0).cast(dtype)).otherwise(kept)


def numeric(df: DataFrame, name: str, dtype: T.DataType = NUMBER) -> Column:
    """The column with zero for null; numbers keep their type, everything else is converted."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DecimalType, T.IntegralType)):
        return F.coalesce(F.col(name), F.lit(0).cast(kind))
    return number_or_zero(name, dtype)


def with_numbers(df: DataFrame, columns: list[str], dtype: T.DataType = NUMBER) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: numeric(df, c, dtype) for c in present})


def to_timestamp(df: DataFrame, name: str) -> Column:
    """The column as a zone-less timestamp; unparsable text becomes null."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.col(name)
    return F.col(name).try_cast(NTZ)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as a double, null when the denominator is zero or null."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * F.lit(100.0)


def percent_2dp(part: Column, whole: Column) -> Column:
    """Percentage rounded half away from zero to two places."""
    return F.round(F.try_divide(F.lit(100.0) * part.cast("double"), whole.cast("double")), 2)


def total(c: Column | str) -> Column:
    """Sum that is zero, not null, when there is nothing to add."""
    return F.coalesce(F.sum(col(c)), F.lit(0)).cast("double")


def sql_total(c: Column | str) -> Column:
    """Sum with SQL semantics: null when there is nothing to add."""
    return F.sum(col(c)).cast("double")


def mean(c: Column | str) -> Column:
    """Mean of a decimal or integer column from its exact sum; nulls are ignored."""
    return ratio(F.sum(col(c)), F.count(col(c)))


def mean_rate(c: Column | str) -> Column:
    """Mean of a double column whose value does not depend on the order of addition."""
    return mean(col(c).cast(RATE))


def share(condition: Column) -> Column:
    """Percentage of rows where the condition holds; a null condition counts as false."""
    return percent(F.count_if(condition), F.count(F.lit(1)))


def month_start(c: Column | str) -> Column:
    return F.trunc(col(c).cast("date"), "month").cast(NTZ)


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Elapsed seconds as an exact decimal, whatever the session time zone is."""
    interval = col(end).cast(NTZ) - col(start).cast(NTZ)
    return interval.cast("interval second").cast("decimal(18,6)")


def mean_hours(seconds: Column | str) -> Column:
    return mean(seconds) / F.lit(3600.0)


def mean_days(seconds: Column | str) -> Column:
    return mean(seconds) / F.lit(86400.0)


def whole_days(seconds: Column) -> Column:
    return F.floor(seconds / F.lit(86400)).cast("long")


def days_between_dates(start: Column | str, end: Column | str) -> Column:
    return F.date_diff(col(end).cast("date"), col(start).cast("date"))


def score_1_to_5(share_of_rank: Column) -> Column:
    """A rank share in (0, 1] as a score: times five, rounded half to even, kept in 1..5."""
    rounded = F.bround(share_of_rank * F.lit(5.0), 0)
    kept = F.when(rounded < 1, F.lit(1.0)).when(rounded > 5, F.lit(5.0)).otherwise(rounded)
    return kept.cast("int")
