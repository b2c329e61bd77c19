"""Exact order statistics by counting: the row at a place of a group's order, without sorting it.

A group's rows lie in a bucket.  Every round cuts the buckets that hold a wanted place into at
most ``2**(bits + 1)`` smaller ones by leading bits of the first key that still differs, counts
them (combined before the shuffle, so counts travel and rows do not), and keeps those that
hold a place.  A bucket of equal rows is settled, however many they are; once few rows are
left in all open buckets together, those are numbered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradescope.operators.staging import stage

# Buckets that hold no more rows than this altogether are settled by numbering their rows.
FEW = 100_000
_INFINITE = 2047 << 52
_NAN = 4095 << 51
_FRACTION = 1 << 52
_LEAST_NORMAL = 2.0**-1022


def ordered_bits(value: Column) -> Column:
    """A double as a long of the same order; both zeros are equal, NaN is the largest."""
    size = F.abs(value)
    guess = F.least(F.floor(F.log2(size)), F.lit(1024))
    power = F.pow(F.lit(2.0), guess)
    # The logarithm may be off by one next to a power of two.
    exponent = F.when(size < power, guess - 1).when(size >= power * 2, guess + 1).otherwise(guess)
    fraction = (size / F.pow(F.lit(2.0), exponent) * float(_FRACTION)).cast("long")
    bits = (
        F.when(F.isnan(value), F.lit(_NAN))
        .when(size == float("inf"), F.lit(_INFINITE))
        .when(size == 0, F.lit(0))
        .when(size < _LEAST_NORMAL, (size * 2.0**537 * 2.0**537).cast("long"))
        .otherwise((exponent + 1022) * _FRACTION + fraction)
    )
    return F.when(value < 0, -bits).otherwise(bits)


def from_ordered_bits(bits: Column) -> Column:
    """The double that ``ordered_bits`` took; exact."""
    size = F.abs(bits)
    exponent = F.shiftright(size, 52)
    fraction = size.bitwiseAND(F.lit(_FRACTION - 1)).cast("double")
    value = (
        F.when(size > _INFINITE, F.lit(float("nan")))
        .when(size == _INFINITE, F.lit(float("inf")))
        .when(exponent == 0, fraction * 2.0**-1074)
        .otherwise((fraction + float(_FRACTION)) * F.pow(F.lit(2.0), (exponent - 1075).cast("double")))
    )
    return F.when(bits < 0, -value).otherwise(value)


def decimal_keys(value: str) -> list[Column]:
    """A number as three longs that are ordered, one after the other, as its decimal(38,8) is."""
    whole, large = f"CAST(`{value}` AS DECIMAL(38,8))", "1000000000000BD"
    return [
        F.expr(f"{whole} DIV {large}"),
        F.expr(f"({whole} % {large}) DIV 1BD"),
        F.expr(f"CAST(({whole} % 1BD) * 100000000BD AS BIGINT)"),
    ]


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _bounds(keys: list[str]) -> list[str]:
    return [f"_{side}_{k}" for k in keys for side in ("least", "most")]


def _extent(keys: list[str]) -> list[Column]:
    return [f(k).alias(f"_{side}_{k}") for k in keys for side, f in (("least", F.min), ("most", F.max))]


def _open(keys: list[str]) -> Column:
    return ~_all([F.col(f"_least_{k}") == F.col(f"_most_{k}") for k in keys])


def _within(rows: DataFrame, buckets: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """Every row with the bucket that holds it; buckets of a group do not overlap."""
    inside = [F.col(k).between(F.col(f"_least_{k}"), F.col(f"_most_{k}")) for k in keys]
    return rows.join(buckets, group).where(_all(inside))


def _cut(buckets: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """The buckets with the first key that differs in them and how far it is shifted."""
    at = shift = F.lit(None).cast("int")
    for i, k in reversed(list(enumerate(keys))):
        least, most = F.col(f"_least_{k}"), F.col(f"_most_{k}")
        # Halves first: the distance of two longs may not be one.
        half = (F.shiftright(most, 1) - F.shiftright(least, 1)).cast("double")
        length = F.ceil(F.log2(half + 1)).cast("int") + 1
        at = F.when(least != most, F.lit(i)).otherwise(at)
        shift = F.when(least != most, F.greatest(F.lit(0), length - bits)).otherwise(shift)
    return buckets.withColumns({"_at": at, "_shift": shift})


def select_places(
    rows: DataFrame, group: list[str], keys: list[str], wanted: dict[str, Column], few: int = FEW, bits: int = 16
) -> DataFrame:
    """The keys of the rows at given places of each group's order by ``keys``.

    ``rows`` is read once per round; ``group`` and ``keys`` are columns without nulls, the
    keys longs.  ``wanted`` names places, counted from 0, as long expressions over the
    group's columns and its number of rows ``_n``.  The result has a row per group and
    name: the group, ``name``, ``place``, ``_n``, and the keys, null where no row has that place.
    """
    rows = rows.select(*group, *keys)
    box = _bounds(keys)
    bucket = [*group, *box]
    places = F.array(*[F.struct(F.lit(n).alias("name"), p.cast("long").alias("place")) for n, p in wanted.items()])
    whole = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), *_extent(keys))
    asked = stage(whole.select("*", F.inline(places)), "places")
    # ``_rank`` is the place inside the bucket, ``_size`` the bucket's number of rows.
    found = asked.where(F.col("place").between(0, F.col("_n") - 1)).select(
        *bucket, "name", F.col("place").alias("_rank"), F.col("_n").alias("_size")
    )
    settled: list[DataFrame] = []
    while True:
        settled.append(found.where(~_open(keys)).select(*group, "name", *[F.col(f"_least_{k}").alias(k) for k in keys]))
        found = found.where(_open(keys))
        buckets = found.select(*bucket, "_size").distinct()
        left = buckets.agg(F.sum("_size")).first()[0] or 0
        if left <= few:
            break
        digits = [F.when(F.col("_at") == i, F.expr(f"shiftright(`{k}`, `_shift`)")) for i, k in enumerate(keys)]
        held = _within(rows, _cut(buckets.select(*bucket), keys, bits), group, keys)
        parts = held.groupBy(*[F.col(c).alias(f"_of{c}") for c in bucket], F.coalesce(*digits).alias("_digit")).agg(
            F.count(F.lit(1)).alias("_size"), *_extent(keys)
        )
        of = [f"_of{c}" for c in bucket]
        earlier = Window.partitionBy(*of).orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        places_of = found.select(*[F.col(c).alias(f"_of{c}") for c in bucket], "name", "_rank")
        holds = (F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_size"))
        found = stage(
            parts.join(places_of, of).where(holds).select(
                *[F.col(f"_of{c}").alias(c) for c in group], *box, "name", (F.col("_rank") - F.col("_before")).alias("_rank"), "_size"
            ),
            "places",
        )
    if left:
        order = Window.partitionBy(*bucket).orderBy(*keys)
        numbered = _within(rows, buckets.select(*bucket), group, keys).withColumn("_rank", F.row_number().over(order) - F.lit(1))
        settled.append(numbered.join(found.select(*bucket, "name", "_rank"), [*bucket, "_rank"]).select(*group, "name", *keys))
    chosen = reduce(DataFrame.unionByName, settled)
    return asked.select(*group, "name", "place", "_n").join(chosen, [*group, "name"], "left")


def _between(low: Column, high: Column, part: Column) -> Column:
    """Linear interpolation, from the nearer end so that it stays monotone in doubles."""
    gap = high - low
    nearer = F.when(part < 0.5, low + gap * part).otherwise(high - gap * (F.lit(1.0) - part))
    return F.when(low == high, low).otherwise(nearer)


def group_percentile(
    df: DataFrame, group: str, value: str, share: float, out: str, few: int = FEW, bits: int = 16
) -> DataFrame:
    """Exact percentile of ``value`` per group with linear interpolation; nulls are ignored.

    Values count as doubles; NaN is the largest.  Rows without group are left out.
    """
    known = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(
        group, ordered_bits(F.col(value).cast("double")).alias("_bits")
    )
    place = F.lit(float(share)) * (F.col("_n") - F.lit(1))
    chosen = select_places(known, [group], ["_bits"], {"low": F.floor(place), "high": F.ceil(place)}, few, bits)

    def end(name: str) -> Column:
        return from_ordered_bits(F.max(F.when(F.col("name") == name, F.col("_bits"))))

    ends = chosen.groupBy(group).agg(
        end("low").alias("_low"), end("high").alias("_high"), F.max(place - F.floor(place)).alias("_part")
    )
    return ends.select(group, _between(F.col("_low"), F.col("_high"), F.col("_part")).alias(out))
