"""Text rendering of numbers and HTML escaping, all as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradescope.functions.exprs import col

# --- Fixed values: currency sign, scale steps with their suffix and decimals ---------
RUPEE = "₹"
_CURRENCY_STEPS = [(1e7, " Cr", 2), (1e5, " L", 2), (1e3, " K", 1)]
_MISSING = "N/A"
_HTML_ENTITIES = [
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ('"', "&quot;"),
    ("'", "&#x27;"),
]
# --- End of fixed values -------------------------------------------------------------


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def grouped(value: Column | str, digits: int = 0) -> Column:
    """A number with thousands separators."""
    return F.format_number(col(value), digits)


def fixed(value: Column | str, digits: int) -> Column:
    """A number without separators, rounded like the exact binary value, half to even."""
    return F.call_function("format_number", col(value), F.lit("0." + "0" * digits))


def currency(value: Column | str) -> Column:
    """Rupee amount in crore, lakh or thousand, by the size of its absolute value."""
    v = col(value).cast("double")
    text = F.concat(F.lit(RUPEE), grouped(v))
    for step, suffix, digits in reversed(_CURRENCY_STEPS):
        scaled = F.concat(F.lit(RUPEE), grouped(v / F.lit(step), digits), F.lit(suffix))
        text = F.when(F.abs(v) >= F.lit(step), scaled).otherwise(text)
    return F.when(_finite(v), text).otherwise(F.lit(_MISSING))


def percent_text(value: Column | str) -> Column:
    v = col(value).cast("double")
    return F.when(_finite(v), F.concat(fixed(v, 2), F.lit("%"))).otherwise(F.lit(_MISSING))


def html_escape(value: Column | str) -> Column:
    return reduce(
        lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])),
        _HTML_ENTITIES,
        col(value),
    )
