from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradescope.functions import exprs, text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


def test_ratio_of_zero_or_null_denominator_is_null(spark):
    assert one(spark, exprs.ratio(F.lit(3), F.lit(0))) is None
    assert one(spark, exprs.ratio(F.lit(3), F.lit(None))) is None
    assert one(spark, exprs.percent(F.lit(1), F.lit(8))) == 12.5


def test_text_numbers_become_zero_when_they_do_not_parse(spark):
    df = spark.createDataFrame([("12.5",), ("x",), (None,)], "a string")
    values = [float(r.v) for r in df.select(exprs.number_or_zero("a").alias("v")).collect()]
    assert values == [12.5, 0.0, 0.0]


@pytest.mark.parametrize(
    "raw, parsed",
    [("2024-02-29 10:00:00", datetime(2024, 2, 29, 10)), ("2024-02-30", None), ("x", None), (None, None)],
)
def test_unparsable_dates_become_null(spark, raw, parsed):
    df = spark.createDataFrame([(raw,)], "d string")
    assert df.select(exprs.to_timestamp(df, "d").alias("v")).collect()[0].v == parsed


def test_sums_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "a long")
    row = df.agg(exprs.total("a").alias("zero"), exprs.sql_total("a").alias("null")).collect()[0]
    assert row.zero == 0.0 and row.null is None


def test_share_counts_a_null_condition_as_false(spark):
    df = spark.createDataFrame([("200",), ("404",), (None,), ("abc",)], "s string")
    failed = F.col("s").try_cast("long") >= 400
    assert df.agg(exprs.share(failed).alias("v")).collect()[0].v == 25.0


def test_durations_ignore_daylight_saving_of_the_session_zone(spark):
    # New York skips an hour on 2024-03-10; a zone-less clock does not.
    df = spark.sql("SELECT timestamp_ntz'2024-03-10 00:00:00' a, timestamp_ntz'2024-03-10 06:00:00.5' b")
    assert float(df.select(exprs.seconds_between("a", "b").alias("v")).collect()[0].v) == 21600.5
    assert df.agg(exprs.mean_hours(exprs.seconds_between("a", "b")).alias("v")).collect()[0].v == 21600.5 / 3600


def test_whole_days_round_down(spark):
    assert one(spark, exprs.whole_days(F.lit(-1).cast("decimal(18,6)"))) == -1
    assert one(spark, exprs.whole_days(F.lit(86399).cast("decimal(18,6)"))) == 0


def test_month_start_of_a_zone_less_timestamp(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-03-31 23:59:59' a")
    assert df.select(exprs.month_start("a").alias("v")).collect()[0].v == datetime(2024, 3, 1)


@pytest.mark.parametrize(
    "share, score", [(0.0, 1), (0.1, 1), (0.3, 2), (0.5, 2), (0.7, 4), (0.9, 4), (1.0, 5), (None, None)]
)
def test_scores_round_half_to_even_and_stay_in_range(spark, share, score):
    df = spark.createDataFrame([(share,)], T.StructType([T.StructField("s", T.DoubleType())]))
    assert df.select(exprs.score_1_to_5(F.col("s")).alias("v")).collect()[0].v == score


@pytest.mark.parametrize(
    "amount, shown",
    [
        (999.0, "₹999"), (1e3, "₹1.0 K"), (1e5, "₹1.00 L"), (1e7, "₹1.00 Cr"),
        (10465997550.0, "₹1,046.60 Cr"), (-250000.0, "₹-2.50 L"), (0.5, "₹0"), (1.5, "₹2"),
        (None, "N/A"), (float("nan"), "N/A"), (float("inf"), "N/A"), (float("-inf"), "N/A"),
    ],
)
def test_currency_text(spark, amount, shown):
    df = spark.createDataFrame([(amount,)], T.StructType([T.StructField("a", T.DoubleType())]))
    assert df.select(text.currency("a").alias("v")).collect()[0].v == shown


@pytest.mark.parametrize("value", [27.484, 0.125, 2.675, 1234.5, -3.14159, 0.0, 21.715])
def test_percent_text_matches_python_formatting(spark, value):
    df = spark.createDataFrame([(value,)], "a double")
    assert df.select(text.percent_text("a").alias("v")).collect()[0].v == f"{value:.2f}%"


def test_html_escape_matches_python(spark):
    from html import escape

    raw = "<a href=\"x\">Tom & 'Jerry' &amp;</a>"
    assert one(spark, text.html_escape(F.lit(raw))) == escape(raw)
