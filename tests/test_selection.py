import math
import struct
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import by, dataset, physical_plan
from tradescope.operators import selection
from tradescope.operators.selection import (
    decimal_keys,
    from_ordered_bits,
    group_percentile,
    ordered_bits,
    select_places,
)
from tradescope.plans import rfm
from tradescope.plans.fact import sales_fact
from tradescope.plans.operations import api_health

INF = float("inf")


def _bits(value: float) -> int:
    (raw,) = struct.unpack("<q", struct.pack("<d", abs(value)))
    return -raw if value < 0 else raw


def test_ordered_bits_are_the_bits_of_the_double(spark):
    rng = np.random.default_rng(3)
    values = [0.0, -0.0, 1.0, -1.0, INF, -INF, 5e-324, -5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, 1.7976931348623157e308, 0.1, 3.0]
    values += [math.nextafter(2.0**e, up) for e in range(-1073, 1024, 7) for up in (0.0, INF)]
    raw = rng.integers(0, 1 << 62, 500, dtype=np.int64).view(np.float64)
    values += [float(v) * s for v in raw if np.isfinite(v) for s in (1, -1)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", ordered_bits(F.col("v")).alias("b")).withColumn("back", from_ordered_bits(F.col("b"))).collect()
    assert all(r.b == _bits(r.v) and r.back == r.v for r in got)
    nan = spark.createDataFrame([(float("nan"),)], "v double").select(ordered_bits(F.col("v")).alias("b"))
    assert nan.first().b > _bits(INF)
    assert math.isnan(nan.select(from_ordered_bits(F.col("b")).alias("v")).first().v)


def test_decimal_keys_keep_the_order(spark):
    texts = ["0", "-0.00000001", "0.00000001", "-1", "1", "999999999999.99999999", "1000000000000", "-1000000000000.5",
             "123456789012345678901234567890.12345678", "-123456789012345678901234567890.12345678", "0.5", "-0.5"]
    df = spark.createDataFrame([(Decimal(t),) for t in texts], "v decimal(38,8)")
    got = df.select("v", F.array(*decimal_keys("v")).alias("k")).collect()
    assert [r.v for r in sorted(got, key=lambda r: r.k)] == sorted(r.v for r in got)
    assert len({tuple(r.k) for r in got}) == len(texts)


@pytest.mark.parametrize("few, bits", [(100_000, 16), (10, 6)])
def test_places_equal_a_sort(spark, few, bits):
    rng = np.random.default_rng(11)
    # A hot group with a value that a third of its rows share, extreme longs, and a group of one.
    extreme = [-(2**63), 2**63 - 1, 0, -1]
    data = [("hot", 7 if i % 3 == 0 else int(rng.integers(-500, 500)), i) for i in range(900)]
    data += [("far", v, i) for i, v in enumerate(extreme)] + [("one", 5, 5)]
    df = spark.createDataFrame(data, "g string, v long, id long")
    n = F.col("_n")
    wanted = {"first": F.lit(0), "mid": F.floor(n / 2), "last": n - 1, "before": F.lit(-1), "after": n}
    got = {(r.g, r.name): r for r in select_places(df, ["g"], ["v", "id"], wanted, few, bits).collect()}
    assert len(got) == 15
    for g in ("hot", "far", "one"):
        order = sorted((v, i) for h, v, i in data if h == g)
        for name, place in {"first": 0, "mid": len(order) // 2, "last": len(order) - 1}.items():
            assert (got[g, name].v, got[g, name].id) == order[place]
        assert got[g, "before"].v is None and got[g, "after"].v is None


def test_places_of_no_rows(spark):
    df = spark.createDataFrame([], "g string, v long")
    assert select_places(df, ["g"], ["v"], {"a": F.lit(0)}).count() == 0


@pytest.mark.parametrize("few, bits", [(100_000, 16), (0, 12)])
def test_percentile_of_odd_values(spark, few, bits):
    groups = {
        "negative": [-5.5, -1.25, -3.0, -0.0, -1e300],
        "zeros": [0.0, -0.0, 0.0, -0.0],
        "tiny": [5e-324, 1e-310, -1e-310, 2.0**-1022],
        "same": [2.5] * 400,
        "infinite": [1.0, 2.0, INF, INF, INF],
        "lower": [-INF] * 30,
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [(None, 1.0), ("empty", None)], "g string, v double")
    got = by(group_percentile(df, "g", "v", 0.5, "p", few, bits), "g")
    assert set(got) == set(groups)
    for g, values in groups.items():
        order, place = sorted(values), 0.5 * (len(values) - 1)
        low, high = order[math.floor(place)], order[math.ceil(place)]
        assert got[g]["p"] == (low if low == high else high - (high - low) * 0.5)


def test_percentile_moves_counts_only(spark, tmp_path, monkeypatch):
    """Every shuffle behind a percentile follows a count, and no range sort is planned."""
    plans = []
    real = selection.stage
    monkeypatch.setattr(selection, "stage", lambda df, label: plans.append(physical_plan(df)) or real(df, label))
    spark.range(5_000).select(F.lit("g").alias("g"), (F.col("id") % 977 / 7).alias("v")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    result = group_percentile(df, "g", "v", 0.95, "p", few=0)
    values = sorted(i % 977 / 7 for i in range(5_000))
    assert result.first().p == pytest.approx(np.percentile(values, 95), rel=1e-15)
    assert len(plans) > 1 and not any("rangepartitioning" in p for p in plans)
    assert all("partial_count" in p for p in plans)


def test_rfm_all_ties(spark):
    """One value of every measure for all customers: only the ids decide."""
    many = 50
    fact = sales_fact(
        dataset(
            spark,
            orders=[{"order_id": i, "cust_id": i, "order_status": "Delivered", "order_date": "2024-01-01"} for i in range(many)],
            order_items=[{"order_id": i, "net_amount": 5} for i in range(many)],
        )
    )
    got = by(rfm.rfm_segments(fact, few=0, bits=3), "cust_id")
    for i in range(many):
        share = (i + 1) / many
        rank, recent = (min(5, max(1, int(np.rint(s * 5)))) for s in (share, 1 - share))
        assert (got[i]["f_score"], got[i]["m_score"], got[i]["r_score"]) == (rank, rank, recent)


@pytest.mark.parametrize("many", [1, 2, 3, 7, 10])
def test_rfm_cuts_equal_positions(spark, many):
    """Few customers, where rounding of shares matters, against the positions of all rows."""
    orders = [{"order_id": i, "cust_id": i, "order_status": "Delivered", "order_date": f"2024-01-{1 + i % 4:02d}"} for i in range(many)]
    fact = sales_fact(dataset(spark, orders=orders, order_items=[{"order_id": i, "net_amount": i % 3} for i in range(many)]))
    cut = by(rfm.rfm_segments(fact), "cust_id")
    named = by(rfm.rfm_segments(fact.withColumn("cust_id", F.format_string("c%05d", "cust_id"))), "cust_id")
    for i, row in cut.items():
        other = named[f"c{i:05d}"]
        assert all(row[c] == other[c] for c in ("r_score", "f_score", "m_score", "segment"))


def test_rfm_sorts_no_customers(spark):
    fact = sales_fact(
        dataset(
            spark,
            orders=[{"order_id": 1, "cust_id": 1, "order_status": "Delivered", "order_date": "2024-01-01"}],
            order_items=[{"order_id": 1, "net_amount": 5}],
        )
    )
    plan = physical_plan(rfm.rfm_segments(fact))
    assert "rangepartitioning" not in plan and "Join" not in plan


def test_api_health_percentile(spark):
    requests = [{"request_id": i, "endpoint": "/a", "response_time_ms": float(i), "status_code": 200} for i in range(1, 22)]
    got = by(api_health(dataset(spark, api_requests=requests)), "endpoint")
    assert got["/a"]["p95_latency_ms"] == 20.0
