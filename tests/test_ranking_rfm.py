import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.helpers import by, dataset, frame
from tradescope.operators.ranking import position_in_group, running_total
from tradescope.operators.selection import group_percentile
from tradescope.plans import rfm
from tradescope.plans.fact import sales_fact


def test_position_in_group_across_many_partitions(spark):
    # One group holds most rows and one value holds a third of them.
    data = [("hot", 5 if i % 3 else i, i) for i in range(900)] + [("cold", i % 4, i) for i in range(30)]
    df = spark.createDataFrame(data, "g string, v long, id long")
    got = position_in_group(df, ["g"], ["v", "id"], slots=7).toPandas()
    for _, group in got.groupby("g"):
        ordered = group.sort_values(["v", "id"])
        assert list(ordered["position"]) == list(range(1, len(group) + 1))


def test_running_total_across_many_partitions(spark):
    data = [("a", i, (i * 7) % 5 + 1) for i in range(200)] + [("b", i, 1) for i in range(9)]
    df = spark.createDataFrame(data, "g string, v long, w long")
    got = running_total(df, ["g"], ["v"], "w", "upto", slots=6).toPandas()
    for _, group in got.groupby("g"):
        ordered = group.sort_values("v")
        assert list(ordered["upto"]) == list(ordered["w"].cumsum())


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    values=st.lists(
        st.tuples(st.sampled_from("abc"), st.one_of(st.none(), st.integers(-50, 50).map(lambda n: n / 4))),
        min_size=1, max_size=60,
    )
)
def test_percentile_equals_numpy(spark, values):
    df = spark.createDataFrame(values, "g string, v double")
    got = by(group_percentile(df, "g", "v", 0.95, "p", few=3, bits=8), "g")
    expected = {}
    for g in {g for g, _ in values}:
        known = [v for h, v in values if h == g and v is not None]
        if known:
            expected[g] = float(np.percentile(known, 95))
    assert {g: row["p"] for g, row in got.items()} == expected


def test_percentile_of_the_small_example(spark):
    df = spark.createDataFrame([("e", 1.0), ("e", 2.0), ("e", 3.0), ("e", None)], "g string, v double")
    assert by(group_percentile(df, "g", "v", 0.95, "p"), "g")["e"]["p"] == 2.9


def _pandas_rfm(customers: pd.DataFrame) -> pd.DataFrame:
    """Scores from the definition: rank share by value then customer, times five."""
    out = customers.sort_values("cust_id").reset_index(drop=True)

    def position(column):
        order = out.sort_values([column, "cust_id"]).index
        return pd.Series(range(1, len(out) + 1), index=order).sort_index() / len(out)

    shares = {"r": 1 - position("recency_days"), "f": position("frequency"), "m": position("monetary")}
    for name, share in shares.items():
        out[f"{name}_score"] = np.clip(np.rint(share * 5), 1, 5).astype(int)
    return out


@pytest.mark.parametrize("few, bits", [(100_000, 16), (0, 4)])
def test_rfm_scores_with_ties(spark, few, bits):
    rng = np.random.default_rng(7)
    orders, items = [], []
    for order in range(240):
        customer = int(rng.integers(0, 40))
        orders.append(
            {"order_id": order, "cust_id": customer, "order_status": "Delivered",
             "order_date": f"2024-{1 + order % 3:02d}-{1 + order % 5:02d}"}
        )
        items.append({"order_id": order, "net_amount": 10 * int(rng.integers(1, 4))})
    fact = sales_fact(dataset(spark, orders=orders, order_items=items))
    got = rfm.rfm_segments(fact, few=few, bits=bits).toPandas().sort_values("cust_id").reset_index(drop=True)
    expected = _pandas_rfm(got[["cust_id", "recency_days", "frequency", "monetary"]])
    for column in ("r_score", "f_score", "m_score"):
        assert list(got[column]) == list(expected[column])
    assert list(got["rfm_total"]) == list(got["r_score"] + got["f_score"] + got["m_score"])
    top = got["frequency"].max()
    assert np.allclose(got["clv_proxy"], got["monetary"] * (1 + got["frequency"] / top))
    counts = by(rfm.segment_counts(spark.createDataFrame(got)), "segment")
    assert sum(r["customers"] for r in counts.values()) == len(got)


def test_rfm_of_missing_dates_and_customers(spark):
    ds = dataset(
        spark,
        orders=[
            {"order_id": 1, "cust_id": 1, "order_status": "Shipped", "order_date": "2024-01-01"},
            {"order_id": 2, "cust_id": 2, "order_status": "Shipped"},
            {"order_id": 3, "order_status": "Shipped", "order_date": "2024-01-11"},
        ],
        order_items=[{"order_id": i, "net_amount": 5} for i in (1, 2, 3)],
    )
    got = by(rfm.rfm_segments(sales_fact(ds)), "cust_id")
    assert set(got) == {1, 2}
    # The unknown customer's order is the latest one and sets the reference date.
    assert got[1]["recency_days"] == 10
    assert got[2]["r_score"] is None and got[2]["segment"] == "Others"


@pytest.mark.parametrize(
    "r, f, m, segment",
    [(4, 4, 4, "Champions"), (3, 3, 1, "Loyal"), (2, 5, 4, "At-Risk Valuable"),
     (2, 2, 3, "Needs Attention"), (3, 2, 5, "Others"), (2, 3, 3, "Others")],
)
def test_segments_first_match_wins(spark, r, f, m, segment):
    df = spark.createDataFrame([(r, f, m)], "r_score int, f_score int, m_score int")
    assert df.select(rfm._segment().alias("s")).collect()[0].s == segment


def test_empty_fact(spark):
    ds = dataset(spark, orders=[], order_items=[])
    assert rfm.rfm_segments(sales_fact(ds)).count() == 0
