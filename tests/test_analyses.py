"""Questions, KPIs and diagnostics on hand-made frames with nulls, ties, zeros and hot keys."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import diagnostics as d
from tallyloom.operators import facts, kpi, questions as q
from tallyloom.operators import relational as r
from tallyloom.operators import scenario as sc

DAY = dt.date(2021, 3, 1)


def days(*offsets):
    return [DAY + dt.timedelta(days=o) for o in offsets]


def test_order_gaps_with_same_day_orders_and_nulls(spark):
    rows = [(1, x) for x in days(0, 0, 10)] + [(2, DAY)] + [(3, x) for x in days(5, 8)] + [(3, None), (None, DAY)]
    orders = spark.createDataFrame(rows, "customer_id int, order_date date")
    got = {x.gap_days: x.times for x in q.order_gaps(orders).collect()}
    assert got == {0: 1, 10: 1, 3: 1}
    row = q.median_order_gap(orders).collect()[0]
    assert (row.median_gap_days, row.num_gaps, row.nearest) == (3.0, 3, "30")


def test_order_gaps_with_a_customer_holding_a_third_of_all_orders(spark):
    rng = random.Random(3)
    rows = [(0 if i % 3 == 0 else rng.randrange(1, 400), DAY + dt.timedelta(days=rng.randrange(900))) for i in range(6000)]
    orders = spark.createDataFrame(rows, "customer_id int, order_date date")
    gaps, last = [], {}
    for customer, day in sorted(rows):
        if customer in last:
            gaps.append((day - last[customer]).days)
        last[customer] = day
    row = q.median_order_gap(orders).collect()[0]
    assert (row.median_gap_days, row.num_gaps) == (statistics.median(gaps), len(gaps))


def test_nearest_reference_breaks_ties_by_label(spark):
    df = spark.createDataFrame([(15.0,), (21.0,), (None,)], "v double")
    near = r.nearest_reference("v", {"10": 10.0, "20": 20.0})
    assert [x[0] for x in df.select(near["label"]).collect()] == ["10", "20", None]


@pytest.fixture(scope="module")
def shop(spark):
    rng = random.Random(5)
    customers = [(c, rng.choice(["ads", "mail", "shop", None])) for c in range(60)]
    # Customer 0 and product 0 hold a third of everything; order 999 has no lines; 5000 is unknown.
    orders = [(o, DAY + dt.timedelta(days=o % 90), 0 if o % 3 == 0 else rng.randrange(60)) for o in range(300)]
    items = [
        (rng.randrange(300), 0 if i % 3 == 0 else rng.randrange(40), rng.randrange(1, 9), round(rng.uniform(1, 90), 2), 0.5)
        for i in range(1500)
    ] + [(5000, 1, 2, 3.0, 0.0)]
    products = [(p, f"cat{p % 4}" if p % 7 else None, "S" if p % 2 else "M", 10.0, 4.0) for p in range(39)]
    returns = [(o, p, 1, rng.choice(["bad", "late", None])) for o, p, *_ in items[::5]]
    make = spark.createDataFrame
    return {
        "customers": make(customers, "customer_id int, acquisition_channel string"),
        "orders": make(orders, "order_id int, order_date date, customer_id int"),
        "items": make(items, "order_id int, product_id int, quantity int, unit_price double, discount_amount double"),
        "products": make(products, "product_id int, category string, size string, price double, cogs double"),
        "returns": make(returns, "order_id int, product_id int, return_quantity int, return_reason string"),
        "raw": (customers, orders, items, products, returns),
    }


def test_channel_totals_against_brute_force(shop):
    customers, orders, items, _, _ = shop["raw"]
    channel = dict(customers)
    owner = {o: c for o, _, c in orders}
    total, by = 0.0, {}
    order_sets = {}
    for o, _, qty, price, disc in items:
        v = price * qty - disc
        total += v
        c = channel.get(owner.get(o))
        if c:
            by[c] = by.get(c, 0.0) + v
            order_sets.setdefault(c, set()).add(o)
    every = len({o for o, *_ in items})
    got = {x.acquisition_channel: x for x in d.channel_totals(shop["items"], shop["orders"], shop["customers"]).collect()}
    assert set(got) == set(by)
    for c, v in by.items():
        assert got[c].total_revenue == pytest.approx(v)
        assert got[c].revenue_pct == pytest.approx(v / total)
        assert got[c].orders_pct == pytest.approx(len(order_sets[c]) / every)


def test_daily_channel_revenue_adds_up_to_totals(shop):
    daily = d.daily_channel_revenue(shop["items"], shop["orders"], shop["customers"])
    a = {x[0]: x[1] for x in daily.groupBy("acquisition_channel").agg(F.sum("revenue")).collect()}
    b = {x.acquisition_channel: x.total_revenue for x in d.channel_totals(shop["items"], shop["orders"], shop["customers"]).collect()}
    assert a == pytest.approx(b)


def test_cohorts_keep_customers_without_orders(shop):
    customers = shop["raw"][0]
    life = d.customer_lifetime(shop["items"], shop["orders"], shop["customers"])
    assert life.count() == len(customers)
    summary = {x.acquisition_channel: x for x in d.cohort_summary(life).collect()}
    values = {}
    for x in life.collect():
        values.setdefault(x.acquisition_channel, []).append((x.lifetime_value, x.order_count))
    assert set(summary) == set(values) - {None}
    for c, row in summary.items():
        assert row.median_ltv == pytest.approx(statistics.median(v for v, _ in values[c]))
        assert row.std_ltv == pytest.approx(statistics.stdev(v for v, _ in values[c]))
        assert row.median_orders == statistics.median(n for _, n in values[c])


def test_return_rates_against_brute_force(shop):
    _, _, items, products, returns = shop["raw"]
    category = {p: c for p, c, *_ in products}
    sold, back = {}, {}
    for _, p, qty, *_ in items:
        sold[category.get(p)] = sold.get(category.get(p), 0) + qty
    for _, p, qty, _ in returns:
        back[category.get(p)] = back.get(category.get(p), 0) + qty
    got = {x.category: x.return_rate for x in d.return_rate_by_product(shop["returns"], shop["items"], shop["products"], "category").collect()}
    assert got == pytest.approx({c: back[c] / sold[c] for c in back if c})


def test_category_revenue_drops_unknown_products(shop):
    got = kpi.category_revenue(shop["items"], shop["products"])
    known = facts.by_product_attribute(facts.product_units(shop["items"], shop["returns"]), shop["products"], "category")
    assert {x.category for x in got.collect()} == {x.category for x in known.collect()} == {"cat0", "cat1", "cat2", "cat3"}


def test_funnel_without_sessions_gives_null_not_an_error(spark):
    traffic = spark.createDataFrame([(DAY, "ads", 0, 0, 0.5), (DAY, "mail", 4, 8, 0.1)], "date date, traffic_source string, sessions long, page_views long, bounce_rate double")
    orders = spark.createDataFrame([(1, DAY, "mail"), (2, DAY, "mail"), (3, None, "mail")], "order_id int, order_date date, order_source string")
    got = {x.traffic_source: x for x in d.daily_funnel(traffic, orders).collect()}
    assert got["ads"].conversion_rate is None and got["mail"].conversion_rate == 0.5
    monthly = {x.traffic_source: x.order_count for x in d.monthly_funnel(traffic, orders).collect()}
    assert monthly == {"ads": 0, "mail": 2}


def test_conversion_proxy_is_zero_without_sessions(spark):
    traffic = spark.createDataFrame([(DAY, 0, 0, 0, 0.5)], "date date, sessions long, unique_visitors long, page_views long, bounce_rate double")
    orders = spark.createDataFrame([(1, DAY)], "order_id int, order_date date")
    assert kpi.daily_conversion(traffic, orders).collect()[0].conversion_proxy == 0.0


def test_anomaly_flags(spark):
    values = [100.0] * 40 + [900.0, 10.0, 100.0, 0.0, 100.0]
    df = spark.createDataFrame([(DAY + dt.timedelta(days=i), v) for i, v in enumerate(values)], "date date, revenue double")
    got = {(x.date - DAY).days: x for x in d.classify_anomalies(df).collect()}
    assert got[40].anomaly_type == "both_methods"
    assert got[41].is_low_revenue_heuristic and got[43].is_low_revenue_heuristic
    assert got[44].is_extreme_change_heuristic and got[44].revenue_pct_change is None
    assert got[0].anomaly_type == "normal" and not got[0].is_extreme_change_heuristic


def test_flat_series_has_no_anomaly_and_no_correlation(spark):
    df = spark.createDataFrame([(DAY + dt.timedelta(days=i), 5.0, float(i)) for i in range(10)], "date date, revenue double, x double")
    assert {x.anomaly_type for x in d.classify_anomalies(df).collect()} == {"normal"}
    matrix = {x.metric: x for x in d.correlation_matrix(df, ["revenue", "x"]).collect()}
    assert matrix["revenue"].x is None and matrix["revenue"].revenue is None and matrix["x"].x == 1.0


def test_concentration_of_even_shares(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1)], "k string, n int")
    assert r.concentration(r.share_of_total(df, "n"), "share").collect()[0].herfindahl == pytest.approx(0.25)


def test_scenarios_and_returns(spark):
    df = spark.createDataFrame([(dt.date(2023, 1, 1), 100.0), (dt.date(2023, 5, 1), 100.0)], "date date, forecast_ensemble double")
    wide = {x.date.month: x for x in sc.scenario_wide(df).collect()}
    assert wide[1].scenario_promotional_boost == pytest.approx(110) and wide[5].scenario_promotional_boost == 100
    totals = sc.scenario_totals(sc.scenario_long(df))
    top = totals.filter("impact_rank = 1").collect()[0]
    assert top.scenario == "aggressive" and top.impact_pct == pytest.approx((1.10 * 1.05 * 1.08 * 1.12 - 1) * 100)
    roi = {x.action: x.roi_percent for x in sc.action_returns(totals).collect()}
    assert roi["R2"] == pytest.approx(150.0) and roi["R1"] == pytest.approx((5 - 8) / 8 * 100)
    phases = {x.phase: x.actions for x in sc.phase_roll_up(sc.action_returns(totals)).collect()}
    assert phases == {"Phase 1": 2, "Phase 2": 2, "Phase 3": 1}


def test_region_verdict(spark):
    def frame(**v):
        return spark.createDataFrame(list(v.items()), "region string, total_revenue double")

    def verdict(a, b):
        return {x.verdict for x in q.region_comparison(a, b).collect()}

    assert verdict(frame(A=1000.0, B=999.0, C=998.0), frame(A=1.0, B=2.0, C=3.0)) == {"approximately_equal"}
    assert verdict(frame(A=1000.0, B=500.0, C=1.0), frame(A=9.0, B=2.0, C=3.0)) == {"consensus"}
    assert verdict(frame(A=1000.0, B=500.0, C=1.0), frame(A=1.0, B=2.0, C=3.0)) == {"payment_based"}
    assert verdict(frame(A=1000.0, B=999.0), frame(A=1.0, B=2.0)) == {"payment_based"}
