"""Named queries A01-A14 and the agreement of two routes to the same answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import audit, questions as q
from tallyloom.plans.catalog import query
from tallyloom.plans.common import rounded
from tallyloom.sources.tables import StarTables

CATEGORY = StarTables.question_category


def _inputs(t):
    return dict(
        orders=t.orders_with_zip(), products=t.products(), returns=t.returns(), traffic=t.web_traffic(),
        items=t.order_items(), customers=t.customers(), geography=t.geography(), payments=t.payments(),
        category=t.question_category,
    )


_A01 = """select median(gap) as median_gap_days, count(gap) as num_gaps from (select
    cast(order_date - lag(order_date) over (partition by customer_id order by order_date) as bigint) as gap from v_orders)"""
_A02 = """select segment, avg((price - cogs) / price) as avg_margin_rate, count(*) as n_products
    from v_products group by 1"""
_A03 = f"""select return_reason, count(*) as return_records from v_returns join v_products using (product_id)
    where category = '{CATEGORY}' group by 1"""
_A04 = "select traffic_source, avg(bounce_rate) as avg_bounce_rate, count(*) as n_days from v_web_traffic group by 1"
_A05 = "select cast(count(promo_id) as double) / count(*) * 100 as pct_with_promo from v_order_items"


def _a06(join: str) -> str:
    return f"""select age_group, cast(coalesce(sum(n), 0) as double) / count(*) as avg_orders_per_customer,
        count(distinct customer_id) as n_customers from v_customers {join} join
        (select customer_id, count(*) as n from v_orders group by 1) using (customer_id)
        where age_group is not null group by 1"""


_A08 = """select region, cast(sum(cast(payment_value as decimal(18,4))) as double) as total_revenue
    from v_orders join v_geography using (zip) join v_payments using (order_id) group by 1"""
_A09 = """select region, cast(sum(cast(unit_price as decimal(28,10))) as double) as total_revenue
    from v_orders join v_geography using (zip) join v_order_items using (order_id) group by 1"""
_A10 = f"""select region, p.total_revenue as pay_total_revenue, i.total_revenue as item_total_revenue,
    (max(p.total_revenue) over () - min(p.total_revenue) over ()) / nullif(max(p.total_revenue) over (), 0) as spread,
    first_value(region) over (order by p.total_revenue desc nulls last, region desc) as top_by_payment,
    first_value(region) over (order by i.total_revenue desc nulls last, region desc) as top_by_items
    from ({_A08}) p full join ({_A09}) i using (region)"""
_A11 = "select payment_method, count(*) as n_orders from v_orders where order_status = 'cancelled' group by 1"
_A12 = """select size, coalesce(r.n, 0) as return_records, coalesce(s.n, 0) as order_item_rows,
    coalesce(r.n, 0) / nullif(coalesce(s.n, 0), 0) as return_rate from
    (select size, count(*) as n from v_returns join v_products using (product_id) group by 1) r full join
    (select size, count(*) as n from v_order_items join v_products using (product_id) group by 1) s using (size)"""
_A13 = """select installments, cast(sum(cast(payment_value as decimal(18,4))) as double) / count(*) as avg_payment_value,
    count(*) as n_orders from v_payments where installments in (1, 3, 6, 12) group by 1"""


def _nearest(value: str, options: dict[str, float]) -> str:
    rows = ", ".join(f"('{k}', {v}e0)" for k, v in options.items())
    return f"(select k from (values {rows}) o(k, v) order by abs({value} - v), k limit 1)"


@query(
    "A01_median_order_gap",
    f"""select median_gap_days, num_gaps, {_nearest('median_gap_days', q.GAP_OPTIONS)} as nearest,
        (select min(abs(median_gap_days - v)) from (values (30e0), (90e0), (144e0), (365e0)) o(v)) as distance from ({_A01})""",
)
def a01(t):
    return q.median_order_gap(t.orders())


@query(
    "A02_segment_margins",
    f"select * replace (round(avg_margin_rate, 9) as avg_margin_rate) from ({_A02})",
)
def a02(t):
    return rounded(q.segment_margins(t.products()), {"avg_margin_rate": 9})


@query("A03_return_reasons_in_category", _A03)
def a03(t):
    return q.return_reasons_in(t.returns(), t.products(), t.question_category)


@query("A04_bounce_by_source", f"select * replace (round(avg_bounce_rate, 9) as avg_bounce_rate) from ({_A04})")
def a04(t):
    return rounded(q.bounce_by_source(t.web_traffic()), {"avg_bounce_rate": 9})


@query(
    "A05_promotion_share",
    f"select pct_with_promo, {_nearest('pct_with_promo', q.PROMO_OPTIONS)} as nearest from ({_A05})",
)
def a05(t):
    return q.promotion_share(t.order_items())


@query("A06_orders_per_customer_all", _a06("left"))
def a06(t):
    return q.orders_per_customer(t.customers(), t.orders())


@query("A07_orders_per_active_customer", _a06(""))
def a07(t):
    return q.orders_per_customer(t.customers(), t.orders(), active_only=True)


@query("A08_region_by_payment", _A08)
def a08(t):
    return q.region_by_payment(t.orders_with_zip(), t.geography(), t.payments())


@query("A09_region_by_unit_price", f"select region, round(total_revenue, 4) as total_revenue from ({_A09})")
def a09(t):
    return rounded(q.region_by_items(t.orders_with_zip(), t.geography(), t.order_items()), {"total_revenue": 4})


@query(
    "A10_region_comparison",
    f"""select * replace (round(item_total_revenue, 4) as item_total_revenue), case when (count(pay_total_revenue) over ()) >= 3 and spread < 0.01 then 'approximately_equal'
        when top_by_payment = top_by_items then 'consensus' else 'payment_based' end as verdict from ({_A10})""",
)
def a10(t):
    return q.region_comparison(a08(t), a09(t))


@query("A11_methods_of_cancelled", _A11)
def a11(t):
    return q.methods_of_cancelled(t.orders())


@query("A12_return_rate_by_size", _A12)
def a12(t):
    return q.return_rate_by_size(t.returns(), t.order_items(), t.products())


@query("A13_payment_by_installments", _A13)
def a13(t):
    return q.payment_by_installments(t.payments())


def _top(question: str, metric: str, source: str, value: str, label: str, order: str) -> str:
    return f"""(select '{question}' as question, '{metric}' as metric, cast({value} as double) as value,
        cast({label} as varchar) as detail from ({source}) order by {order} limit 1)"""


_ANSWERS = " union all ".join(
    [
        _top("Q1", "median_inter_order_gap_days", _A01, "median_gap_days",
             _nearest("median_gap_days", q.GAP_OPTIONS), "1"),
        _top("Q2", "highest_avg_margin_segment", _A02, "avg_margin_rate", "segment", "avg_margin_rate desc, segment"),
        _top("Q3", "most_common_return_reason_in_category", _A03, "return_records", "return_reason",
             "return_records desc, return_reason"),
        _top("Q4", "lowest_avg_bounce_source", _A04, "avg_bounce_rate", "traffic_source",
             "avg_bounce_rate, traffic_source"),
        _top("Q5", "pct_rows_with_promo_id", _A05, "pct_with_promo", _nearest("pct_with_promo", q.PROMO_OPTIONS), "1"),
        _top("Q6", "highest_avg_orders_per_customer_by_age_group", _a06("left"), "avg_orders_per_customer", "age_group",
             "avg_orders_per_customer desc, age_group"),
        _top("Q7", "highest_total_revenue_region", _A08, "total_revenue", "region", "total_revenue desc, region"),
        _top("Q8", "most_used_payment_method_in_cancelled_orders", _A11, "n_orders", "payment_method",
             "n_orders desc, payment_method"),
        _top("Q9", "highest_return_rate_by_size", _A12, "return_rate", "size", "return_rate desc, size"),
        _top("Q10", "highest_avg_payment_value_by_installment_plan", _A13, "avg_payment_value", "installments",
             "avg_payment_value desc, installments"),
    ]
)


@query("A14_all_answers", f"select question, metric, round(value, 6) as value, detail from ({_ANSWERS})")
def a14(t):
    return rounded(q.all_answers(**_inputs(t)), {"value": 6})


@query(
    "Q25_two_route_agreement",
    f"select question, detail as first_value, detail as second_value, true as match from ({_ANSWERS})",
)
def q25(t):
    first = q.all_answers(**_inputs(t)).select("question", F.col("detail").alias("label"))
    return audit.agreement(first, q.second_route(**_inputs(t)), "question", "label")
