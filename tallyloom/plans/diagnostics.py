"""Named queries X01-X24."""

from __future__ import annotations

from tallyloom.operators import diagnostics as d
from tallyloom.plans.catalog import query
from tallyloom.plans.common import once, rounded, shared

_DAILY = """daily as (select order_date as date, acquisition_channel, cast(sum(net) as double) as revenue,
    count(distinct order_id) as order_count, cast(sum(net) as double) / count(distinct order_id) as avg_order_value
    from v_line_facts where acquisition_channel is not null and order_date is not null group by 1, 2)"""

_MONTHLY = f"""{_DAILY}, monthly as (select strftime(date, '%Y-%m') as month, acquisition_channel,
    cast(sum(cast(revenue as decimal(18,4))) as double) as revenue, cast(sum(order_count) as bigint) as order_count,
    avg(avg_order_value) as avg_order_value from daily group by 1, 2)"""

_TOTALS = """totals as (select acquisition_channel, cast(sum(net) as double) as total_revenue,
    cast(sum(net) as double) / count(*) as avg_item_value, count(distinct order_id) as order_count,
    cast(sum(net) as double) / (select cast(sum(net) as double) from v_line_facts) as revenue_pct,
    count(distinct order_id) / (select count(distinct order_id) from v_line_facts) as orders_pct
    from v_line_facts where acquisition_channel is not null group by 1)"""

_LIFETIME = """spent as (select customer_id, cast(sum(net) as double) as value, count(distinct order_id) as orders
    from v_line_facts group by 1),
    lifetime as (select c.customer_id, c.acquisition_channel, coalesce(value, 0e0) as lifetime_value,
    coalesce(orders, 0) as order_count, coalesce(orders, 0) > 1 as is_repeat
    from v_customers c left join spent using (customer_id))"""

_COHORT = f"""{_LIFETIME}, cohort as (select acquisition_channel, count(customer_id) as customer_count,
    cast(sum(cast(lifetime_value as decimal(18,4))) as double) / count(*) as avg_ltv,
    median(lifetime_value) as median_ltv, stddev_samp(lifetime_value) as std_ltv,
    cast(sum(order_count) as double) / count(*) as avg_orders, cast(median(order_count) as double) as median_orders,
    cast(count(*) filter (where is_repeat) as double) / count(*) as repeat_rate
    from lifetime where acquisition_channel is not null group by 1)"""

_TRAFFIC = """traffic as (select date, traffic_source, cast(sum(sessions) as bigint) as sessions,
    cast(sum(page_views) as bigint) as page_views, avg(bounce_rate) as bounce_rate from v_web_traffic group by 1, 2),
    bought as (select order_date as date, order_source, count(*) as order_count from v_orders
    where order_date is not null and order_source is not null group by 1, 2)"""

_FUNNEL = f"""{_TRAFFIC}, funnel as (
    select v.month, v.traffic_source, v.sessions, v.page_views, v.bounce_rate, coalesce(b.order_count, 0) as order_count,
    coalesce(b.order_count, 0) / nullif(v.sessions, 0) as conversion_rate,
    v.page_views / nullif(v.sessions, 0) as page_view_per_session
    from (select strftime(date, '%Y-%m') as month, traffic_source, cast(sum(sessions) as bigint) as sessions,
          cast(sum(page_views) as bigint) as page_views, avg(bounce_rate) as bounce_rate from traffic group by 1, 2) v
    left join (select strftime(date, '%Y-%m') as month, order_source, cast(sum(order_count) as bigint) as order_count
          from bought group by 1, 2) b on b.month = v.month and b.order_source = v.traffic_source)"""

_SUMMARY = f"""{_FUNNEL}, summary as (select traffic_source, cast(sum(sessions) as bigint) as total_sessions,
    cast(sum(page_views) as bigint) as total_page_views, cast(sum(order_count) as bigint) as total_orders,
    avg(conversion_rate) as avg_conversion_rate, avg(bounce_rate) as avg_bounce_rate from funnel group by 1)"""

_FLAGS = """stats as (select cast(sum(cast(revenue as decimal(18,4))) as double) / count(revenue) as mean_value,
    stddev_samp(revenue) as std_value, quantile_cont(revenue, 0.25) as q1, quantile_cont(revenue, 0.75) as q3 from v_sales),
    steps as (select date, revenue, lag(revenue) over (order by date) as prev from v_sales),
    flags as (select date, revenue, mean_value, std_value, q1, q3,
    abs((revenue - mean_value) / nullif(std_value, 0)) as z_score,
    coalesce(abs((revenue - mean_value) / nullif(std_value, 0)) > 3, false)
      or coalesce(revenue < q1 - 1.5e0 * (q3 - q1) or revenue > q3 + 1.5e0 * (q3 - q1), false) as is_statistical_anomaly,
    coalesce(revenue > 3 * mean_value, false) as is_high_revenue_heuristic,
    coalesce(revenue < 0.3e0 * mean_value, false) as is_low_revenue_heuristic,
    abs((revenue - prev) / nullif(prev, 0)) as revenue_pct_change,
    coalesce(abs((revenue - prev) / nullif(prev, 0)) > 1 or (prev = 0 and revenue <> 0), false) as is_extreme_change_heuristic
    from steps cross join stats),
    classed as (select *, (is_high_revenue_heuristic or is_low_revenue_heuristic or is_extreme_change_heuristic)
        as is_heuristic_anomaly,
    case when is_statistical_anomaly and (is_high_revenue_heuristic or is_low_revenue_heuristic or is_extreme_change_heuristic)
         then 'both_methods' when is_statistical_anomaly then 'statistical_only'
         when is_high_revenue_heuristic or is_low_revenue_heuristic or is_extreme_change_heuristic then 'heuristic_only'
         else 'normal' end as anomaly_type from flags)"""

_PANEL = """visits as (select date, cast(sum(sessions) as bigint) as sessions, cast(sum(page_views) as bigint) as page_views,
    avg(bounce_rate) as bounce_rate from v_web_traffic group by 1),
    back as (select return_date as date, cast(sum(return_quantity) as bigint) as return_quantity from v_returns group by 1),
    metrics as (select s.date, s.revenue, s.cogs, coalesce(sessions, 0) as sessions, coalesce(page_views, 0) as page_views,
    coalesce(bounce_rate, 0e0) as bounce_rate, coalesce(return_quantity, 0) as return_quantity
    from v_sales s left join visits using (date) left join back using (date))"""


def _rate_sql(attribute: str) -> str:
    return f"""with sold as (select p.{attribute}, cast(sum(i.quantity) as bigint) as total_quantity
        from v_order_items i join v_products p using (product_id) group by 1),
        back as (select p.{attribute}, cast(sum(return_quantity) as bigint) as returned_quantity,
        count(return_reason) as return_count from v_returns r join v_products p using (product_id) group by 1)
        select {attribute}, returned_quantity, return_count, total_quantity,
        returned_quantity / nullif(total_quantity, 0) as return_rate
        from back left join sold using ({attribute}) where {attribute} is not null"""


def _corr_sql(a: str, b: str) -> str:
    if a == b:
        return f"round(case when stddev_pop({a}) > 0 then 1e0 end, 6)"
    return f"round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 6)"


_MATRIX = " union all ".join(
    f"select '{a}' as metric, " + ", ".join(f"{_corr_sql(a, b)} as {b}" for b in d.METRICS) + " from metrics"
    for a in d.METRICS
)
_RANKED = " union all ".join(
    f"select '{m}' as metric, {_corr_sql('revenue', m)} as correlation from metrics" for m in d.METRICS
)


@query("X01_daily_channel_revenue", f"with {_DAILY} select * from daily")
def x01(t):
    return shared(t, "channel_days", lambda: d.daily_channel_revenue(t.order_items(), t.orders(), t.customers()))


@query(
    "X02_monthly_channel_revenue",
    f"with {_MONTHLY} select month, acquisition_channel, revenue, order_count, "
    "round(avg_order_value + 1e-7, 4) as avg_order_value from monthly",
)
def x02(t):
    return rounded(d.monthly_channel_revenue(x01(t)), {"avg_order_value": 4}, nudge=1e-7)


@query(
    "X03_monthly_channel_mix",
    f"""with {_MONTHLY}, mix as (select month, cast(sum(cast(revenue as decimal(18,4))) as double) as total_revenue
        from monthly group by 1)
        select month, acquisition_channel, revenue, order_count, round(avg_order_value + 1e-7, 4) as avg_order_value,
        total_revenue, revenue / nullif(total_revenue, 0) as revenue_pct from monthly join mix using (month)""",
)
def x03(t):
    return rounded(d.monthly_channel_mix(d.monthly_channel_revenue(x01(t))), {"avg_order_value": 4}, nudge=1e-7)


@query("X04_channel_totals", f"with {_TOTALS} select * from totals")
def x04(t):
    return shared(t, "channel_totals", lambda: d.channel_totals(t.order_items(), t.orders(), t.customers()))


@query("X05_customer_lifetime", f"with {_LIFETIME} select * from lifetime")
def x05(t):
    return shared(t, "lifetime", lambda: d.customer_lifetime(t.order_items(), t.orders(), t.customers()))


@query(
    "X06_cohort_summary",
    f"""with {_COHORT} select acquisition_channel, customer_count, avg_ltv, round(median_ltv, 4) as median_ltv,
        round(std_ltv, 2) as std_ltv, avg_orders, median_orders, repeat_rate from cohort""",
)
def x06(t):
    return rounded(d.cohort_summary(once(t, "lifetime", lambda: x05(t))), {"median_ltv": 4, "std_ltv": 2})


@query(
    "X07_enriched_returns",
    """select r.*, p.category, p.size, o.customer_id, c.acquisition_channel from v_returns r
       left join v_products p using (product_id) left join v_orders o using (order_id)
       left join v_customers c on c.customer_id = o.customer_id""",
)
def x07(t):
    return d.enriched_returns(t.returns(), t.products(), t.orders(), t.customers())


@query("X08_return_rate_by_category", _rate_sql("category"))
def x08(t):
    return d.return_rate_by_product(t.returns(), t.order_items(), t.products(), "category")


@query(
    "X09_return_reasons",
    """select return_reason, count(*) as count, count(*) / (select count(return_reason) from v_returns) as percentage
       from v_returns where return_reason is not null group by 1""",
)
def x09(t):
    return d.reason_shares(t.returns())


@query(
    "X10_return_rate_by_channel",
    """with sold as (select acquisition_channel, cast(sum(quantity) as bigint) as total_quantity from v_line_facts group by 1),
       back as (select c.acquisition_channel, cast(sum(return_quantity) as bigint) as returned_quantity,
       count(return_reason) as return_count from v_returns r join v_orders o using (order_id)
       join v_customers c on c.customer_id = o.customer_id group by 1)
       select acquisition_channel, returned_quantity, return_count, total_quantity,
       returned_quantity / nullif(total_quantity, 0) as return_rate
       from back left join sold using (acquisition_channel) where acquisition_channel is not null""",
)
def x10(t):
    return d.return_rate_by_channel(t.returns(), t.order_items(), t.orders(), t.customers())


@query("X11_return_rate_by_size", _rate_sql("size"))
def x11(t):
    return d.return_rate_by_product(t.returns(), t.order_items(), t.products(), "size")


@query(
    "X12_daily_traffic_by_source",
    f"with {_TRAFFIC} select date, traffic_source, sessions, page_views, round(bounce_rate, 9) as bounce_rate from traffic",
)
def x12(t):
    return rounded(d.daily_traffic(t.web_traffic()), {"bounce_rate": 9})


@query("X12_daily_orders_by_source", f"with {_TRAFFIC} select * from bought")
def x12_orders(t):
    return d.daily_orders_by_source(t.orders())


@query(
    "X13_daily_funnel",
    f"""with {_TRAFFIC} select v.date, v.traffic_source, sessions, page_views, round(bounce_rate, 9) as bounce_rate,
        coalesce(order_count, 0) as order_count, coalesce(order_count, 0) / nullif(sessions, 0) as conversion_rate,
        page_views / nullif(sessions, 0) as page_view_per_session
        from traffic v left join bought b on b.date = v.date and b.order_source = v.traffic_source""",
)
def x13(t):
    return rounded(d.daily_funnel(t.web_traffic(), t.orders()), {"bounce_rate": 9})


@query(
    "X14_monthly_funnel",
    f"with {_FUNNEL} select * replace (round(bounce_rate, 9) as bounce_rate) from funnel",
)
def x14(t):
    return rounded(d.monthly_funnel(t.web_traffic(), t.orders()), {"bounce_rate": 9})


@query(
    "X15_funnel_summary",
    f"""with {_SUMMARY} select * replace (round(avg_conversion_rate, 9) as avg_conversion_rate,
        round(avg_bounce_rate, 9) as avg_bounce_rate) from summary""",
)
def x15(t):
    summary = d.funnel_summary(d.monthly_funnel(t.web_traffic(), t.orders()))
    return rounded(summary, {"avg_conversion_rate": 9, "avg_bounce_rate": 9})


@query(
    "X16_statistical_anomalies",
    f"""with {_FLAGS} select date, revenue, mean_value, round(std_value, 4) as std_value, round(q1, 4) as q1,
        round(q3, 4) as q3, round(z_score, 6) as z_score, is_statistical_anomaly from flags""",
)
def x16(t):
    flagged = d.statistical_flags(t.sales()).drop("cogs")
    return rounded(flagged, {"std_value": 4, "q1": 4, "q3": 4, "z_score": 6})


@query(
    "X17_heuristic_anomalies",
    f"""with {_FLAGS} select date, revenue, mean_value, is_high_revenue_heuristic, is_low_revenue_heuristic,
        round(revenue_pct_change, 9) as revenue_pct_change, is_extreme_change_heuristic, is_heuristic_anomaly from classed""",
)
def x17(t):
    return rounded(d.heuristic_flags(t.sales()).drop("cogs"), {"revenue_pct_change": 9})


@query(
    "X18_anomaly_classes",
    f"""with {_FLAGS} select date, revenue, round(z_score, 6) as z_score, anomaly_type
        from classed where anomaly_type <> 'normal'""",
)
def x18(t):
    return rounded(d.anomalies_only(d.classify_anomalies(t.sales())), {"z_score": 6})


@query("X19_daily_metric_panel", f"with {_PANEL} select * replace (round(bounce_rate, 9) as bounce_rate) from metrics")
def x19(t):
    return rounded(d.daily_metric_panel(t.sales(), t.web_traffic(), t.returns()), {"bounce_rate": 9})


@query("X20_correlation_matrix", f"with {_PANEL} {_MATRIX}")
def x20(t):
    panel = d.daily_metric_panel(t.sales(), t.web_traffic(), t.returns())
    return rounded(d.correlation_matrix(panel), {m: 6 for m in d.METRICS})


@query("X21_revenue_correlations", f"with {_PANEL} {_RANKED}")
def x21(t):
    panel = d.daily_metric_panel(t.sales(), t.web_traffic(), t.returns())
    return rounded(d.correlations_with(panel), {"correlation": 6})


@query(
    "X22_channel_concentration",
    f"""with {_TOTALS} select round(sum(revenue_pct * revenue_pct), 9) as herfindahl,
        (select acquisition_channel from totals order by total_revenue desc, acquisition_channel limit 1) as top_channel,
        (select revenue_pct from totals order by total_revenue desc, acquisition_channel limit 1) as top_share from totals""",
)
def x22(t):
    return rounded(d.channel_concentration(x04(t)), {"herfindahl": 9})


@query(
    "X23_channel_spread",
    f"""with {_COHORT} select min(avg_ltv) as min_ltv, max(avg_ltv) as max_ltv, max(avg_ltv) - min(avg_ltv) as range_ltv,
        round(stddev_samp(avg_ltv) / nullif(avg(avg_ltv), 0), 9) as cv_ltv, min(repeat_rate) as min_repeat_rate,
        max(repeat_rate) as max_repeat_rate, round(stddev_samp(repeat_rate), 9) as std_repeat_rate from cohort""",
)
def x23(t):
    return rounded(d.channel_spread(d.cohort_summary(once(t, "lifetime", lambda: x05(t)))), {"cv_ltv": 9, "std_repeat_rate": 9})


@query(
    "X23_conversion_spread",
    f"""with {_SUMMARY} select round(avg(avg_conversion_rate), 9) as mean_conversion_rate,
        round(min(avg_conversion_rate), 9) as min_conversion_rate, round(max(avg_conversion_rate), 9) as max_conversion_rate,
        round(stddev_samp(avg_conversion_rate), 9) as std_conversion_rate from summary""",
)
def x23_conversion(t):
    summary = d.funnel_summary(d.monthly_funnel(t.web_traffic(), t.orders()))
    spread = d.conversion_spread(summary)
    return rounded(spread, {c: 9 for c in spread.columns})


@query("X24_anomaly_counts", f"with {_FLAGS} select anomaly_type, count(*) as days from classed group by 1")
def x24(t):
    return d.anomaly_counts(d.classify_anomalies(t.sales()))


@query(
    "X24_top_anomalies",
    f"""with {_FLAGS} select date, revenue, round(z_score, 6) as z_score, anomaly_type from classed
        where anomaly_type <> 'normal' order by revenue desc, date limit 10""",
)
def x24_top(t):
    from tallyloom.operators.relational import top_n

    return rounded(
        top_n(d.anomalies_only(d.classify_anomalies(t.sales())), 10, revenue=False, date=True), {"z_score": 6}
    )
