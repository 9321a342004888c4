"""Named queries D01-D14."""

from __future__ import annotations

from tallyloom.operators import kpi as k
from tallyloom.plans.catalog import query
from tallyloom.plans.common import rounded


@query(
    "D01_daily_revenue",
    """select date, revenue, cogs, revenue - cogs as gross_profit,
       cast(sum(cast(revenue as decimal(18,4))) over w as double) / count(revenue) over w as revenue_30d_ma
       from v_sales window w as (order by date rows between 29 preceding and current row)""",
)
def d01(t):
    return k.daily_revenue(t.sales())


@query(
    "D01_daily_revenue_by_segment",
    """select series, date, revenue, cogs, revenue - cogs as gross_profit,
       cast(sum(cast(revenue as decimal(18,4))) over w as double) / count(revenue) over w as revenue_30d_ma
       from v_panel window w as (partition by series order by date rows between 29 preceding and current row)""",
)
def d01_panel(t):
    return k.daily_revenue(t.sales(keys=("segment",)).withColumnRenamed("segment", "series"), ["series"])


@query(
    "D02_monthly_revenue",
    """select cast(date_trunc('month', date) as date) as month, cast(sum(cast(revenue as decimal(18,4))) as double) as revenue,
       cast(sum(cast(cogs as decimal(18,4))) as double) as cogs,
       cast(sum(cast(revenue - cogs as decimal(18,4))) as double) as gross_profit,
       cast(sum(cast(revenue as decimal(18,4))) as double) / count(revenue) as avg_daily_revenue from v_sales where date is not null group by 1""",
)
def d02(t):
    return k.monthly_revenue(t.sales())


@query(
    "D03_month_seasonality",
    """select cast(month(date) as integer) as month_num,
       cast(sum(cast(revenue as decimal(18,4))) as double) / count(revenue) as avg_revenue,
       round(median(revenue) + 1e-7, 4) as median_revenue from v_sales where date is not null group by 1""",
)
def d03(t):
    return rounded(k.month_seasonality(t.sales()), {"median_revenue": 4}, nudge=1e-7)


@query(
    "D04_monthly_orders",
    """select cast(date_trunc('month', order_date) as date) as month, count(distinct order_id) as order_count
       from v_orders group by 1""",
)
def d04(t):
    return k.monthly_orders(t.orders())


def _mix_sql(view: str, column: str, key: str, count: str) -> str:
    return f"""select coalesce({column}, 'unknown') as {column}, count(distinct {key}) as {count},
        cast(count(distinct {key}) * 100 as double) / sum(count(distinct {key})) over () as share_pct
        from {view} group by 1"""


@query("D05_order_source_mix", _mix_sql("v_orders", "order_source", "order_id", "order_count"))
def d05(t):
    return k.order_source_mix(t.orders())


@query("D06_acquisition_mix", _mix_sql("v_customers", "acquisition_channel", "customer_id", "customer_count"))
def d06(t):
    return k.acquisition_mix(t.customers())


@query(
    "D07_category_revenue",
    """select category, cast(sum(cast(unit_price * quantity as decimal(18,4))) as double) as total_revenue,
       cast(sum(quantity) as bigint) as total_units from v_order_items join v_products using (product_id) group by 1""",
)
def d07(t):
    return k.category_revenue(t.order_items(), t.products())


@query(
    "D08_segment_margin",
    """select segment, round(avg((price - cogs) / price), 9) as avg_margin_rate, count(distinct product_id) as n_products
       from v_products where segment is not null group by 1""",
)
def d08(t):
    return rounded(k.segment_margin(t.products()), {"avg_margin_rate": 9})


@query(
    "D09_return_reason_counts",
    "select return_reason, count(return_id) as return_records from v_returns where return_reason is not null group by 1",
)
def d09(t):
    return k.return_reason_counts(t.returns())


@query(
    "D10_return_rate_by_category",
    """select category, coalesce(r.n, 0) as return_records, coalesce(s.n, 0) as order_item_rows,
       coalesce(coalesce(r.n, 0) / nullif(coalesce(s.n, 0), 0), 0e0) as return_rate from
       (select category, count(*) as n from v_returns join v_products using (product_id) group by 1) r full join
       (select category, count(*) as n from v_order_items join v_products using (product_id) group by 1) s using (category)""",
)
def d10(t):
    return k.return_rate_by_category(t.returns(), t.order_items(), t.products())


@query("D11_rating_distribution", "select rating, count(review_id) as review_count from v_reviews where rating is not null group by 1")
def d11(t):
    return k.rating_distribution(t.reviews())


@query(
    "D12_inventory_health",
    """select cast(date_trunc('month', snapshot_date) as date) as month,
       cast(sum(stockout_flag) as double) / count(stockout_flag) as stockout_rate,
       round(avg(fill_rate), 9) as avg_fill_rate, round(avg(days_of_supply), 7) as avg_days_of_supply
       from v_inventory where snapshot_date is not null group by 1""",
)
def d12(t):
    return rounded(k.inventory_health(t.inventory()), {"avg_fill_rate": 9, "avg_days_of_supply": 7})


_WEB = """web as (select date, cast(sum(sessions) as bigint) as sessions, cast(sum(unique_visitors) as bigint) as unique_visitors,
    cast(sum(page_views) as bigint) as page_views, round(avg(bounce_rate), 9) as bounce_rate from v_web_traffic group by 1)"""


@query("D13_daily_web", f"with {_WEB} select * from web")
def d13(t):
    return rounded(k.daily_web(t.web_traffic()), {"bounce_rate": 9})


@query(
    "D14_daily_conversion",
    f"""with {_WEB}, per_day as (select order_date as date, count(distinct order_id) as order_count from v_orders group by 1),
        joined as (select web.*, coalesce(order_count, 0) as order_count,
        coalesce(coalesce(order_count, 0) / nullif(sessions, 0), 0e0) as conversion_proxy from web left join per_day using (date))
        select *, cast(sum(sessions) over w as double) / count(sessions) over w as sessions_30d_ma,
        round(avg(conversion_proxy) over w, 9) as conversion_proxy_30d_ma
        from joined window w as (order by date rows between 29 preceding and current row)""",
)
def d14(t):
    return rounded(k.daily_conversion(t.web_traffic(), t.orders()), {"bounce_rate": 9, "conversion_proxy_30d_ma": 9})
