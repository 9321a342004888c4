"""Registry of named queries and the SQL text each one is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tallyloom.sources.tables import EVENT_SHIFT_DAYS, StarTables

Builder = Callable[[StarTables], DataFrame]


@dataclass(frozen=True)
class NamedQuery:
    name: str
    build: Builder
    sql: str | None


CATALOG: dict[str, NamedQuery] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a plan builder under a name, with the equivalent SQL where one exists."""

    def add(build: Builder) -> Builder:
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        CATALOG[name] = NamedQuery(name, build, with_views(sql) if sql else None)
        return build

    return add


def run(name: str, spark: SparkSession, directory: str) -> DataFrame:
    return CATALOG[name].build(StarTables(spark, directory))


# The retail views as SQL, in dependency order. `with_views` prepends the ones a query names.
VIEWS: dict[str, str] = {
    "v_products": """select p_partkey as product_id, p_name as product_name, p_brand as category,
        p_type as segment,
        case when p_size <= 12 then 'S' when p_size <= 25 then 'M' when p_size <= 38 then 'L' else 'XL' end as size,
        p_retailprice as price, p_retailprice * (0.4e0 + p_size / 1e2) as cogs from part""",
    "v_customers": """select c_custkey as customer_id, c_nationkey as zip,
        nullif(c_mktsegment, 'MACHINERY') as acquisition_channel,
        case when c_acctbal < 0 then null when c_acctbal < 2500 then '25-34' when c_acctbal < 5000 then '35-44'
             when c_acctbal < 7500 then '45-54' else '55+' end as age_group from customer""",
    "v_geography": """select n_nationkey as zip, n_name as city, r_name as region
        from nation join region on n_regionkey = r_regionkey""",
    "v_orders": """select o_orderkey as order_id, cast(o_orderdate as date) as order_date,
        o_custkey as customer_id, c_nationkey as zip,
        case when o_orderstatus = 'P' then 'cancelled' when o_orderstatus = 'O' then 'shipped'
             when o_orderkey % 4 = 0 then 'returned' else 'delivered' end as order_status,
        case substr(o_orderpriority, 1, 1) when '1' then 'credit_card' when '2' then 'cod' when '3' then 'paypal'
             when '4' then 'bank_transfer' when '5' then 'wallet' end as payment_method,
        case substr(o_orderpriority, 1, 1) when '1' then 'view' when '2' then 'click' when '3' then 'signup'
             when '4' then 'purchase' when '5' then 'error' end as order_source
        from orders left join customer on o_custkey = c_custkey""",
    "v_order_items": """select l_orderkey as order_id, l_partkey as product_id,
        cast(l_quantity as bigint) as quantity, l_extendedprice / l_quantity as unit_price,
        l_extendedprice * l_discount as discount_amount,
        case when l_discount > 0 then 'PROMO-' || cast(cast(round(l_discount * 100) as integer) as varchar) end
            as promo_id, cast(null as varchar) as promo_id_2 from lineitem""",
    "v_promotions": """select 'PROMO-' || cast(pct as varchar) as promo_id, cast(pct as double) as discount_value,
        cast(min(l_shipdate) as date) as start_date, cast(max(l_shipdate) as date) as end_date
        from (select cast(round(l_discount * 100) as integer) as pct, l_shipdate from lineitem where l_discount > 0)
        group by pct""",
    "v_payments": """select o_orderkey as order_id,
        case substr(o_orderpriority, 1, 1) when '1' then 'credit_card' when '2' then 'cod' when '3' then 'paypal'
             when '4' then 'bank_transfer' when '5' then 'wallet' end as payment_method,
        o_totalprice as payment_value,
        cast(case substr(o_orderpriority, 1, 1) when '1' then 1 when '2' then 3 when '3' then 6 when '4' then 12
             when '5' then 24 end as integer) as installments from orders""",
    "v_shipments": """select l_orderkey as order_id, cast(min(l_shipdate) as date) as ship_date,
        cast(max(l_shipdate) as date) as delivery_date from lineitem group by l_orderkey""",
    "v_returns": """select cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) as return_id,
        l_orderkey as order_id, l_partkey as product_id, cast(l_shipdate as date) as return_date,
        case l_linenumber % 4 when 0 then 'defective' when 1 then 'wrong_size' when 2 then 'changed_mind'
             when 3 then 'not_as_described' end as return_reason,
        cast(ceil(l_quantity / 10) as bigint) as return_quantity,
        l_extendedprice * (1e0 - l_discount) as refund_amount from lineitem where l_returnflag = 'R'""",
    "v_reviews": """select event_id as review_id, event_id as order_id, user_id as customer_id,
        cast(ts as date) as review_date, cast(floor(value / 50) + 1 as integer) as rating
        from events where event_type = 'purchase'""",
    "v_sales": """select order_date as date,
        cast(sum(cast(unit_price * quantity - discount_amount as decimal(18,4))) as double) as revenue,
        cast(sum(cast(quantity * cogs as decimal(18,4))) as double) as cogs
        from v_order_items join v_orders using (order_id) join v_products using (product_id) group by order_date""",
    "v_panel": """select segment as series, order_date as date,
        cast(sum(cast(unit_price * quantity - discount_amount as decimal(18,4))) as double) as revenue,
        cast(sum(cast(quantity * cogs as decimal(18,4))) as double) as cogs
        from v_order_items join v_orders using (order_id) join v_products using (product_id)
        group by segment, order_date""",
    "v_sample_submission": """select cast(unnest(generate_series(hi + interval 1 day, hi + interval 548 day, interval 1 day)) as date) as date
        from (select max(order_date)::timestamp as hi from v_orders)""",
    "v_spine": """select cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as date
        from (select min(order_date)::timestamp as lo, max(order_date)::timestamp as hi from v_orders)""",
    "v_daily": """select p.date, coalesce(s.revenue, 0e0) as revenue, coalesce(s.cogs, 0e0) as cogs
        from v_spine p left join v_sales s on s.date = p.date""",
    "v_dense": """select k.series, p.date, coalesce(s.revenue, 0e0) as revenue, coalesce(s.cogs, 0e0) as cogs
        from v_spine p cross join (select distinct series from v_panel) k
        left join v_panel s on s.date = p.date and s.series = k.series""",
    "v_web_traffic": f"""select cast(cast(ts as date) - {EVENT_SHIFT_DAYS} as date) as date,
        event_type as traffic_source, count(*) as sessions, count(distinct user_id) as unique_visitors,
        cast(floor(cast(sum(cast(value as decimal(18,4))) as double)) as bigint) as page_views,
        avg(case when value < 15 then 1e0 else 0e0 end) as bounce_rate,
        cast(sum(cast(value as decimal(18,4))) as double) / count(*) as avg_session_duration_sec
        from events group by 1, 2""",
    "v_inventory": """select snapshot_date, product_id, units_sold,
        cast(case when units_sold > 40 then 1 else 0 end as integer) as stockout_flag,
        least(1e0, 40e0 / units_sold) as fill_rate, 1500e0 / units_sold as days_of_supply
        from (select last_day(cast(l_shipdate as date)) as snapshot_date, l_partkey as product_id,
              cast(sum(cast(l_quantity as bigint)) as bigint) as units_sold from lineitem group by 1, 2)""",
    "v_line_facts": """select i.order_id, i.product_id, o.order_date, o.customer_id, c.acquisition_channel,
        cast(i.unit_price * i.quantity - i.discount_amount as decimal(18,4)) as net, i.quantity
        from v_order_items i left join v_orders o using (order_id) left join v_customers c using (customer_id)""",
}


def with_views(body: str) -> str:
    """Prepend the named views, and the views they use, as common table expressions."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, definition in VIEWS.items():
            if name in text and name not in needed:
                needed.add(name)
                visit(definition)

    visit(body)
    ctes = [f"{name} as ({VIEWS[name]})" for name in VIEWS if name in needed]
    if not ctes:
        return body.strip()
    text = body.strip()
    if text.lower().startswith("with recursive "):
        return "with recursive " + ",\n".join(ctes) + ",\n" + text[15:]
    if text.lower().startswith("with "):
        return "with " + ",\n".join(ctes) + ",\n" + text[5:]
    return "with " + ",\n".join(ctes) + "\n" + text
