"""Named queries Q01-Q25."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import audit as a
from tallyloom.plans.catalog import query
from tallyloom.plans.common import daily_sales, panel_sales
from tallyloom.sources.schemas import REGISTRY
from tallyloom.sources.tables import StarTables

AUDITED = (
    "products", "customers", "promotions", "geography", "orders", "order_items", "payments",
    "shipments", "returns", "reviews", "sales", "inventory", "web_traffic", "sample_submission",
)


def tables(t, names=AUDITED, with_zip=False):
    """The logical tables; ``with_zip`` adds the derived zip to orders at the price of a join."""
    return {n: (t.orders_with_zip() if with_zip and n == "orders" else t.table(n)) for n in names}


# Columns of each view with their Spark type names, for the profile's SQL.
_PROFILED = {
    "products": "product_id bigint, product_name string, category string, segment string, size string, price double, cogs double",
    "customers": "customer_id bigint, zip int, acquisition_channel string, age_group string",
    "promotions": "promo_id string, discount_value double, start_date date, end_date date",
    "geography": "zip int, city string, region string",
    "orders": "customer_id bigint, order_id bigint, order_date date, zip int, order_status string, payment_method string, order_source string",
    "order_items": "order_id bigint, product_id bigint, quantity bigint, unit_price double, discount_amount double, promo_id string, promo_id_2 string",
    "payments": "order_id bigint, payment_method string, payment_value double, installments int",
    "returns": "return_id string, order_id bigint, product_id bigint, return_date date, return_reason string, return_quantity bigint, refund_amount double",
    "reviews": "review_id bigint, order_id bigint, customer_id bigint, review_date date, rating int",
    "shipments": "order_id bigint, ship_date date, delivery_date date",
    "sales": "date date, revenue double, cogs double",
    "inventory": "snapshot_date date, product_id bigint, units_sold bigint, stockout_flag int, fill_rate double, days_of_supply double",
    "web_traffic": "date date, traffic_source string, sessions bigint, unique_visitors bigint, page_views bigint, "
    "bounce_rate double, avg_session_duration_sec double",
    "sample_submission": "date date",
}


def _profile_sql(table: str, pairs: str) -> str:
    parts = []
    for pair in pairs.split(","):
        c, kind = pair.split()
        parts.append(
            f"""select '{table}' as "table", '{c}' as "column", '{kind}' as dtype, count(*) as rows, count({c}) as non_null,
            count(*) - count({c}) as null_count,
            coalesce(cast((count(*) - count({c})) * 100 as double) / nullif(count(*), 0), 0e0) as null_pct,
            count(distinct {c}) as distinct_count from v_{table}"""
        )
    return " union all ".join(parts)


@query("Q01_column_profile", " union all ".join(_profile_sql(n, p) for n, p in _PROFILED.items()))
def q01(t):
    return a.column_profile(tables(t, _PROFILED, with_zip=True))


_NULLS = " union all ".join(
    f"""select '{n}' as "table", '{p.split()[0]}' as "column", count(*) - count({p.split()[0]}) as null_count,
    cast((count(*) - count({p.split()[0]})) * 100 as double) / nullif(count(*), 0) as null_pct,
    '{"expected_business_null" if p.split()[0] in REGISTRY.tables[n].expected_nulls else "suspicious_null"}' as classification
    from v_{n}"""
    for n, pairs in _PROFILED.items()
    for p in pairs.split(",")
)


@query("Q02_missing_report", f"select * from ({_NULLS}) where null_count > 0")
def q02(t):
    return a.missing_report(tables(t, _PROFILED, with_zip=True), REGISTRY.tables)


_DUP_TABLES = AUDITED


@query(
    "Q03_full_row_duplicates",
    " union all ".join(
        f"""select '{n}' as "table", (select count(*) from v_{n}) - (select count(*) from (select distinct * from v_{n}))
        as duplicate_count"""
        for n in _DUP_TABLES
    ),
)
def q03(t):
    return a.full_row_duplicates(tables(t, _DUP_TABLES, with_zip=True))


_KEYED = tuple(n for n in AUDITED if REGISTRY.tables[n].key)


@query(
    "Q04_key_duplicates",
    " union all ".join(
        f"""select '{n}' as "table", '{",".join(REGISTRY.tables[n].key)}' as columns,
        cast(coalesce(sum(n - 1), 0) as bigint) as duplicate_count
        from (select count(*) as n from v_{n} group by {", ".join(REGISTRY.tables[n].key)})"""
        for n in _KEYED
    ),
)
def q04(t):
    return a.key_duplicates(tables(t, _KEYED), REGISTRY.tables)


_DATED = {
    "promotions": ("start_date", "end_date"),
    "orders": ("order_date",),
    "shipments": ("ship_date", "delivery_date"),
    "returns": ("return_date",),
    "reviews": ("review_date",),
    "sales": ("date",),
    "inventory": ("snapshot_date",),
    "web_traffic": ("date",),
    "sample_submission": ("date",),
}


@query(
    "Q05_date_coverage",
    " union all ".join(
        f"""select '{n}' as "table", '{c}' as "column", min({c}) as min_date, max({c}) as max_date,
        cast(0 as bigint) as parse_fail_count,
        coalesce(bool_or(regexp_matches(cast({c} as varchar), '\\d{{2}}:\\d{{2}}|T\\d{{2}}')), false) as has_time_component
        from v_{n}"""
        for n, cols in _DATED.items()
        for c in cols
    ),
)
def q05(t):
    """Of CSV files the text itself is judged, before any cast could hide what does not parse."""
    if not hasattr(t, "raw"):
        return a.date_coverage(tables(t, _DATED), _DATED)
    columns = {n: spec.date_columns for n, spec in REGISTRY.tables.items() if spec.date_columns}
    return a.date_coverage({n: t.raw(n) for n in columns}, columns)


@query(
    "Q05_date_parse_failures",
    """select 'events' as "table", 'props' as "column", min(try_cast(props as date)) as min_date,
       max(try_cast(props as date)) as max_date, count(*) as parse_fail_count,
       coalesce(bool_or(regexp_matches(props, '\\d{2}:\\d{2}|T\\d{2}')), false) as has_time_component
       from events where props is not null and try_cast(props as date) is null""",
)
def q05_text(t):
    return a.date_coverage({"events": t.base("events")}, {"events": ("props",)})


@query(
    "Q06_time_component",
    """select 'orders' as "table", 'o_orderdate' as "column",
       coalesce(bool_or(regexp_matches(cast(o_orderdate as varchar), '\\d{2}:\\d{2}|T\\d{2}')), false) as has_time_component from orders
       union all select 'events', 'ts', coalesce(bool_or(regexp_matches(cast(ts as varchar), '\\d{2}:\\d{2}|T\\d{2}')), false) from events
       union all select 'v_orders', 'order_date', coalesce(bool_or(regexp_matches(cast(order_date as varchar), '\\d{2}:\\d{2}|T\\d{2}')), false)
       from v_orders""",
)
def q06(t):
    parts = [("orders", "o_orderdate", t.base("orders")), ("events", "ts", t.base("events")), ("v_orders", "order_date", t.orders())]
    return a.union_all(
        df.agg(a.has_time_part(c).alias("has_time_component")).select(
            F.lit(n).alias("table"), F.lit(c).alias("column"), "has_time_component"
        )
        for n, c, df in parts
    )


def _rule_sql(name: str, table: str, violation: str) -> str:
    return f"""select 'constraint' as check_group, '{name}' as check_name,
        case when count(*) filter (where {violation}) = 0 then 'PASS' else 'FAIL' end as status,
        count(*) filter (where {violation}) as failures,
        'invalid_rows=' || cast(count(*) filter (where {violation}) as varchar) as details from {table}"""


_Q07 = _rule_sql("products.cogs_lt_price", "v_products", "cogs >= price")
_Q08 = _rule_sql("promotions.start_le_end", "v_promotions", "start_date > end_date")
_Q09 = _rule_sql("shipments.delivery_ge_ship", "v_shipments", "ship_date > delivery_date")
_Q10 = _rule_sql("reviews.rating_1_to_5", "v_reviews", "not coalesce(rating between 1 and 5, false)")
_Q11 = (
    _rule_sql("inventory.fill_rate_0_to_1", "v_inventory", "fill_rate < 0 or fill_rate > 1")
    + " union all "
    + _rule_sql("web_traffic.bounce_rate_0_to_1", "v_web_traffic", "bounce_rate < 0 or bounce_rate > 1")
)


@query("Q07_cogs_below_price", _Q07)
def q07(t):
    return a.less_than(t.products(), "products.cogs_lt_price", "cogs", "price")


@query("Q08_promotion_dates", _Q08)
def q08(t):
    return a.date_order(t.promotions(), "promotions.start_le_end", "start_date", "end_date")


@query("Q09_shipment_dates", _Q09)
def q09(t):
    return a.date_order(t.shipments(), "shipments.delivery_ge_ship", "ship_date", "delivery_date")


@query(
    "Q09_line_ships_after_order",
    _rule_sql(
        "order_items.ship_ge_order",
        "(select order_date, cast(l_shipdate as date) as ship_date from lineitem join v_orders on l_orderkey = order_id)",
        "order_date > ship_date",
    ),
)
def q09_lines(t):
    lines = t.base("lineitem").select(F.col("l_orderkey").alias("order_id"), F.to_date("l_shipdate").alias("ship_date"))
    dated = lines.join(t.orders().select("order_id", "order_date"), "order_id")
    return a.date_order(dated, "order_items.ship_ge_order", "order_date", "ship_date")


@query("Q10_rating_domain", _Q10)
def q10(t):
    return a.in_range_strict(t.reviews(), "reviews.rating_1_to_5", "rating", 1, 5)


@query("Q11_ratio_domains", _Q11)
def q11(t):
    return a.union_all(
        [
            a.ratio_range(t.inventory(), "inventory.fill_rate_0_to_1", "fill_rate"),
            a.ratio_range(t.web_traffic(), "web_traffic.bounce_rate_0_to_1", "bounce_rate"),
        ]
    )


_CONVERSION = """(select w.*, n / nullif(sessions, 0) as conversion_rate from v_web_traffic w left join
    (select order_date as date, order_source as traffic_source, count(*) as n from v_orders group by 1, 2)
    using (date, traffic_source))"""


@query(
    "Q12_optional_ratio_domain",
    _rule_sql("web_traffic.conversion_rate_0_to_1", _CONVERSION, "conversion_rate < 0 or conversion_rate > 1"),
)
def q12(t):
    """The column is not in every delivery of the table; here it is derived, so the check runs."""
    from tallyloom.functions.expr import ratio

    counts = t.orders().groupBy(F.col("order_date").alias("date"), F.col("order_source").alias("traffic_source")).agg(
        F.count(F.lit(1)).alias("n")
    )
    traffic = t.web_traffic().join(counts, ["date", "traffic_source"], "left").withColumn(
        "conversion_rate", ratio("n", "sessions")
    )
    return a.optional_ratio_range(traffic, "web_traffic.conversion_rate_0_to_1", "conversion_rate")


# The reviews of the star view name no product; of CSV files all keys are checked.
_FKS = tuple(
    fk for fk in REGISTRY.foreign_keys if not (fk.child == "reviews" and fk.child_column == "product_id")
)
_Q13 = " union all ".join(
        f"""select '{fk.child}' as child_table, '{fk.child_column}' as child_column, '{fk.parent}' as parent_table,
        '{fk.parent_column}' as parent_column, {str(fk.required).lower()} as required_fk,
        count(*) as checked_rows, count(*) filter (where k is null) as invalid_fk_count,
        case when count(*) filter (where k is null) = 0 then 'PASS' else 'FAIL' end as status
        from (select {fk.child_column} as c from v_{fk.child} {"" if fk.required else f"where {fk.child_column} is not null"}) x
        left join (select distinct {fk.parent_column} as k from v_{fk.parent}) p on c = k"""
    for fk in _FKS
)


@query("Q13_foreign_keys", _Q13)
def q13(t):
    return a.foreign_key_report(REGISTRY.foreign_keys, tables(t, with_zip=True))


def _check_sql(name: str, failures: str, source: str, details: str | None = None) -> str:
    details = details or "'invalid_rows=' || cast(failures as varchar)"
    return f"""select 'cardinality' as check_group, '{name}' as check_name,
        case when failures = 0 then 'PASS' else 'FAIL' end as status, failures, {details} as details
        from (select *, cast({failures} as bigint) as failures from ({source}))"""


_Q14 = _check_sql(
    "orders_payments_1_to_1",
    "missing + extra + dup",
    """select (select count(*) from (select order_id from v_orders except select order_id from v_payments)) as missing,
       (select count(*) from (select order_id from v_payments except select order_id from v_orders)) as extra,
       (select count(*) - count(distinct order_id) from v_payments) as dup""",
    "'missing_payments=' || missing || '; extra_payments=' || extra || '; payments_duplicates=' || dup",
)
_Q15 = _check_sql(
    "orders_shipments_1_to_0_or_1",
    "dup + orphan",
    """select (select count(*) - count(distinct order_id) from v_shipments) as dup,
       (select count(*) from v_shipments where order_id not in (select order_id from v_orders)) as orphan""",
    "'duplicates=' || dup || '; invalid_links=' || orphan",
)
_Q16 = _check_sql(
    "orders_status_requires_shipments",
    "n",
    """select count(*) as n from v_orders where lower(order_status) in ('shipped', 'delivered', 'returned')
       and order_id not in (select order_id from v_shipments)""",
)


def _links_sql(name: str, child: str, where: str = "true") -> str:
    return _check_sql(
        name,
        "n",
        f"select count(*) as n from v_{child} where order_id not in (select order_id from v_orders where {where})",
    )


_Q17 = _links_sql("orders_returns_1_to_0_or_many", "returns") + " union all " + _links_sql(
    "orders_reviews_1_to_0_or_many", "reviews"
)
_Q18 = _links_sql(
    "returns_should_map_to_returned_orders", "returns", "lower(order_status) = 'returned'"
) + " union all " + _links_sql("reviews_should_map_to_delivered_orders", "reviews", "lower(order_status) = 'delivered'")
_Q19 = _check_sql(
    "products_inventory_one_row_per_product_month",
    "n",
    "select count(*) - (select count(*) from (select distinct snapshot_date, product_id from v_inventory)) as n from v_inventory",
)


@query("Q14_one_to_one", _Q14)
def q14(t):
    return a.one_to_one(t.orders(), t.payments(), "order_id", "orders_payments_1_to_1", "payments")


@query("Q15_one_to_optional", _Q15)
def q15(t):
    return a.one_to_optional(t.orders(), t.shipments(), "order_id", "orders_shipments_1_to_0_or_1")


@query("Q16_status_requires_child", _Q16)
def q16(t):
    return a.status_requires_child(
        t.orders(), t.shipments(), "order_id", "order_status", ["shipped", "delivered", "returned"],
        "orders_status_requires_shipments",
    )


@query("Q17_child_links", _Q17)
def q17(t):
    orders = t.orders()
    return a.union_all(
        [
            a.child_links(orders, t.returns(), "order_id", "orders_returns_1_to_0_or_many"),
            a.child_links(orders, t.reviews(), "order_id", "orders_reviews_1_to_0_or_many"),
        ]
    )


@query("Q18_child_requires_status", _Q18)
def q18(t):
    orders = t.orders()
    return a.union_all(
        [
            a.child_requires_status(
                orders, t.returns(), "order_id", "order_status", "returned", "returns_should_map_to_returned_orders"
            ),
            a.child_requires_status(
                orders, t.reviews(), "order_id", "order_status", "delivered", "reviews_should_map_to_delivered_orders"
            ),
        ]
    )


@query("Q19_unique_grain", _Q19)
def q19(t):
    return a.unique_grain(
        t.inventory(), ["snapshot_date", "product_id"], "products_inventory_one_row_per_product_month"
    )


_Q12 = _rule_sql("web_traffic.conversion_rate_0_to_1", _CONVERSION, "conversion_rate < 0 or conversion_rate > 1")
_KEYS = f"""select 'foreign_key' as check_group, child_table || '.' || child_column as check_name, status,
    invalid_fk_count as failures, 'checked_rows=' || cast(checked_rows as varchar) as details from ({_Q13})"""
_ALL_CHECKS = " union all ".join([_Q07, _Q08, _Q09, _Q10, _Q11, _Q12, _Q14, _Q15, _Q16, _Q17, _Q18, _Q19, _KEYS])


@query(
    "Q20_check_roll_up",
    f"""select check_group, status, count(*) as checks, cast(sum(failures) as bigint) as failures
        from ({_ALL_CHECKS}) group by 1, 2""",
)
def q20(t):
    """The checks of Q14 to Q18 come from one row per order, the foreign keys from one row per key and parent."""
    checks = [f(t) for f in (q07, q08, q09, q10, q11, q12, q19)]
    children = {"payments": t.payments(), "shipments": t.shipments(), "returns": t.returns(), "reviews": t.reviews()}
    orders = a.cardinality_checks(t.orders(), "order_id", "order_status", children, _ORDER_CHECKS)
    return a.roll_up(a.union_all([c for c in checks if c is not None] + [orders, a.foreign_key_rows(q13(t))]))


_ORDER_CHECKS = (
    ("one_to_one", "orders_payments_1_to_1", "payments"),
    ("one_to_optional", "orders_shipments_1_to_0_or_1", "shipments"),
    ("status_requires", "orders_status_requires_shipments", "shipments", ("shipped", "delivered", "returned")),
    ("links", "orders_returns_1_to_0_or_many", "returns"),
    ("links", "orders_reviews_1_to_0_or_many", "reviews"),
    ("requires_status", "returns_should_map_to_returned_orders", "returns", "returned"),
    ("requires_status", "reviews_should_map_to_delivered_orders", "reviews", "delivered"),
)


@query("Q14_Q18_order_cardinality", " union all ".join([_Q14, _Q15, _Q16, _Q17, _Q18]))
def q14_to_q18(t):
    """All cardinality checks of the orders together."""
    children = {"payments": t.payments(), "shipments": t.shipments(), "returns": t.returns(), "reviews": t.reviews()}
    return a.cardinality_checks(t.orders(), "order_id", "order_status", children, _ORDER_CHECKS)


def _window_sql(name: str, source: str, first: str, last: str) -> str:
    return f"""select 'window' as check_group, '{name}' as check_name,
        case when f = 0 then 'PASS' else 'FAIL' end as status, cast(f as bigint) as failures, details from (
        select case when min(date) = date '{first}' then 0 else 1 end + case when max(date) = date '{last}' then 0 else 1 end as f,
        cast(min(date) as varchar) || ' -> ' || cast(max(date) as varchar) as details from {source})"""


_HORIZON = """(select cast(unnest(generate_series(hi + interval 1 day, hi + interval 548 day, interval 1 day)) as date) as date
    from (select max(order_date)::timestamp as hi from v_orders))"""


@query(
    "Q21_window_check",
    _window_sql("sales", "v_sales", *StarTables.sales_window)
    + " union all "
    + _window_sql("horizon", _HORIZON, *StarTables.horizon_window),
)
def q21(t):
    return a.union_all(
        [
            a.window_check(t.sales(), "sales", *t.sales_window),
            a.window_check(t.horizon(), "horizon", *t.horizon_window),
        ]
    )


_NAIVE_548 = """(select cast(hi + to_days(cast(h as integer)) as date) as date,
    (select revenue from v_daily d where d.date = cast(hi + to_days(cast(h - 7 * ((h - 1) // 7 + 1) as integer)) as date)) as predicted
    from (select max(order_date)::timestamp as hi from v_orders), (select unnest(range(1, 549)) as h))"""


@query(
    "Q22_output_contract",
    f"""select 'forecast' as check_group, 'weekly_naive_548_days' as check_name,
        case when m + r + e = 0 then 'PASS' else 'FAIL' end as status, cast(m + r + e as bigint) as failures,
        'missing=' || m || '; extra=' || x || '; repeated=' || r || '; empty=' || e as details from (
        select count(*) filter (where p.date is null) as m, count(*) filter (where h.date is null) as x,
        0 as r, count(*) filter (where p.date is not null and predicted is null) as e
        from {_HORIZON} h full join {_NAIVE_548} p on p.date = h.date)""",
)
def q22(t):
    from tallyloom.operators.forecast import seasonal_naive

    forecast = seasonal_naive(daily_sales(t), t.horizon_days, 7)
    return a.output_contract(t.horizon(), forecast, "predicted", f"weekly_naive_{t.horizon_days}_days")


@query(
    "Q23_fold_completeness",
    """select cast(fold_id as integer) as fold_id, count(date) as rows, case when count(date) = 120 then 'PASS' else 'FAIL' end as status
       from (select unnest(range(1, 4)) as fold_id) f cross join (select max(date) as hi from v_daily) h left join v_daily d
       on date > hi - cast((4 - fold_id) * 120 as integer) and date <= hi - cast((3 - fold_id) * 120 as integer) group by 1""",
)
def q23(t):
    from tallyloom.operators.forecast import validation_rows

    daily = daily_sales(t)
    return a.fold_completeness(validation_rows(daily), 120)


@query(
    "Q24_enough_history",
    "select series, count(*) as rows, count(*) >= 365 as has_history from v_dense group by 1",
)
def q24(t):
    return a.enough_history(panel_sales(t), 365, ["series"])
