"""Named queries S, P, J, G, W, K, U and C: the relational vocabulary, each over whole tables."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import expr as e
from tallyloom.functions import series as s
from tallyloom.functions.quantile import exact_quantiles
from tallyloom.operators import facts, relational as r, scenario
from tallyloom.operators.audit import union_all
from tallyloom.plans.catalog import query
from tallyloom.plans.common import daily_sales, panel_sales, rounded, segment_days
from tallyloom.session import scratch_path
from tallyloom.sources import readers, writers
from tallyloom.sources.tables import GIVEN_TABLES

CUT = "2000-01-01"

# Sources and sinks -----------------------------------------------------------------------------


@query(
    "S01_scan_all_tables",
    " union all ".join(f"""select '{n}' as "table", count(*) as rows from {n}""" for n in GIVEN_TABLES),
)
def s01(t):
    return union_all(t.base(n).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n in GIVEN_TABLES)


@query("S02_scan_one_table", "select c_custkey, c_nationkey, c_acctbal, c_mktsegment from customer")
def s02(t):
    return t.base("customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("S03_scan_with_dates", "select o_orderkey, cast(o_orderdate as date) as order_date from orders")
def s03(t):
    return t.base("orders").select("o_orderkey", F.to_date("o_orderdate").alias("order_date"))


@query(
    "S04_S05_write_and_read_back",
    """select category, cast(sum(cast(unit_price * quantity as decimal(18,4))) as double) as total_revenue,
       cast(sum(quantity) as bigint) as total_units from v_order_items join v_products using (product_id) group by 1""",
)
def s05(t):
    from tallyloom.operators.kpi import category_revenue

    folder = scratch_path(t.spark, "evidence")
    writers.write_evidence(category_revenue(t.order_items(), t.products()), folder, "category_revenue")
    return readers.read_evidence(t.spark, folder, "category_revenue")


@query("S06_date_spine", "select date from v_spine")
def s06(t):
    return s.date_spine(t.orders().select(F.col("order_date").alias("date")))


@query(
    "S07_parameter_table",
    "select date, k.scenario, revenue * k.factor as value from v_sales cross join "
    "(values ('channel_optimization', 1.05e0), ('traffic_increase', 1.03e0)) k(scenario, factor)",
)
def s07(t):
    return scenario.attach_parameters(
        t.sales().select("date", "revenue"),
        [{"scenario": "channel_optimization", "factor": 1.05}, {"scenario": "traffic_increase", "factor": 1.03}],
    ).select("date", "scenario", (F.col("revenue") * F.col("factor")).alias("value"))


@query(
    "S08_split_by_date",
    f"select case when order_date < date '{CUT}' then 'train' else 'test' end as part, order_id, order_date from v_orders",
)
def s08(t):
    o = t.orders().select("order_id", "order_date")
    train = o.filter(F.col("order_date") < F.lit(CUT).cast("date"))
    test = o.filter(F.col("order_date") >= F.lit(CUT).cast("date"))
    return train.select(F.lit("train").alias("part"), "*").unionByName(test.select(F.lit("test").alias("part"), "*"))


@query(
    "S09_tail_holdout",
    """select series, date, revenue from (select *, row_number() over (partition by series order by date desc) as rn
       from v_dense) where rn <= 120""",
)
def s09(t):
    from tallyloom.operators.backtest import tail_split

    return tail_split(panel_sales(t), 120, ["series"])[1].select("series", "date", "revenue")


@query(
    "S10_ordered_export",
    """select cast(h as integer) as row_id, strftime(hi + to_days(cast(h as integer)), '%Y-%m-%d') as date,
       (select revenue from v_daily d where d.date = cast(hi + to_days(cast(h - 7 * ((h - 1) // 7 + 1) as integer)) as date)) as predicted
       from (select max(order_date)::timestamp as hi from v_orders), (select unnest(range(1, 549)) as h)""",
)
def s10(t):
    from tallyloom.operators.forecast import seasonal_naive

    template = t.horizon()
    return writers.ordered_export(template, seasonal_naive(daily_sales(t), 548, 7), [], ["predicted"])


# Projections, filters, predicates --------------------------------------------------------------


def _simple(name, sql, build):
    query(name, sql)(build)


_simple("P01_column_subset", "select order_id, order_status from v_orders", lambda t: t.orders().select("order_id", "order_status"))
_simple(
    "P02_derived_column",
    "select order_id, product_id, unit_price * quantity - discount_amount as net from v_order_items",
    lambda t: t.order_items().select("order_id", "product_id", e.net_value().alias("net")),
)
_simple(
    "P03_assign_in_chain",
    "select order_id, order_date, cast(date_trunc('month', order_date) as date) as month, cast(year(order_date) as integer) as year from v_orders",
    lambda t: t.orders()
    .select("order_id", "order_date")
    .withColumns({"month": e.month_of("order_date"), "year": F.year("order_date")}),
)
_simple(
    "P04_case_folded_equality",
    "select order_id, payment_method from v_orders where lower(order_status) = 'cancelled'",
    lambda t: t.orders().filter(F.lower("order_status") == "cancelled").select("order_id", "payment_method"),
)
_simple(
    "P05_membership",
    "select order_id, installments, payment_value from v_payments where installments in (1, 3, 6, 12)",
    lambda t: t.payments().filter(F.col("installments").isin(1, 3, 6, 12)).select("order_id", "installments", "payment_value"),
)
_simple(
    "P06_inclusive_range",
    "select review_id, rating from v_reviews where not coalesce(rating between 1 and 5, false)",
    lambda t: t.reviews().filter(~F.coalesce(F.col("rating").between(1, 5), F.lit(False))).select("review_id", "rating"),
)
_simple(
    "P07_date_range",
    "select order_id, order_date from v_orders where order_date between date '1998-01-01' and date '1998-12-31'",
    lambda t: t.orders()
    .filter(F.col("order_date").between(F.lit("1998-01-01").cast("date"), F.lit("1998-12-31").cast("date")))
    .select("order_id", "order_date"),
)
_simple(
    "P08_null_tests",
    "select count(*) filter (where promo_id is null) as without_promo, count(*) filter (where promo_id is not null) as with_promo from v_order_items",
    lambda t: t.order_items().agg(
        F.count_if(F.col("promo_id").isNull()).alias("without_promo"),
        F.count_if(F.col("promo_id").isNotNull()).alias("with_promo"),
    ),
)
_simple(
    "P09_drop_null_rows",
    "select customer_id, age_group, acquisition_channel from v_customers where age_group is not null and acquisition_channel is not null",
    lambda t: t.customers()
    .select("customer_id", "age_group", "acquisition_channel")
    .dropna(subset=["age_group", "acquisition_channel"]),
)
_simple(
    "P10_fill_nulls",
    "select customer_id, coalesce(acquisition_channel, 'unknown') as acquisition_channel, coalesce(age_group, 'none') as age_group from v_customers",
    lambda t: t.customers()
    .select("customer_id", "acquisition_channel", "age_group")
    .fillna({"acquisition_channel": "unknown", "age_group": "none"}),
)
_simple(
    "P11_flag_algebra",
    """select order_id, (payment_value > 200000 or installments = 24) as large_or_long,
       (payment_value > 200000 and not installments = 24) as large_not_long from v_payments""",
    lambda t: t.payments().select(
        "order_id",
        ((F.col("payment_value") > 200000) | (F.col("installments") == 24)).alias("large_or_long"),
        ((F.col("payment_value") > 200000) & ~(F.col("installments") == 24)).alias("large_not_long"),
    ),
)
_simple(
    "P12_two_way_conditional",
    "select product_id, case when price > 1000 then 'high' else 'low' end as price_band from v_products",
    lambda t: t.products().select("product_id", F.when(F.col("price") > 1000, "high").otherwise("low").alias("price_band")),
)
_simple(
    "P13_multi_way_label",
    """select order_id, case when payment_value > 300000 then 'large' when payment_value > 100000 then 'medium'
       when payment_value > 0 then 'small' else 'none' end as label from v_payments""",
    lambda t: t.payments().select(
        "order_id",
        F.when(F.col("payment_value") > 300000, "large")
        .when(F.col("payment_value") > 100000, "medium")
        .when(F.col("payment_value") > 0, "small")
        .otherwise("none")
        .alias("label"),
    ),
)
_simple(
    "P14_null_on_zero_denominator",
    "select order_id, product_id, discount_amount / nullif(discount_amount, 0) as unit, unit_price / nullif(discount_amount, 0) as price_per_discount from v_order_items",
    lambda t: t.order_items().select(
        "order_id",
        "product_id",
        e.ratio("discount_amount", "discount_amount").alias("unit"),
        e.ratio("unit_price", "discount_amount").alias("price_per_discount"),
    ),
)
_simple(
    "P15_clamp",
    "select date, greatest(revenue - 1000000e0, 0e0) as floored, least(cogs, revenue * 0.999e0) as capped_cogs from v_sales",
    lambda t: t.sales().select(
        "date",
        F.greatest(F.col("revenue") - 1000000.0, F.lit(0.0)).alias("floored"),
        F.least("cogs", F.col("revenue") * 0.999).alias("capped_cogs"),
    ),
)
_simple(
    "P16_abs_and_rounding",
    "select event_id, abs(value - 50) as distance, round_even(value, 1) as half_even from events",
    lambda t: t.base("events").select(
        "event_id", F.abs(F.col("value") - 50).alias("distance"), F.bround("value", 1).alias("half_even")
    ),
)
_simple(
    "P17_rename_drop_reorder",
    "select category as brand, product_id as sku, price from v_products",
    lambda t: t.products().withColumnsRenamed({"category": "brand", "product_id": "sku"}).drop("cogs").select("brand", "sku", "price"),
)
_simple(
    "P18_casts",
    "select cast(event_id as varchar) as id_text, cast(floor(value) as bigint) as whole, try_cast(props as double) as props_number from events",
    lambda t: t.base("events").select(
        F.col("event_id").cast("string").alias("id_text"),
        F.floor("value").alias("whole"),
        F.col("props").try_cast("double").alias("props_number"),
    ),
)
_simple(
    "P19_mapping_lookup",
    """select order_id, case payment_method when 'credit_card' then 'A' when 'cod' then 'B' when 'paypal' then 'C'
       when 'bank_transfer' then 'D' end as code from v_orders""",
    lambda t: t.orders().select(
        "order_id",
        F.element_at(
            F.create_map(
                *[F.lit(x) for pair in {"credit_card": "A", "cod": "B", "paypal": "C", "bank_transfer": "D"}.items() for x in pair]
            ),
            F.col("payment_method"),
        ).alias("code"),
    ),
)
_simple(
    "P20_row_mean_and_std",
    """select date, (revenue + cogs + (revenue - cogs)) / 3e0 as row_mean,
       round(sqrt((pow(revenue - m, 2) + pow(cogs - m, 2) + pow(revenue - cogs - m, 2)) / 2e0), 4) as row_std
       from (select *, (revenue + cogs + (revenue - cogs)) / 3e0 as m from v_sales)""",
    lambda t: rounded(
        t.sales()
        .withColumn("profit", F.col("revenue") - F.col("cogs"))
        .select(
            "date",
            r.row_spread(["revenue", "cogs", "profit"])[0].alias("row_mean"),
            r.row_spread(["revenue", "cogs", "profit"])[1].alias("row_std"),
        ),
        {"row_std": 4},
    ),
)

# Joins -----------------------------------------------------------------------------------------

_simple(
    "J01_left_join",
    """select order_id, product_id, quantity, category from v_order_items left join v_products using (product_id)""",
    lambda t: t.order_items()
    .select("order_id", "product_id", "quantity")
    .join(t.products().select("product_id", "category"), "product_id", "left"),
)
_simple(
    "J02_inner_join",
    """select return_id, return_reason, category from v_returns join v_products using (product_id)""",
    lambda t: t.returns()
    .select("return_id", "return_reason", "product_id")
    .join(t.products().select("product_id", "category"), "product_id")
    .drop("product_id"),
)
_simple(
    "J03_full_join_of_aggregates",
    """select product_id, coalesce(a.n, 0) as sold_lines, coalesce(b.n, 0) as returned_lines from
       (select product_id, count(*) as n from v_order_items group by 1) a full join
       (select product_id, count(*) as n from v_returns group by 1) b using (product_id)""",
    lambda t: facts.product_units(t.order_items(), t.returns()).select(
        "product_id", F.col("order_item_rows").alias("sold_lines"), F.col("return_records").alias("returned_lines")
    ),
)


@query(
    "J04_composite_key_join",
    """select w.date, w.traffic_source, sessions, coalesce(n, 0) as order_count from v_web_traffic w left join
       (select order_date, order_source, count(*) as n from v_orders group by 1, 2) o
       on w.date = o.order_date and w.traffic_source = o.order_source""",
)
def j04(t):
    w = t.web_traffic().select("date", "traffic_source", "sessions")
    o = t.orders().groupBy("order_date", "order_source").agg(F.count(F.lit(1)).alias("n"))
    joined = w.join(o, (w.date == o.order_date) & (w.traffic_source == o.order_source), "left")
    return joined.select("date", "traffic_source", "sessions", F.coalesce("n", F.lit(0).cast("long")).alias("order_count"))


_simple(
    "J05_date_join",
    "select date, revenue, sessions from v_sales left join (select date, cast(sum(sessions) as bigint) as sessions from v_web_traffic group by 1) using (date)",
    lambda t: t.sales().select("date", "revenue").join(
        t.web_traffic().groupBy("date").agg(F.sum("sessions").alias("sessions")), "date", "left"
    ),
)


@query(
    "J06_month_day_join",
    """with profile as (select month(date) as m, day(date) as d, avg(sessions) as level from v_web_traffic group by 1, 2)
       select date, round(coalesce(level, 1e0), 6) as level from v_sales left join profile on month(date) = m and day(date) = d""",
)
def j06(t):
    profile = t.web_traffic().groupBy(F.month("date").alias("m"), F.dayofmonth("date").alias("d")).agg(F.avg("sessions").alias("level"))
    joined = t.sales().select("date", F.month("date").alias("m"), F.dayofmonth("date").alias("d")).join(profile, ["m", "d"], "left")
    return joined.select("date", F.round(F.coalesce("level", F.lit(1.0)), 6).alias("level"))


_simple(
    "J07_join_to_indexed_aggregate",
    """select customer_id, age_group, coalesce(n, 0) as n_orders from v_customers left join
       (select customer_id, count(*) as n from v_orders group by 1) using (customer_id)""",
    lambda t: t.customers()
    .select("customer_id", "age_group")
    .join(t.orders().groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_orders")), "customer_id", "left")
    .fillna({"n_orders": 0}),
)
_simple(
    "J08_semi_join",
    "select customer_id, zip from v_customers where customer_id in (select customer_id from v_orders group by 1 having count(*) > 1)",
    lambda t: t.customers()
    .select("customer_id", "zip")
    .join(t.orders().groupBy("customer_id").count().filter("count > 1"), "customer_id", "left_semi"),
)
_simple(
    "J09_anti_join",
    "select order_id, order_date from v_orders where order_id not in (select order_id from v_order_items)",
    lambda t: t.orders().select("order_id", "order_date").join(t.order_items().select("order_id"), "order_id", "left_anti"),
)
_simple(
    "J10_aligned_division",
    """select return_reason, a.n as returned, b.n as high_value, b.n / nullif(a.n, 0) as share from
       (select return_reason, count(*) as n from v_returns group by 1) a full join
       (select return_reason, count(*) as n from v_returns where refund_amount > 50000 group by 1) b using (return_reason)""",
    lambda t: t.returns()
    .groupBy("return_reason")
    .agg(F.count(F.lit(1)).alias("returned"))
    .join(
        t.returns().filter("refund_amount > 50000").groupBy("return_reason").agg(F.count(F.lit(1)).alias("high_value")),
        "return_reason",
        "full",
    )
    .withColumn("share", e.ratio("high_value", "returned")),
)
_simple(
    "J11_aggregate_then_join",
    """select o.order_id, o.order_date, cast(sum(cast(unit_price * quantity - discount_amount as decimal(18,4))) as double) as value,
       count(*) as lines from v_orders o join v_order_items i using (order_id) group by 1, 2""",
    lambda t: t.orders()
    .select("order_id", "order_date")
    .join(facts.order_totals(t.order_items()).select("order_id", F.col("value").cast("double").alias("value"), "lines"), "order_id"),
)
_simple(
    "J12_aligned_series",
    """select a.series, a.date, a.revenue - b.revenue as difference from v_panel a join v_panel b
       on b.series = a.series and b.date = a.date - 7""",
    lambda t: segment_days(t)
    .select("series", "date", "revenue")
    .join(
        segment_days(t).select("series", F.date_add("date", 7).alias("date"), F.col("revenue").alias("before")),
        ["series", "date"],
    )
    .select("series", "date", (F.col("revenue") - F.col("before")).alias("difference")),
)

# Aggregations ----------------------------------------------------------------------------------

_simple(
    "G01_group_sum",
    """select payment_method, cast(sum(cast(payment_value as decimal(18,4))) as double) as total from v_payments group by 1""",
    lambda t: t.payments().groupBy("payment_method").agg(e.money_sum("payment_value").alias("total")),
)
_simple(
    "G02_group_mean_and_rate",
    """select payment_method, cast(sum(cast(payment_value as decimal(18,4))) as double) / count(*) as mean_value,
       cast(count(*) filter (where payment_value > 200000) as double) / count(*) as large_rate from v_payments group by 1""",
    lambda t: t.payments()
    .groupBy("payment_method")
    .agg(e.money_avg("payment_value").alias("mean_value"), e.rate(F.col("payment_value") > 200000).alias("large_rate")),
)
_simple(
    "G03_group_median",
    "select payment_method, round(median(payment_value) + 1e-7, 4) as median_value from v_payments group by 1",
    lambda t: rounded(
        exact_quantiles(t.payments(), ["payment_method"], "payment_value", {"median_value": 0.5}), {"median_value": 4}, nudge=1e-7
    ),
)
_simple(
    "G04_group_std",
    "select payment_method, round(stddev_samp(payment_value), 3) as std_value from v_payments group by 1",
    lambda t: rounded(t.payments().groupBy("payment_method").agg(F.stddev_samp("payment_value").alias("std_value")), {"std_value": 3}),
)
_simple(
    "G05_row_count",
    "select order_status, payment_method, count(*) as n from v_orders group by 1, 2",
    lambda t: t.orders().groupBy("order_status", "payment_method").agg(F.count(F.lit(1)).alias("n")),
)
_simple(
    "G06_non_null_count",
    "select product_id, count(promo_id) as with_promo from v_order_items group by 1",
    lambda t: t.order_items().groupBy("product_id").agg(F.count("promo_id").alias("with_promo")),
)
_simple(
    "G07_distinct_count",
    "select order_source, count(distinct customer_id) as customers, count(distinct order_date) as days from v_orders group by 1",
    lambda t: t.orders()
    .groupBy("order_source")
    .agg(F.count_distinct("customer_id").alias("customers"), F.count_distinct("order_date").alias("days")),
)
_simple(
    "G08_frequency_table",
    "select return_reason, count(*) as count, count(*) / sum(count(*)) over () as share from v_returns where return_reason is not null group by 1",
    lambda t: r.frequency_table(t.returns(), "return_reason"),
)
_simple(
    "G09_many_aggregates",
    """select installments, count(*) as n, cast(sum(cast(payment_value as decimal(18,4))) as double) as total,
       min(payment_value) as smallest, max(payment_value) as largest, count(distinct payment_method) as methods from v_payments group by 1""",
    lambda t: t.payments()
    .groupBy("installments")
    .agg(
        F.count(F.lit(1)).alias("n"),
        e.money_sum("payment_value").alias("total"),
        F.min("payment_value").alias("smallest"),
        F.max("payment_value").alias("largest"),
        F.count_distinct("payment_method").alias("methods"),
    ),
)
_simple(
    "G10_global_statistics",
    """select cast(sum(cast(payment_value as decimal(18,4))) as double) / count(*) as mean_value,
       round(stddev_samp(payment_value), 3) as std_value, round(var_samp(payment_value), -4) as var_value,
       round(quantile_cont(payment_value, 0.25) + 1e-7, 4) as q1, round(quantile_cont(payment_value, 0.5) + 1e-7, 4) as q2,
       round(quantile_cont(payment_value, 0.75) + 1e-7, 4) as q3 from v_payments""",
    lambda t: rounded(
        rounded(
            t.payments()
            .agg(
                e.money_avg("payment_value").alias("mean_value"),
                F.stddev_samp("payment_value").alias("std_value"),
                F.var_samp("payment_value").alias("var_value"),
            )
            .withColumn(
                "_q",
                exact_quantiles(t.payments(), [], "payment_value", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
                .select(F.struct("q1", "q2", "q3"))
                .scalar(),
            )
            .select("*", "_q.*")
            .drop("_q"),
            {"std_value": 3, "var_value": -4},
        ),
        {"q1": 4, "q2": 4, "q3": 4},
        nudge=1e-7,
    ),
)
_simple(
    "G11_global_median",
    "select round(median(unit_price * quantity) + 1e-7, 4) as median_line from v_order_items",
    lambda t: rounded(
        exact_quantiles(t.order_items().withColumn("gross", e.gross_value()), [], "gross", {"median_line": 0.5}),
        {"median_line": 4},
        nudge=1e-7,
    ),
)
_simple(
    "G12_two_level_aggregation",
    """select month, cast(sum(cast(day_total as decimal(18,4))) as double) as total, max(day_total) as best_day, count(*) as days from
       (select order_date, cast(date_trunc('month', order_date) as date) as month,
        cast(sum(cast(payment_value as decimal(18,4))) as double) as day_total
        from v_orders join v_payments using (order_id) group by 1, 2) group by 1""",
    lambda t: t.orders()
    .select("order_id", "order_date")
    .join(t.payments().select("order_id", "payment_value"), "order_id")
    .groupBy("order_date")
    .agg(e.money_sum("payment_value").alias("day_total"))
    .groupBy(e.month_of("order_date").alias("month"))
    .agg(e.money_sum("day_total").alias("total"), F.max("day_total").alias("best_day"), F.count(F.lit(1)).alias("days")),
)


@query(
    "G13_correlation_matrix",
    " union all ".join(
        f"select '{a}' as metric, "
        + ", ".join(
            f"round({'case when stddev_pop(' + a + ') > 0 then 1e0 end' if a == b else f'covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)'}, 6) as {b}"
            for b in ("quantity", "unit_price", "discount_amount")
        )
        + " from v_order_items"
        for a in ("quantity", "unit_price", "discount_amount")
    ),
)
def g13(t):
    from tallyloom.operators.diagnostics import correlation_matrix

    names = ("quantity", "unit_price", "discount_amount")
    return rounded(correlation_matrix(t.order_items(), names), {n: 6 for n in names})


_simple(
    "G14_group_mean_on_rows",
    """select date, revenue, cast(sum(cast(revenue as decimal(18,4))) over w as double) / count(*) over w as year_mean
       from v_sales window w as (partition by year(date))""",
    lambda t: t.sales().select(
        "date",
        "revenue",
        e.ratio(
            F.sum(e.money("revenue")).over(W.partitionBy(F.year("date"))), F.count("revenue").over(W.partitionBy(F.year("date")))
        ).alias("year_mean"),
    ),
)
_simple(
    "G15_geometric_mean",
    """select round(exp(avg(ln(g))), 9) as growth from (select revenue / lag(revenue) over (order by year) as g from
       (select year(date) as year, cast(sum(cast(revenue as decimal(18,4))) as double) as revenue from v_sales
        where date < date '2001-01-01' group by 1))""",
    lambda t: rounded(
        t.sales()
        .filter(F.col("date") < F.lit("2001-01-01").cast("date"))
        .groupBy(F.year("date").alias("year"))
        .agg(e.money_sum("revenue").alias("revenue"))
        .select(e.ratio("revenue", F.lag("revenue").over(W.partitionBy(F.lit(0)).orderBy("year"))).alias("g"))
        .agg(F.exp(F.avg(F.ln("g"))).alias("growth")),
        {"growth": 9},
    ),
)
_simple(
    "G16_date_range",
    "select order_status, min(order_date) as first_date, max(order_date) as last_date from v_orders group by 1",
    lambda t: t.orders().groupBy("order_status").agg(F.min("order_date").alias("first_date"), F.max("order_date").alias("last_date")),
)
_simple(
    "G17_concentration",
    """select round(sum(share * share), 9) as herfindahl from (select count(*) / sum(count(*)) over () as share
       from v_order_items join v_products using (product_id) group by category)""",
    lambda t: rounded(
        r.concentration(
            r.share_of_total(
                facts.by_product_attribute(
                    t.order_items().groupBy("product_id").agg(F.count(F.lit(1)).alias("n")), t.products(), "category"
                ),
                "n",
            ),
            "share",
        ),
        {"herfindahl": 9},
    ),
)
_simple(
    "G18_variation_and_range",
    """select round(stddev_samp(n) / avg(n), 9) as cv, max(n) - min(n) as range from (select count(*) as n from v_orders group by customer_id)""",
    lambda t: rounded(
        t.orders()
        .groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(e.ratio(F.stddev_samp("n"), F.avg("n")).alias("cv"), (F.max("n") - F.min("n")).alias("range")),
        {"cv": 9},
    ),
)
_simple(
    "G19_numeric_summary",
    " union all ".join(
        f"""select series, '{c}' as metric, count({c}) as count, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std,
        min({c}) as min, round(quantile_cont({c}, 0.25) + 1e-7, 4) as q25, round(median({c}) + 1e-7, 4) as q50,
        round(quantile_cont({c}, 0.75) + 1e-7, 4) as q75, max({c}) as max from v_panel group by 1"""
        for c in ("revenue", "cogs")
    ),
    lambda t: rounded(
        rounded(
            r.numeric_summary(
                t.sales(keys=("segment",)).withColumnRenamed("segment", "series"), ["revenue", "cogs"], ["series"]
            ),
            {"mean": 4, "std": 4},
        ),
        {"q25": 4, "q50": 4, "q75": 4},
        nudge=1e-7,
    ),
)
_simple(
    "G20_arg_max",
    """select order_source, order_id as largest_order, payment_value from (select order_source, order_id, p.payment_value,
       row_number() over (partition by order_source order by p.payment_value desc, order_id) as rn
       from v_orders join v_payments p using (order_id)) where rn = 1""",
    lambda t: t.orders()
    .select("order_id", "order_source")
    .join(t.payments().select("order_id", "payment_value"), "order_id")
    .groupBy("order_source")
    .agg(F.min_by(F.struct("order_id", "payment_value"), F.struct(-F.col("payment_value"), F.col("order_id"))).alias("best"))
    .select("order_source", F.col("best.order_id").alias("largest_order"), F.col("best.payment_value").alias("payment_value")),
)

# Windows ---------------------------------------------------------------------------------------

_simple(
    "W01_days_since_previous",
    """select customer_id, order_date, n, cast(order_date - lag(order_date) over (partition by customer_id order by order_date) as integer) as gap_days
       from (select customer_id, order_date, count(*) as n from v_orders group by 1, 2)""",
    lambda t: t.orders()
    .groupBy("customer_id", "order_date")
    .agg(F.count(F.lit(1)).alias("n"))
    .withColumn(
        "gap_days", F.datediff("order_date", F.lag("order_date").over(W.partitionBy("customer_id").orderBy("order_date")))
    ),
)
_simple(
    "W02_lags",
    """select series, date, lag(revenue, 1) over w as lag_1, lag(revenue, 7) over w as lag_7, lag(revenue, 365) over w as lag_365
       from v_dense window w as (partition by series order by date)""",
    lambda t: panel_sales(t).select("series", "date", *[s.lag("revenue", k, ["series"]).alias(f"lag_{k}") for k in (1, 7, 365)]),
)
_simple(
    "W03_trailing_average",
    """select series, date, round(avg(revenue) over (partition by series order by date rows 29 preceding) + 1e-7, 4) as ma_30 from v_dense""",
    lambda t: rounded(
        panel_sales(t).select("series", "date", s.trailing(F.avg("revenue"), 30, ["series"]).alias("ma_30")), {"ma_30": 4}, nudge=1e-7
    ),
)
_simple(
    "W04_centred_average",
    """select series, date, case when count(*) over w = 365 then
       cast(sum(cast(revenue as decimal(18,4))) over w as double) / 365 end as trend
       from v_dense window w as (partition by series order by date rows between 182 preceding and 182 following)""",
    lambda t: panel_sales(t).select(
        "series",
        "date",
        (s.centred(F.sum(e.money("revenue")), "revenue", 365, ["series"]).cast("double") / 365).alias("trend"),
    ),
)
_simple(
    "W05_previous_rows_statistics",
    """select series, date, case when count(*) over w = 28 then cast(sum(cast(revenue as decimal(18,4))) over w as double) / 28 end as mean_28,
       case when count(*) over w = 28 then round(stddev_samp(revenue) over w, 4) end as std_28,
       case when count(*) over w = 28 then min(revenue) over w end as min_28,
       case when count(*) over w = 28 then max(revenue) over w end as max_28
       from v_dense window w as (partition by series order by date rows between 28 preceding and 1 preceding)""",
    lambda t: rounded(
        panel_sales(t).select(
            "series",
            "date",
            (s.previous(F.sum(e.money("revenue")), "revenue", 28, ["series"]).cast("double") / 28).alias("mean_28"),
            s.previous(F.stddev_samp("revenue"), "revenue", 28, ["series"]).alias("std_28"),
            s.previous(F.min("revenue"), "revenue", 28, ["series"]).alias("min_28"),
            s.previous(F.max("revenue"), "revenue", 28, ["series"]).alias("max_28"),
        ),
        {"std_28": 4},
    ),
)
_simple(
    "W06_percent_change",
    """select date, revenue, (revenue - p) / nullif(p, 0) as pct_change from
       (select date, revenue, lag(revenue) over (order by date) as p from v_sales)""",
    lambda t: t.sales().select(
        "date", "revenue", e.ratio(F.col("revenue") - s.lag("revenue", 1, []), s.lag("revenue", 1, [])).alias("pct_change")
    ),
)
_simple(
    "W07_dense_rank",
    """select category, segment, n, cast(dense_rank() over (partition by segment order by n) as integer) as rank_asc,
       cast(dense_rank() over (partition by segment order by n desc) as integer) as rank_desc
       from (select category, segment, count(*) as n from v_products group by 1, 2)""",
    lambda t: t.products()
    .groupBy("category", "segment")
    .agg(F.count(F.lit(1)).alias("n"))
    .withColumn("rank_asc", F.dense_rank().over(W.partitionBy("segment").orderBy("n")))
    .withColumn("rank_desc", F.dense_rank().over(W.partitionBy("segment").orderBy(F.col("n").desc()))),
)
_simple(
    "W08_row_position",
    "select series, date, cast(row_number() over (partition by series order by date) - 1 as integer) as step from v_dense",
    lambda t: panel_sales(t).select("series", "date", s.row_position(["series"]).alias("step")),
)
_simple(
    "W09_first_and_last",
    "select series, arg_min(revenue, date) as first_revenue, arg_max(revenue, date) as last_revenue from v_dense group by 1",
    lambda t: panel_sales(t)
    .groupBy("series")
    .agg(F.min_by("revenue", "date").alias("first_revenue"), F.max_by("revenue", "date").alias("last_revenue")),
)
_simple(
    "W10_share_of_total",
    """select segment, category, n, n / sum(n) over (partition by segment) as share from
       (select segment, category, count(*) as n from v_products group by 1, 2)""",
    lambda t: r.share_of_total(
        t.products().groupBy("segment", "category").agg(F.count(F.lit(1)).alias("n")), "n", within=["segment"]
    ),
)
_simple(
    "W11_expanding_past_median",
    """select series, date, round(median(revenue) over (partition by series, dayofyear(date) order by date
       rows between unbounded preceding and 1 preceding) + 1e-7, 4) as past_median from v_dense""",
    lambda t: rounded(
        panel_sales(t).select(
            "series",
            "date",
            F.percentile("revenue", F.lit(0.5))
            .over(
                W.partitionBy("series", F.dayofyear("date")).orderBy("date").rowsBetween(W.unboundedPreceding, -1)
            )
            .alias("past_median"),
        ),
        {"past_median": 4},
        nudge=1e-7,
    ),
)

# Sorts, limits, set operations -----------------------------------------------------------------

_simple(
    "K01_multi_key_sort",
    "select segment, price, product_id from v_products order by segment, price desc, product_id",
    lambda t: t.products().select("segment", "price", "product_id").orderBy("segment", F.col("price").desc(), "product_id"),
)
_simple(
    "K02_top_group",
    "select category, count(*) as n from v_products group by 1 order by n desc, category limit 1",
    lambda t: r.top_n(t.products().groupBy("category").agg(F.count(F.lit(1)).alias("n")), 1, n=False, category=True),
)
_simple(
    "K03_top_ten",
    "select order_id, payment_value from v_payments order by payment_value desc, order_id limit 10",
    lambda t: r.top_n(t.payments().select("order_id", "payment_value"), 10, payment_value=False, order_id=True),
)


@query(
    "K04_nearest_reference",
    """select product_id, (select k from (values ('950', 950e0), ('1000', 1000e0), ('1050', 1050e0)) o(k, v) order by abs(price - v), k limit 1) as nearest
       from v_products""",
)
def k04(t):
    near = r.nearest_reference("price", {"950": 950.0, "1000": 1000.0, "1050": 1050.0})
    return t.products().select("product_id", near["label"].alias("nearest"))


_simple(
    "U01_union_all",
    "select order_id, 'return' as kind from v_returns union all select order_id, 'line' from v_order_items",
    lambda t: t.returns()
    .select("order_id", F.lit("return").alias("kind"))
    .unionByName(t.order_items().select("order_id", F.lit("line").alias("kind"))),
)
_simple(
    "U02_key_difference",
    """select order_id, 'left_only' as side from (select order_id from v_orders except select order_id from v_returns)
       union all select order_id, 'right_only' from (select order_id from v_returns except select order_id from v_orders)""",
    lambda t: r.key_difference(t.orders(), t.returns(), "order_id"),
)
_simple(
    "U03_distinct",
    "select distinct customer_id, order_status from v_orders",
    lambda t: t.orders().select("customer_id", "order_status").distinct(),
)

# Scalar functions ------------------------------------------------------------------------------

_simple(
    "C01_date_parse",
    "select event_id, try_cast(props as date) as props_date, cast(cast(ts as varchar) as date) as ts_date from events",
    lambda t: t.base("events").select(
        "event_id", F.try_to_date("props").alias("props_date"), F.to_date(F.date_format("ts", "yyyy-MM-dd")).alias("ts_date")
    ),
)
_simple(
    "C02_date_parts",
    """select order_id, cast(year(order_date) as integer) as y, cast(month(order_date) as integer) as m, cast(day(order_date) as integer) as d,
       cast(quarter(order_date) as integer) as q, cast(dayofyear(order_date) as integer) as doy from v_orders""",
    lambda t: t.orders().select(
        "order_id",
        F.year("order_date").alias("y"),
        F.month("order_date").alias("m"),
        F.dayofmonth("order_date").alias("d"),
        F.quarter("order_date").alias("q"),
        F.dayofyear("order_date").alias("doy"),
    ),
)
_simple(
    "C03_weekday_monday_first",
    "select order_id, cast(isodow(order_date) - 1 as integer) as dow from v_orders",
    lambda t: t.orders().select("order_id", F.weekday("order_date").alias("dow")),
)
_simple(
    "C04_iso_week",
    "select order_id, cast(weekofyear(order_date) as integer) as week from v_orders",
    lambda t: t.orders().select("order_id", F.weekofyear("order_date").alias("week")),
)
_simple(
    "C05_calendar_flags",
    """select order_id, case when isodow(order_date) >= 6 then 1e0 else 0e0 end as is_weekend,
       case when day(order_date) <= 3 then 1e0 else 0e0 end as is_month_start,
       case when day(order_date) >= 28 then 1e0 else 0e0 end as is_month_end from v_orders""",
    lambda t: t.orders().select(
        "order_id",
        *[c.alias(n) for n, c in e.calendar_columns("order_date").items() if n in ("is_weekend", "is_month_start", "is_month_end")],
    ),
)
_simple(
    "C06_month_bucket",
    "select order_id, cast(date_trunc('month', order_date) as date) as month from v_orders",
    lambda t: t.orders().select("order_id", e.month_of("order_date").alias("month")),
)
_simple(
    "C07_date_arithmetic",
    """select order_id, ship_date, cast(delivery_date - ship_date as integer) as days, ship_date + 30 as due,
       strftime(ship_date, '%Y-%m-%d') as ship_text from v_shipments""",
    lambda t: t.shipments().select(
        "order_id",
        "ship_date",
        F.datediff("delivery_date", "ship_date").alias("days"),
        F.date_add("ship_date", 30).alias("due"),
        F.date_format("ship_date", "yyyy-MM-dd").alias("ship_text"),
    ),
)
_simple(
    "C08_strings",
    """select product_id, lower(category) as low, trim(product_name) as trimmed, starts_with(category, 'Brand#1') as starts,
       regexp_matches(product_name, 'r[a-e]d|ring') as matches from v_products""",
    lambda t: t.products().select(
        "product_id",
        F.lower("category").alias("low"),
        F.trim("product_name").alias("trimmed"),
        F.startswith("category", F.lit("Brand#1")).alias("starts"),
        F.col("product_name").rlike("r[a-e]d|ring").alias("matches"),
    ),
)
_simple(
    "C09_mathematics",
    f"""select event_id, sqrt(value) as root, round(sin(value), 9) as sine, round(cos(2 * {math.pi!r}e0 * value / 365.25e0), 9) as cosine,
       round(pow(value, 2), 6) as squared, greatest(value, 50e0) as larger, least(value, 50e0) as smaller from events""",
    lambda t: rounded(
        t.base("events").select(
            "event_id",
            F.sqrt("value").alias("root"),
            F.sin("value").alias("sine"),
            F.cos(F.lit(2 * math.pi) * F.col("value") / F.lit(365.25)).alias("cosine"),
            F.pow("value", F.lit(2.0)).alias("squared"),
            F.greatest("value", F.lit(50.0)).alias("larger"),
            F.least("value", F.lit(50.0)).alias("smaller"),
        ),
        {"sine": 9, "cosine": 9, "squared": 6},
    ),
)
