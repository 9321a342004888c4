"""Ten business questions, each a ranking or a single number, and one table of all answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.expr import margin_rate, money, money_avg, ratio
from tallyloom.functions.quantile import bounded_quantile
from tallyloom.operators.audit import union_all
from tallyloom.operators.facts import by_product_attribute, order_totals, product_units
from tallyloom.operators.relational import nearest_reference, top_n

# Reference answers the measured numbers are matched to.
GAP_OPTIONS = {"30": 30.0, "90": 90.0, "144": 144.0, "365": 365.0}
PROMO_OPTIONS = {"12": 12.0, "25": 25.0, "39": 39.0, "54": 54.0}
INSTALLMENT_PLANS = (1, 3, 6, 12)
EQUAL_SPREAD = 0.01


def order_gaps(orders: DataFrame) -> DataFrame:
    """Days between consecutive orders of a customer, as (gap, times seen).

    Orders of one day are counted together first: n of them are n - 1 gaps of zero. A customer
    then has at most one row per calendar day, however many orders there are, and the window
    over a customer stays that small.
    """
    days = orders.filter(F.col("customer_id").isNotNull() & F.col("order_date").isNotNull())
    days = days.groupBy("customer_id", "order_date").agg(F.count(F.lit(1)).alias("n"))
    before = F.lag("order_date").over(W.partitionBy("customer_id").orderBy("order_date"))
    gaps = days.select(F.datediff("order_date", before).alias("gap"), "n")
    pairs = F.array(
        F.struct(F.col("gap").alias("gap_days"), F.lit(1).cast("long").alias("times")),
        F.struct(F.lit(0).alias("gap_days"), (F.col("n") - 1).alias("times")),
    )
    return (
        gaps.select(F.inline(pairs))
        .filter(F.col("gap_days").isNotNull() & (F.col("times") > 0))
        .groupBy("gap_days")
        .agg(F.sum("times").alias("times"))
    )


def median_order_gap(orders: DataFrame) -> DataFrame:
    """Median days between orders of repeat customers, the number of gaps, the nearest option."""
    out = order_gaps(orders).agg(
        bounded_quantile("gap_days", 0.5, "times").alias("median_gap_days"), F.sum("times").alias("num_gaps")
    )
    near = nearest_reference("median_gap_days", GAP_OPTIONS)
    return out.select("*", near["label"].alias("nearest"), near["distance"].alias("distance"))


def segment_margins(products: DataFrame) -> DataFrame:
    return (
        products.filter(F.col("segment").isNotNull())
        .groupBy("segment")
        .agg(F.avg(margin_rate()).alias("avg_margin_rate"), F.count(F.lit(1)).alias("n_products"))
    )


def return_reasons_in(returns: DataFrame, products: DataFrame, category: str) -> DataFrame:
    """Return reasons within one category; counted per product before the product join."""
    per_product = returns.filter(F.col("return_reason").isNotNull()).groupBy("product_id", "return_reason").agg(
        F.count(F.lit(1)).alias("n")
    )
    chosen = products.filter(F.col("category") == category).select("product_id")
    return (
        per_product.join(chosen, "product_id").groupBy("return_reason").agg(F.sum("n").alias("return_records"))
    )


def bounce_by_source(traffic: DataFrame) -> DataFrame:
    return (
        traffic.filter(F.col("traffic_source").isNotNull())
        .groupBy("traffic_source")
        .agg(F.avg("bounce_rate").alias("avg_bounce_rate"), F.count(F.lit(1)).alias("n_days"))
    )


def promotion_share(items: DataFrame) -> DataFrame:
    """Percentage of order lines that carry a promotion, with the nearest option."""
    out = items.agg((ratio(F.count("promo_id"), F.count(F.lit(1))) * 100.0).alias("pct_with_promo"))
    near = nearest_reference("pct_with_promo", PROMO_OPTIONS)
    return out.select("*", near["label"].alias("nearest"))


def orders_per_customer(customers: DataFrame, orders: DataFrame, active_only: bool = False) -> DataFrame:
    """Mean orders per customer by age group, over all customers or those with an order.

    ``customer_id`` is the key of customers, so rows are customers.
    """
    counts = orders.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_orders"))
    known = customers.filter(F.col("age_group").isNotNull()).select("customer_id", "age_group")
    joined = known.join(counts, "customer_id", "inner" if active_only else "left")
    return joined.groupBy("age_group").agg(
        ratio(F.coalesce(F.sum("n_orders"), F.lit(0)), F.count(F.lit(1))).alias("avg_orders_per_customer"),
        F.count(F.lit(1)).alias("n_customers"),
    )


def _by_region(per_order: DataFrame, orders: DataFrame, geography: DataFrame) -> DataFrame:
    """Order values to zips, then zips to regions: the geography join sees one row per zip."""
    per_zip = (
        per_order.join(orders.select("order_id", "zip"), "order_id").groupBy("zip").agg(F.sum("value").alias("value"))
    )
    return (
        per_zip.join(geography.select("zip", "region"), "zip")
        .filter(F.col("region").isNotNull())
        .groupBy("region")
        .agg(F.sum("value").cast("double").alias("total_revenue"))
    )


def region_by_payment(orders: DataFrame, geography: DataFrame, payments: DataFrame) -> DataFrame:
    per_order = payments.groupBy("order_id").agg(F.sum(money("payment_value")).alias("value"))
    return _by_region(per_order, orders, geography)


def region_by_items(orders: DataFrame, geography: DataFrame, items: DataFrame) -> DataFrame:
    """Unit prices summed without quantity: the unit-price basis."""
    price = F.col("unit_price").cast("decimal(28,10)")
    return _by_region(order_totals(items, price), orders, geography)


def region_comparison(by_payment: DataFrame, by_items: DataFrame) -> DataFrame:
    """Both bases per region, how far the payment totals lie apart, and the region to name."""
    both = by_payment.withColumnRenamed("total_revenue", "pay_total_revenue").join(
        by_items.withColumnRenamed("total_revenue", "item_total_revenue"), "region", "full"
    )
    every = W.partitionBy(F.lit(0))
    pay, item = F.col("pay_total_revenue"), F.col("item_total_revenue")

    def top(value):
        return F.max(F.when(value.isNotNull(), F.struct(value, F.col("region")))).over(every)["region"]

    spread = ratio(F.max(pay).over(every) - F.min(pay).over(every), F.max(pay).over(every))
    out = (
        both.withColumn("spread", spread)
        .withColumn("regions", F.count(pay).over(every))
        .withColumn("top_by_payment", top(pay))
        .withColumn("top_by_items", top(item))
    )
    return out.select(
        "region",
        "pay_total_revenue",
        "item_total_revenue",
        "spread",
        "top_by_payment",
        "top_by_items",
        F.when((F.col("regions") >= 3) & (F.col("spread") < EQUAL_SPREAD), "approximately_equal")
        .when(F.col("top_by_payment") == F.col("top_by_items"), "consensus")
        .otherwise("payment_based")
        .alias("verdict"),
    )


def methods_of_cancelled(orders: DataFrame) -> DataFrame:
    return (
        orders.filter((F.lower("order_status") == "cancelled") & F.col("payment_method").isNotNull())
        .groupBy("payment_method")
        .agg(F.count(F.lit(1)).alias("n_orders"))
    )


def return_rate_by_size(returns: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Return records over order lines."""
    summed = by_product_attribute(product_units(items, returns), products, "size")
    return summed.select(
        "size",
        "return_records",
        "order_item_rows",
        ratio("return_records", "order_item_rows").alias("return_rate"),
    )


def payment_by_installments(payments: DataFrame, plans: Sequence[int] = INSTALLMENT_PLANS) -> DataFrame:
    return (
        payments.filter(F.col("installments").isin(*plans))
        .groupBy("installments")
        .agg(money_avg("payment_value").alias("avg_payment_value"), F.count(F.lit(1)).alias("n_orders"))
    )


def answer(question: str, metric: str, df: DataFrame, value: str, detail: str) -> DataFrame:
    return df.select(
        F.lit(question).alias("question"),
        F.lit(metric).alias("metric"),
        F.col(value).cast("double").alias("value"),
        F.col(detail).cast("string").alias("detail"),
    )


def all_answers(
    orders: DataFrame,
    products: DataFrame,
    returns: DataFrame,
    traffic: DataFrame,
    items: DataFrame,
    customers: DataFrame,
    geography: DataFrame,
    payments: DataFrame,
    category: str,
) -> DataFrame:
    """One row per question: the metric, its value and the winning label; ties go to the first label."""
    regions = region_comparison(
        region_by_payment(orders, geography, payments), region_by_items(orders, geography, items)
    )
    return union_all(
        [
            answer("Q1", "median_inter_order_gap_days", median_order_gap(orders), "median_gap_days", "nearest"),
            answer(
                "Q2",
                "highest_avg_margin_segment",
                top_n(segment_margins(products), 1, avg_margin_rate=False, segment=True),
                "avg_margin_rate",
                "segment",
            ),
            answer(
                "Q3",
                "most_common_return_reason_in_category",
                top_n(return_reasons_in(returns, products, category), 1, return_records=False, return_reason=True),
                "return_records",
                "return_reason",
            ),
            answer(
                "Q4",
                "lowest_avg_bounce_source",
                top_n(bounce_by_source(traffic), 1, avg_bounce_rate=True, traffic_source=True),
                "avg_bounce_rate",
                "traffic_source",
            ),
            answer("Q5", "pct_rows_with_promo_id", promotion_share(items), "pct_with_promo", "nearest"),
            answer(
                "Q6",
                "highest_avg_orders_per_customer_by_age_group",
                top_n(orders_per_customer(customers, orders), 1, avg_orders_per_customer=False, age_group=True),
                "avg_orders_per_customer",
                "age_group",
            ),
            answer(
                "Q7",
                "highest_total_revenue_region",
                top_n(regions, 1, pay_total_revenue=False, region=True),
                "pay_total_revenue",
                "region",
            ),
            answer(
                "Q8",
                "most_used_payment_method_in_cancelled_orders",
                top_n(methods_of_cancelled(orders), 1, n_orders=False, payment_method=True),
                "n_orders",
                "payment_method",
            ),
            answer(
                "Q9",
                "highest_return_rate_by_size",
                top_n(return_rate_by_size(returns, items, products), 1, return_rate=False, size=True),
                "return_rate",
                "size",
            ),
            answer(
                "Q10",
                "highest_avg_payment_value_by_installment_plan",
                top_n(payment_by_installments(payments), 1, avg_payment_value=False, installments=True),
                "avg_payment_value",
                "installments",
            ),
        ]
    )


# The same ten answers by a second route, written as SQL: other groupings, other joins.
SECOND_ROUTE = {
    "Q1": """with d as (select customer_id, order_date, count(*) n from {orders}
        where customer_id is not null and order_date is not null group by 1, 2),
        g as (select datediff(order_date, lag(order_date) over (partition by customer_id order by order_date)) gap, 1L w from d
              union all select 0, n - 1 from d),
        c as (select gap, sum(w) w from g where gap is not null group by gap having sum(w) > 0),
        m as (select percentile(gap, 0.5, w) m from c)
        select case when abs(m - 30) <= least(abs(m - 90), abs(m - 144), abs(m - 365)) then '30'
                    when abs(m - 90) <= least(abs(m - 144), abs(m - 365)) then '90'
                    when abs(m - 144) <= abs(m - 365) then '144' else '365' end as label from m""",
    "Q2": """select min_by(segment, struct(-m, segment)) as label from
        (select segment, sum(try_divide(price - cogs, price)) / count(*) as m from {products}
         where segment is not null group by segment)""",
    "Q3": """select min_by(return_reason, struct(-n, return_reason)) as label from
        (select return_reason, sum(n) as n from
          (select product_id, return_reason, count(*) as n from {returns} where return_reason is not null group by 1, 2) r
         where exists (select 1 from {products} p where p.product_id = r.product_id and p.category = {category})
         group by return_reason)""",
    "Q4": """select min_by(traffic_source, struct(b, traffic_source)) as label from
        (select traffic_source, sum(bounce_rate) / count(bounce_rate) as b from {traffic} group by traffic_source)""",
    "Q5": """select min_by(o, struct(abs(p - cast(o as double)), o)) as label from
        (select avg(case when promo_id is null then 0e0 else 100e0 end) as p from {items})
        lateral view explode(array('12', '25', '39', '54')) v as o""",
    "Q6": """select min_by(age_group, struct(-r, age_group)) as label from
        (select age_group, sum(n) / sum(c) as r from
          (select age_group, cast(0 as bigint) as n, count(*) as c from {customers} group by age_group
           union all select age_group, sum(n), 0 from (select customer_id, count(*) as n from {orders} group by 1)
           join {customers} using (customer_id) group by age_group)
         where age_group is not null group by age_group)""",
    "Q7": """select min_by(region, struct(-v, region)) as label from
        (select region, sum(v) as v from (select zip, sum(cast(payment_value as decimal(18,4))) as v from {orders}
         left join {payments} using (order_id) group by zip) left join {geography} using (zip)
         where region is not null group by region)""",
    "Q8": """select min_by(payment_method, struct(-n, payment_method)) as label from
        (select payment_method, count_if(lower(order_status) = 'cancelled') as n from {orders}
         where payment_method is not null group by payment_method)""",
    "Q9": """select min_by(size, struct(-r, size)) as label from
        (select size, try_divide(cast(sum(b) as double), sum(s)) as r from
          (select product_id, count(*) as s, cast(0 as bigint) as b from {items} group by 1
           union all select product_id, 0, count(*) from {returns} group by 1)
         join {products} using (product_id) group by size)""",
    "Q10": """select cast(min_by(installments, struct(-m, installments)) as string) as label from
        (select installments, cast(sum(cast(payment_value as decimal(18,4))) as double) / count(payment_value) as m
         from {payments} where installments = 1 or installments = 3 or installments = 6 or installments = 12
         group by installments)""",
}


def second_route(
    orders: DataFrame,
    products: DataFrame,
    returns: DataFrame,
    traffic: DataFrame,
    items: DataFrame,
    customers: DataFrame,
    geography: DataFrame,
    payments: DataFrame,
    category: str,
) -> DataFrame:
    """Question and winning label, from the SQL above."""
    frames = dict(
        orders=orders, products=products, returns=returns, traffic=traffic, items=items, customers=customers,
        geography=geography, payments=payments,
    )
    parts = []
    for question, text in SECOND_ROUTE.items():
        used = {k: v for k, v in frames.items() if "{" + k + "}" in text}
        text = text.replace("{category}", ":category")
        row = orders.sparkSession.sql(text, args={"category": category}, **used)
        parts.append(row.select(F.lit(question).alias("question"), "label"))
    return union_all(parts)
