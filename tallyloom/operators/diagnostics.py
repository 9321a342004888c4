"""Diagnostic analyses: channel decomposition, cohorts, returns, funnel, anomalies, correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.expr import money, money_avg, money_sum, month_text, ratio
from tallyloom.functions.quantile import bounded_quantile, exact_quantiles
from tallyloom.functions.series import lag, series_window
from tallyloom.operators.facts import by_product_attribute, customer_totals, order_totals, product_units

CHANNEL = "acquisition_channel"


# Channel decomposition -------------------------------------------------------------------------


def daily_channel_revenue(items: DataFrame, orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Net revenue, orders and average order value by day and acquisition channel."""
    per_customer_day = customer_totals(items, orders, extra=("order_date",))
    return (
        per_customer_day.join(customers.select("customer_id", CHANNEL), "customer_id")
        .filter(F.col(CHANNEL).isNotNull() & F.col("order_date").isNotNull())
        .groupBy(F.col("order_date").alias("date"), CHANNEL)
        .agg(F.sum("value").cast("double").alias("revenue"), F.sum("orders").alias("order_count"))
        .withColumn("avg_order_value", ratio("revenue", "order_count"))
    )


def monthly_channel_revenue(daily: DataFrame) -> DataFrame:
    """Monthly sums per channel, with the mean of the daily average order values."""
    return daily.groupBy(month_text("date").alias("month"), CHANNEL).agg(
        money_sum("revenue").alias("revenue"),
        F.sum("order_count").alias("order_count"),
        F.avg("avg_order_value").alias("avg_order_value"),
    )


def monthly_channel_mix(monthly: DataFrame) -> DataFrame:
    """Each channel's share of its month's revenue."""
    total = F.sum(money("revenue")).over(W.partitionBy("month")).cast("double")
    return monthly.withColumn("total_revenue", total).withColumn("revenue_pct", ratio("revenue", "total_revenue"))


def channel_totals(items: DataFrame, orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Revenue, mean line value, orders and shares by channel.

    Shares are of all lines and all orders, those without a channel included.
    """
    by_channel = (
        customer_totals(items, orders)
        .join(customers.select("customer_id", CHANNEL), "customer_id", "left")
        .groupBy(CHANNEL)
        .agg(F.sum("value").alias("value"), F.sum("lines").alias("lines"), F.sum("orders").alias("order_count"))
    )
    every = W.partitionBy(F.lit(0))
    with_totals = by_channel.withColumn("all_value", F.sum("value").over(every).cast("double")).withColumn(
        "all_orders", F.sum("order_count").over(every)
    )
    return with_totals.filter(F.col(CHANNEL).isNotNull()).select(
        CHANNEL,
        F.col("value").cast("double").alias("total_revenue"),
        ratio("value", "lines").alias("avg_item_value"),
        "order_count",
        ratio("value", "all_value").alias("revenue_pct"),
        ratio("order_count", "all_orders").alias("orders_pct"),
    )


def channel_concentration(totals: DataFrame) -> DataFrame:
    """Sum of squared shares and the largest channel (ties go to the first name)."""
    best = F.min_by(F.struct(CHANNEL, "revenue_pct"), F.struct(-F.col("total_revenue"), F.col(CHANNEL)))
    return totals.agg(F.sum(F.pow("revenue_pct", F.lit(2.0))).alias("herfindahl"), best.alias("best")).select(
        "herfindahl", F.col(f"best.{CHANNEL}").alias("top_channel"), F.col("best.revenue_pct").alias("top_share")
    )


# Customer cohorts ------------------------------------------------------------------------------


def customer_lifetime(items: DataFrame, orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Lifetime value and order count of every customer, those without an order included."""
    totals = customer_totals(items, orders).select("customer_id", "value", "orders")
    return customers.select("customer_id", CHANNEL).join(totals, "customer_id", "left").select(
        "customer_id",
        CHANNEL,
        F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("lifetime_value"),
        F.coalesce("orders", F.lit(0).cast("long")).alias("order_count"),
        (F.coalesce("orders", F.lit(0)) > 1).alias("is_repeat"),
    )


def cohort_summary(lifetime: DataFrame) -> DataFrame:
    """Customers, lifetime value and orders by channel.

    The median lifetime value runs over all customers of a channel, so it takes the distributed
    quantile; order counts repeat, so they are counted first and the median reads the counts.
    """
    known = lifetime.filter(F.col(CHANNEL).isNotNull())
    stats = known.groupBy(CHANNEL).agg(
        F.count("customer_id").alias("customer_count"),
        money_avg("lifetime_value").alias("avg_ltv"),
        F.stddev_samp("lifetime_value").alias("std_ltv"),
        ratio(F.sum("order_count"), F.count(F.lit(1))).alias("avg_orders"),
        ratio(F.count_if("is_repeat"), F.count(F.lit(1))).alias("repeat_rate"),
    )
    median_ltv = exact_quantiles(known, [CHANNEL], "lifetime_value", {"median_ltv": 0.5})
    median_orders = (
        known.groupBy(CHANNEL, "order_count")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(CHANNEL)
        .agg(bounded_quantile("order_count", 0.5, "n").alias("median_orders"))
    )
    return stats.join(median_ltv, CHANNEL).join(median_orders, CHANNEL)


def channel_spread(cohorts: DataFrame) -> DataFrame:
    """How far apart the channels are in lifetime value and repeat rate."""
    return cohorts.agg(
        F.min("avg_ltv").alias("min_ltv"),
        F.max("avg_ltv").alias("max_ltv"),
        (F.max("avg_ltv") - F.min("avg_ltv")).alias("range_ltv"),
        ratio(F.stddev_samp("avg_ltv"), F.avg("avg_ltv")).alias("cv_ltv"),
        F.min("repeat_rate").alias("min_repeat_rate"),
        F.max("repeat_rate").alias("max_repeat_rate"),
        F.stddev_samp("repeat_rate").alias("std_repeat_rate"),
    )


# Returns ---------------------------------------------------------------------------------------


def enriched_returns(
    returns: DataFrame, products: DataFrame, orders: DataFrame, customers: DataFrame
) -> DataFrame:
    """Returns with their product, order and customer channel; unknown keys give nulls."""
    return (
        returns.join(products.select("product_id", "category", "size"), "product_id", "left")
        .join(orders.select("order_id", "customer_id"), "order_id", "left")
        .join(customers.select("customer_id", CHANNEL), "customer_id", "left")
    )


def _unit_rate(summed: DataFrame, attribute: str) -> DataFrame:
    return summed.filter(F.col("return_records") > 0).select(
        attribute,
        "returned_quantity",
        "return_count",
        "total_quantity",
        ratio("returned_quantity", "total_quantity").alias("return_rate"),
    )


def return_rate_by_product(returns: DataFrame, items: DataFrame, products: DataFrame, attribute: str) -> DataFrame:
    """Units returned over units sold by a product attribute, for values that have returns."""
    return _unit_rate(by_product_attribute(product_units(items, returns), products, attribute), attribute)


def return_rate_by_channel(
    returns: DataFrame, items: DataFrame, orders: DataFrame, customers: DataFrame
) -> DataFrame:
    """Units returned over units sold by acquisition channel, through order and customer."""
    sold = order_totals(items).select("order_id", F.col("units").alias("total_quantity"))
    back = returns.groupBy("order_id").agg(
        F.sum("return_quantity").alias("returned_quantity"),
        F.count("return_reason").alias("return_count"),
        F.count(F.lit(1)).alias("return_records"),
    )
    measures = ["total_quantity", "returned_quantity", "return_count", "return_records"]
    per_customer = (
        sold.join(back, "order_id", "full")
        .na.fill(0)
        .join(orders.select("order_id", "customer_id"), "order_id")
        .groupBy("customer_id")
        .agg(*[F.sum(m).alias(m) for m in measures])
    )
    by_channel = (
        per_customer.join(customers.select("customer_id", CHANNEL), "customer_id")
        .filter(F.col(CHANNEL).isNotNull())
        .groupBy(CHANNEL)
        .agg(*[F.sum(m).alias(m) for m in measures])
    )
    return _unit_rate(by_channel, CHANNEL)


def reason_shares(returns: DataFrame) -> DataFrame:
    """Return reasons with their share of all reasons given."""
    counted = returns.filter(F.col("return_reason").isNotNull()).groupBy("return_reason").agg(
        F.count(F.lit(1)).alias("count")
    )
    return counted.withColumn("percentage", ratio("count", F.sum("count").over(W.partitionBy(F.lit(0)))))


# Funnel ----------------------------------------------------------------------------------------


def daily_traffic(traffic: DataFrame) -> DataFrame:
    return traffic.groupBy("date", "traffic_source").agg(
        F.sum("sessions").alias("sessions"),
        F.sum("page_views").alias("page_views"),
        F.avg("bounce_rate").alias("bounce_rate"),
    )


def daily_orders_by_source(orders: DataFrame) -> DataFrame:
    known = orders.filter(F.col("order_date").isNotNull() & F.col("order_source").isNotNull())
    return known.groupBy(F.col("order_date").alias("date"), "order_source").agg(F.count(F.lit(1)).alias("order_count"))


def _funnel(traffic: DataFrame, orders: DataFrame, period: str) -> DataFrame:
    renamed = orders.withColumnRenamed("order_source", "traffic_source")
    return (
        traffic.join(renamed, [period, "traffic_source"], "left")
        .withColumn("order_count", F.coalesce("order_count", F.lit(0).cast("long")))
        .withColumn("conversion_rate", ratio("order_count", "sessions"))
        .withColumn("page_view_per_session", ratio("page_views", "sessions"))
    )


def daily_funnel(traffic: DataFrame, orders: DataFrame) -> DataFrame:
    """Sessions, views, orders and conversion by day and source."""
    return _funnel(daily_traffic(traffic), daily_orders_by_source(orders), "date")


def monthly_funnel(traffic: DataFrame, orders: DataFrame) -> DataFrame:
    """The same by month; both sides are summed to the month before they meet."""
    month = month_text("date").alias("month")
    visits = daily_traffic(traffic).groupBy(month, "traffic_source").agg(
        F.sum("sessions").alias("sessions"),
        F.sum("page_views").alias("page_views"),
        F.avg("bounce_rate").alias("bounce_rate"),
    )
    bought = daily_orders_by_source(orders).groupBy(month, "order_source").agg(
        F.sum("order_count").alias("order_count")
    )
    return _funnel(visits, bought, "month")


def funnel_summary(monthly: DataFrame) -> DataFrame:
    return monthly.groupBy("traffic_source").agg(
        F.sum("sessions").alias("total_sessions"),
        F.sum("page_views").alias("total_page_views"),
        F.sum("order_count").alias("total_orders"),
        F.avg("conversion_rate").alias("avg_conversion_rate"),
        F.avg("bounce_rate").alias("avg_bounce_rate"),
    )


def conversion_spread(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.avg("avg_conversion_rate").alias("mean_conversion_rate"),
        F.min("avg_conversion_rate").alias("min_conversion_rate"),
        F.max("avg_conversion_rate").alias("max_conversion_rate"),
        F.stddev_samp("avg_conversion_rate").alias("std_conversion_rate"),
    )


# Anomalies -------------------------------------------------------------------------------------


def statistical_flags(series: DataFrame, value: str = "revenue", keys: Sequence[str] = ()) -> DataFrame:
    """Distance from the series mean in standard deviations, and the interquartile fence."""
    w = series_window(keys)
    mean = ratio(F.sum(money(value)).over(w), F.count(value).over(w))
    q1 = F.percentile(value, F.lit(0.25)).over(w)
    q3 = F.percentile(value, F.lit(0.75)).over(w)
    v = F.col(value)
    flagged = (
        series.withColumn("mean_value", mean)
        .withColumn("std_value", F.stddev_samp(value).over(w))
        .withColumn("q1", q1)
        .withColumn("q3", q3)
        .withColumn("z_score", F.abs(ratio(v - F.col("mean_value"), "std_value")))
    )
    iqr = F.col("q3") - F.col("q1")
    outside = (v < F.col("q1") - 1.5 * iqr) | (v > F.col("q3") + 1.5 * iqr)
    return flagged.withColumn(
        "is_statistical_anomaly", F.coalesce(F.col("z_score") > 3, F.lit(False)) | F.coalesce(outside, F.lit(False))
    )


def heuristic_flags(
    series: DataFrame, value: str = "revenue", keys: Sequence[str] = (), date: str = "date"
) -> DataFrame:
    """Above three times the mean, below 0.3 of it, or more than doubled or lost since the day before.

    A rise from zero is an extreme change as well; it has no finite ratio.
    """
    w = series_window(keys)
    mean = ratio(F.sum(money(value)).over(w), F.count(value).over(w))
    v, before = F.col(value), F.col("previous_value")
    out = series.withColumn("mean_value", mean).withColumn("previous_value", lag(value, 1, keys, date))
    extreme = (F.abs(ratio(v - before, before)) > 1.0) | ((before == 0) & (v != 0))
    out = (
        out.withColumn("is_high_revenue_heuristic", F.coalesce(v > 3 * F.col("mean_value"), F.lit(False)))
        .withColumn("is_low_revenue_heuristic", F.coalesce(v < 0.3 * F.col("mean_value"), F.lit(False)))
        .withColumn("revenue_pct_change", F.abs(ratio(v - before, before)))
        .withColumn("is_extreme_change_heuristic", F.coalesce(extreme, F.lit(False)))
    )
    any_rule = (
        F.col("is_high_revenue_heuristic") | F.col("is_low_revenue_heuristic") | F.col("is_extreme_change_heuristic")
    )
    return out.withColumn("is_heuristic_anomaly", any_rule).drop("previous_value")


def classify_anomalies(
    series: DataFrame, value: str = "revenue", keys: Sequence[str] = (), date: str = "date"
) -> DataFrame:
    """Both kinds of flag and which of them agree."""
    both = heuristic_flags(statistical_flags(series, value, keys), value, keys, date)
    s, h = F.col("is_statistical_anomaly"), F.col("is_heuristic_anomaly")
    return both.withColumn(
        "anomaly_type",
        F.when(s & h, "both_methods").when(s, "statistical_only").when(h, "heuristic_only").otherwise("normal"),
    )


def anomalies_only(classified: DataFrame, value: str = "revenue", keys: Sequence[str] = ()) -> DataFrame:
    return classified.filter(F.col("anomaly_type") != "normal").select(*keys, "date", value, "z_score", "anomaly_type")


def anomaly_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("days"))


# Correlation -----------------------------------------------------------------------------------

METRICS = ("revenue", "sessions", "page_views", "bounce_rate", "return_quantity", "cogs")


def daily_metric_panel(sales: DataFrame, traffic: DataFrame, returns: DataFrame) -> DataFrame:
    """Sales days with that day's traffic and returned units, zero where there were none."""
    visits = traffic.groupBy("date").agg(
        F.sum("sessions").alias("sessions"),
        F.sum("page_views").alias("page_views"),
        F.avg("bounce_rate").alias("bounce_rate"),
    )
    back = returns.groupBy(F.col("return_date").alias("date")).agg(F.sum("return_quantity").alias("return_quantity"))
    return (
        sales.join(visits, "date", "left")
        .join(back, "date", "left")
        .na.fill(0, ["sessions", "page_views", "bounce_rate", "return_quantity"])
    )


def pearson(a: str, b: str) -> Column:
    """Correlation of two columns, null where either is constant."""
    if a == b:
        return F.when(F.stddev_pop(a) > 0, F.lit(1.0))
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlation_matrix(panel: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Square matrix from one aggregation pass, one row per metric."""
    pairs = {(a, b): f"{a}__{b}" for i, a in enumerate(metrics) for b in metrics[i:]}
    doubles = panel.select(*[F.col(m).cast("double").alias(m) for m in metrics])
    row = doubles.agg(*[pearson(a, b).alias(name) for (a, b), name in pairs.items()])
    name_of = lambda a, b: pairs.get((a, b)) or pairs[(b, a)]
    lines = F.array(
        *[F.struct(F.lit(a).alias("metric"), *[F.col(name_of(a, b)).alias(b) for b in metrics]) for a in metrics]
    )
    return row.select(F.inline(lines))


def correlations_with(panel: DataFrame, target: str = "revenue", metrics: Sequence[str] = METRICS) -> DataFrame:
    """Each metric's correlation with the target, strongest first."""
    doubles = panel.select(*[F.col(m).cast("double").alias(m) for m in metrics])
    row = doubles.agg(*[pearson(target, m).alias(f"corr_{m}") for m in metrics])
    lines = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(f"corr_{m}").alias("correlation")) for m in metrics]
    )
    return row.select(F.inline(lines)).orderBy(F.col("correlation").desc_nulls_last(), "metric")
