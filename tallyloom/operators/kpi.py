"""Descriptive KPI tables: revenue, orders, mixes, returns, inventory and web traffic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.expr import gross_value, margin_rate, money, money_avg, money_sum, month_of, ratio
from tallyloom.functions.series import trailing
from tallyloom.operators.facts import by_product_attribute, product_units

MA_ROWS = 30


def daily_revenue(sales: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Revenue, cost, gross profit and the trailing mean of the last 30 rows."""
    total = trailing(F.sum(money("revenue")), MA_ROWS, keys)
    return (
        sales.filter(F.col("date").isNotNull())
        .select(*keys, "date", "revenue", "cogs")
        .withColumn("gross_profit", F.col("revenue") - F.col("cogs"))
        .withColumn("revenue_30d_ma", ratio(total, trailing(F.count("revenue"), MA_ROWS, keys)))
    )


def monthly_revenue(sales: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return sales.filter(F.col("date").isNotNull()).groupBy(*keys, month_of("date").alias("month")).agg(
        money_sum("revenue").alias("revenue"),
        money_sum("cogs").alias("cogs"),
        money_sum(F.col("revenue") - F.col("cogs")).alias("gross_profit"),
        money_avg("revenue").alias("avg_daily_revenue"),
    )


def month_seasonality(sales: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and median daily revenue per calendar month; groups are days, so the median is bounded."""
    return sales.filter(F.col("date").isNotNull()).groupBy(*keys, F.month("date").alias("month_num")).agg(
        money_avg("revenue").alias("avg_revenue"), F.median("revenue").alias("median_revenue")
    )


def monthly_orders(orders: DataFrame) -> DataFrame:
    return (
        orders.filter(F.col("order_date").isNotNull())
        .groupBy(month_of("order_date").alias("month"))
        .agg(F.count_distinct("order_id").alias("order_count"))
    )


def _mix(df: DataFrame, column: str, key: str, count: str) -> DataFrame:
    """Distinct keys per value of a column, null shown as ``unknown``, with percentages."""
    counted = df.groupBy(F.coalesce(column, F.lit("unknown")).alias(column)).agg(F.count_distinct(key).alias(count))
    total = F.sum(count).over(W.partitionBy(F.lit(0)))
    return counted.withColumn("share_pct", ratio(F.col(count) * 100, total))


def order_source_mix(orders: DataFrame) -> DataFrame:
    return _mix(orders.filter(F.col("order_date").isNotNull()), "order_source", "order_id", "order_count")


def acquisition_mix(customers: DataFrame) -> DataFrame:
    return _mix(customers, "acquisition_channel", "customer_id", "customer_count")


def category_revenue(items: DataFrame, products: DataFrame) -> DataFrame:
    """Gross revenue and units by category; lines are summed per product before the product join."""
    per_product = items.groupBy("product_id").agg(
        F.sum(money(gross_value())).alias("total_revenue"), F.sum("quantity").alias("total_units")
    )
    out = by_product_attribute(per_product, products, "category")
    return out.withColumn("total_revenue", F.col("total_revenue").cast("double"))


def segment_margin(products: DataFrame) -> DataFrame:
    return products.filter(F.col("segment").isNotNull()).groupBy("segment").agg(
        F.avg(margin_rate()).alias("avg_margin_rate"), F.count_distinct("product_id").alias("n_products")
    )


def return_reason_counts(returns: DataFrame) -> DataFrame:
    return returns.filter(F.col("return_reason").isNotNull()).groupBy("return_reason").agg(F.count("return_id").alias("return_records"))


def return_rate_by_category(returns: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Return records over order lines by category, zero where nothing was sold."""
    summed = by_product_attribute(product_units(items, returns), products, "category")
    return summed.select(
        "category",
        "return_records",
        "order_item_rows",
        F.coalesce(ratio("return_records", "order_item_rows"), F.lit(0.0)).alias("return_rate"),
    )


def rating_distribution(reviews: DataFrame) -> DataFrame:
    return reviews.filter(F.col("rating").isNotNull()).groupBy("rating").agg(F.count("review_id").alias("review_count"))


def inventory_health(inventory: DataFrame) -> DataFrame:
    return inventory.filter(F.col("snapshot_date").isNotNull()).groupBy(month_of("snapshot_date").alias("month")).agg(
        ratio(F.sum("stockout_flag"), F.count("stockout_flag")).alias("stockout_rate"),
        F.avg("fill_rate").alias("avg_fill_rate"),
        F.avg("days_of_supply").alias("avg_days_of_supply"),
    )


def daily_web(traffic: DataFrame) -> DataFrame:
    return traffic.groupBy("date").agg(
        F.sum("sessions").alias("sessions"),
        F.sum("unique_visitors").alias("unique_visitors"),
        F.sum("page_views").alias("page_views"),
        F.avg("bounce_rate").alias("bounce_rate"),
    )


def daily_conversion(traffic: DataFrame, orders: DataFrame) -> DataFrame:
    """Daily traffic with orders per session, zero without sessions, and trailing means."""
    per_day = orders.groupBy(F.col("order_date").alias("date")).agg(F.count_distinct("order_id").alias("order_count"))
    joined = (
        daily_web(traffic)
        .join(per_day, "date", "left")
        .withColumn("order_count", F.coalesce("order_count", F.lit(0).cast("long")))
        .withColumn("conversion_proxy", F.coalesce(ratio("order_count", "sessions"), F.lit(0.0)))
    )
    return joined.withColumn(
        "sessions_30d_ma", ratio(trailing(F.sum("sessions"), MA_ROWS, []), trailing(F.count("sessions"), MA_ROWS, []))
    ).withColumn("conversion_proxy_30d_ma", trailing(F.avg("conversion_proxy"), MA_ROWS, []))
