"""Order lines summed to the grain the next join needs.

A join multiplies nothing and meets no hot key when its large side has been summed to the join
key first: lines to orders, orders to customers, lines to products. Every roll-up by a customer
or product attribute goes through here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.expr import money, net_value


def order_totals(items: DataFrame, value: Column | None = None) -> DataFrame:
    """One row per order: exact value (a decimal expression, net value unless given), lines, units."""
    value = money(net_value()) if value is None else value
    return items.groupBy("order_id").agg(
        F.sum(value).alias("value"),
        F.count(F.lit(1)).alias("lines"),
        F.sum("quantity").alias("units"),
    )


def customer_totals(items: DataFrame, orders: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per customer (and ``extra`` order columns); lines of unknown orders keep a null key."""
    return (
        order_totals(items)
        .join(orders.select("order_id", "customer_id", *extra), "order_id", "left")
        .groupBy("customer_id", *extra)
        .agg(
            F.sum("value").alias("value"),
            F.sum("lines").alias("lines"),
            F.sum("units").alias("units"),
            F.count(F.lit(1)).alias("orders"),
        )
    )


def product_units(items: DataFrame, returns: DataFrame) -> DataFrame:
    """One row per product: units sold, lines sold, units returned, return records."""
    sold = items.groupBy("product_id").agg(
        F.sum("quantity").alias("total_quantity"), F.count(F.lit(1)).alias("order_item_rows")
    )
    back = returns.groupBy("product_id").agg(
        F.sum("return_quantity").alias("returned_quantity"),
        F.count("return_reason").alias("return_count"),
        F.count(F.lit(1)).alias("return_records"),
    )
    return sold.join(back, "product_id", "full").na.fill(0)


def by_product_attribute(per_product: DataFrame, products: DataFrame, attribute: str) -> DataFrame:
    """Sum per-product counts to a product attribute; products missing from the master drop out."""
    measures = [c for c in per_product.columns if c != "product_id"]
    return (
        per_product.join(products.select("product_id", attribute), "product_id")
        .filter(F.col(attribute).isNotNull())
        .groupBy(attribute)
        .agg(*[F.sum(c).alias(c) for c in measures])
    )


def sales_by_day(items: DataFrame, orders: DataFrame, products: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Daily revenue and cost of goods, optionally per product attribute.

    Products meet the lines after these are summed to (day, product), so that a best-seller reaches that
    join as one row per day however many lines it has.
    """
    lines = items.select("order_id", "product_id", "quantity", money(net_value()).alias("net"))
    dated = orders.select("order_id", F.col("order_date").alias("date"))
    products = products.select("product_id", "cogs", *keys)
    cost = money(F.col("quantity") * F.col("cogs"))
    per_product = lines.join(dated, "order_id").groupBy("date", "product_id")
    per_product = per_product.agg(F.sum("net").alias("net"), F.sum("quantity").alias("quantity"))
    return per_product.join(products, "product_id").groupBy(*keys, "date").agg(
        F.sum("net").cast("double").alias("revenue"), F.sum(cost).cast("double").alias("cogs")
    )
