"""The fourteen logical retail tables, from CSV files or from a star-schema Parquet folder."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.expr import money_sum, ratio
from tallyloom.operators.facts import sales_by_day
from tallyloom.sources import readers
from tallyloom.sources.schemas import REGISTRY
from tallyloom.session import store

_NTZ = T.TimestampNTZType()

STAR_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
    "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}

#: Every table of the folder, also those that no retail view is made of.
GIVEN_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

# Events lie in 2024, orders in 1995-2001: whole days between the two, so that date joins meet.
EVENT_SHIFT_DAYS = 9496

# First character of the order priority to the order's attributes.
PRIORITY_METHOD = {"1": "credit_card", "2": "cod", "3": "paypal", "4": "bank_transfer", "5": "wallet"}
PRIORITY_SOURCE = {"1": "view", "2": "click", "3": "signup", "4": "purchase", "5": "error"}
PRIORITY_INSTALLMENTS = {"1": 1, "2": 3, "3": 6, "4": 12, "5": 24}
RETURN_REASONS = {0: "defective", 1: "wrong_size", 2: "changed_mind", 3: "not_as_described"}


def _choose(key, mapping: dict):
    """Small fixed mapping as a CASE expression."""
    out = None
    for k, v in mapping.items():
        out = F.when(key == F.lit(k), F.lit(v)) if out is None else out.when(key == F.lit(k), F.lit(v))
    return out


class StarTables:
    """Retail tables derived lazily from orders, lineitem, part, customer, nation, region, events.

    Each method is a plan only; nothing is read until an action runs. Columns that a caller does
    not use are pruned down to the Parquet scan.
    """

    # What the questions and the window check expect of this data.
    question_category = "Brand#1"
    sales_window = ("1995-01-01", "2001-08-01")
    horizon_window = ("2001-08-02", "2003-01-31")

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory

    def base(self, name: str) -> DataFrame:
        reader = self.spark.read
        if name in STAR_SCHEMAS:
            reader = reader.schema(STAR_SCHEMAS[name])
        return reader.parquet(f"{self.directory}/{name}.parquet")

    def products(self) -> DataFrame:
        size = F.col("p_size")
        return self.base("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_brand").alias("category"),
            F.col("p_type").alias("segment"),
            F.when(size <= 12, "S").when(size <= 25, "M").when(size <= 38, "L").otherwise("XL").alias("size"),
            F.col("p_retailprice").alias("price"),
            (F.col("p_retailprice") * (F.lit(0.4) + size / F.lit(100.0))).alias("cogs"),
        )

    def customers(self) -> DataFrame:
        balance = F.col("c_acctbal")
        return self.base("customer").select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_nationkey").alias("zip"),
            F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("acquisition_channel"),
            F.when(balance < 0, F.lit(None))
            .when(balance < 2500, "25-34")
            .when(balance < 5000, "35-44")
            .when(balance < 7500, "45-54")
            .otherwise("55+")
            .alias("age_group"),
        )

    def geography(self) -> DataFrame:
        nation = self.base("nation")
        region = self.base("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            F.col("n_nationkey").alias("zip"), F.col("n_name").alias("city"), F.col("r_name").alias("region")
        )

    def orders(self) -> DataFrame:
        """Orders without the delivery zip; see ``orders_with_zip``."""
        priority = F.substring("o_orderpriority", 1, 1)
        status = F.col("o_orderstatus")
        return self.base("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.to_date("o_orderdate").alias("order_date"),
            F.col("o_custkey").alias("customer_id"),
            F.when(status == "P", "cancelled")
            .when(status == "O", "shipped")
            .when(F.col("o_orderkey") % 4 == 0, "returned")
            .otherwise("delivered")
            .alias("order_status"),
            _choose(priority, PRIORITY_METHOD).alias("payment_method"),
            _choose(priority, PRIORITY_SOURCE).alias("order_source"),
        )

    def orders_with_zip(self) -> DataFrame:
        """The zip is the customer's, so this view costs a join; ask for it only where zip is used.

        An order of an unknown customer stays, without a zip.
        """
        return self.orders().join(self.customers().select("customer_id", "zip"), "customer_id", "left")

    def order_items(self) -> DataFrame:
        pct = F.round(F.col("l_discount") * 100).cast("int")
        return self.base("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("long").alias("quantity"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
            (F.col("l_extendedprice") * F.col("l_discount")).alias("discount_amount"),
            F.when(F.col("l_discount") > 0, F.concat(F.lit("PROMO-"), pct.cast("string"))).alias("promo_id"),
            F.lit(None).cast("string").alias("promo_id_2"),
        )

    def promotions(self) -> DataFrame:
        pct = F.round(F.col("l_discount") * 100).cast("int")
        return (
            self.base("lineitem")
            .filter(F.col("l_discount") > 0)
            .groupBy(pct.alias("pct"))
            .agg(
                F.to_date(F.min("l_shipdate")).alias("start_date"),
                F.to_date(F.max("l_shipdate")).alias("end_date"),
            )
            .select(
                F.concat(F.lit("PROMO-"), F.col("pct").cast("string")).alias("promo_id"),
                F.col("pct").cast("double").alias("discount_value"),
                "start_date",
                "end_date",
            )
        )

    def payments(self) -> DataFrame:
        priority = F.substring("o_orderpriority", 1, 1)
        return self.base("orders").select(
            F.col("o_orderkey").alias("order_id"),
            _choose(priority, PRIORITY_METHOD).alias("payment_method"),
            F.col("o_totalprice").alias("payment_value"),
            _choose(priority, PRIORITY_INSTALLMENTS).alias("installments"),
        )

    def shipments(self) -> DataFrame:
        return (
            self.base("lineitem")
            .groupBy(F.col("l_orderkey").alias("order_id"))
            .agg(
                F.to_date(F.min("l_shipdate")).alias("ship_date"),
                F.to_date(F.max("l_shipdate")).alias("delivery_date"),
            )
        )

    def returns(self) -> DataFrame:
        return self.base("lineitem").filter(F.col("l_returnflag") == "R").select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias(
                "return_id"
            ),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.to_date("l_shipdate").alias("return_date"),
            _choose(F.col("l_linenumber") % 4, RETURN_REASONS).alias("return_reason"),
            F.ceil(F.col("l_quantity") / 10).alias("return_quantity"),
            (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("refund_amount"),
        )

    def reviews(self) -> DataFrame:
        return self.base("events").filter(F.col("event_type") == "purchase").select(
            F.col("event_id").alias("review_id"),
            F.col("event_id").alias("order_id"),
            F.col("user_id").alias("customer_id"),
            F.to_date("ts").alias("review_date"),
            (F.floor(F.col("value") / 50) + 1).cast("int").alias("rating"),
        )

    def sales(self, keys: tuple[str, ...] = ()) -> DataFrame:
        return sales_by_day(self.order_items(), self.orders(), self.products(), keys)

    def web_traffic(self) -> DataFrame:
        return (
            self.base("events")
            .groupBy(
                F.date_sub(F.to_date("ts"), EVENT_SHIFT_DAYS).alias("date"),
                F.col("event_type").alias("traffic_source"),
            )
            .agg(
                F.count(F.lit(1)).alias("sessions"),
                F.count_distinct("user_id").alias("unique_visitors"),
                F.floor(money_sum("value")).alias("page_views"),
                F.avg(F.when(F.col("value") < 15, F.lit(1.0)).otherwise(F.lit(0.0))).alias("bounce_rate"),
                ratio(money_sum("value"), F.count(F.lit(1))).alias("avg_session_duration_sec"),
            )
        )

    def inventory(self) -> DataFrame:
        grouped = (
            self.base("lineitem")
            .groupBy(
                F.last_day(F.to_date("l_shipdate")).alias("snapshot_date"), F.col("l_partkey").alias("product_id")
            )
            .agg(F.sum(F.col("l_quantity").cast("long")).alias("units_sold"))
        )
        sold = F.col("units_sold")
        return grouped.select(
            "snapshot_date",
            "product_id",
            "units_sold",
            F.when(sold > 40, 1).otherwise(0).alias("stockout_flag"),
            F.least(F.lit(1.0), ratio(F.lit(40), sold)).alias("fill_rate"),
            ratio(F.lit(1500), sold).alias("days_of_supply"),
        )

    #: Days that a forecast covers; a CSV folder says so by its template.
    horizon_days = 548

    def horizon(self, days: int = horizon_days) -> DataFrame:
        """Forecast template: the days after the last order day, numbered from 1."""
        last = self.orders().agg(F.max("order_date").alias("last_date"))
        return last.select(
            F.posexplode(F.expr(f"sequence(date_add(last_date, 1), date_add(last_date, {days}))")).alias("pos", "date")
        ).select((F.col("pos") + 1).alias("row_id"), "date")

    def sample_submission(self) -> DataFrame:
        return self.horizon().select("date")

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)()


class SharedStarTables(StarTables):
    """For a run of many queries: a roll-up of the lines or events is written once and read by all.

    A single query reads less from its own plan, which is pruned to the columns it uses.
    """

    def _once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        with self._lock:
            lock = self._locks.setdefault(name, threading.RLock())
        with lock:
            if name not in self._kept:
                self._kept[name] = store(build(), name)
            return self._kept[name]

    def __init__(self, spark: SparkSession, directory: str):
        super().__init__(spark, directory)
        self._lock, self._locks, self._kept = threading.RLock(), {}, {}

    def promotions(self) -> DataFrame:
        return self._once("promotions", super().promotions)

    def shipments(self) -> DataFrame:
        return self._once("shipments", super().shipments)

    def returns(self) -> DataFrame:
        return self._once("returns", super().returns)

    def web_traffic(self) -> DataFrame:
        return self._once("web_traffic", super().web_traffic)

    def inventory(self) -> DataFrame:
        return self._once("inventory", super().inventory)

    def sales(self, keys: tuple[str, ...] = ()) -> DataFrame:
        return self._once("-".join(("sales", *keys)), lambda: StarTables.sales(self, keys))


class CsvTables:
    """The same tables from a folder of CSV files, one file per table.

    ``sales`` is its own file; per product attribute it is rolled up from the order lines.
    """

    # The category one question asks about, and the expected date windows.
    question_category = "Streetwear"
    sales_window = ("2012-07-04", "2022-12-31")
    horizon_window = ("2023-01-01", "2024-07-01")

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory

    def raw(self, name: str) -> DataFrame:
        """All columns as text, for the audit of a file."""
        return readers.read_raw(self.spark, f"{self.directory}/{name}.csv")

    def table(self, name: str) -> DataFrame:
        return readers.read_csv_table(self.spark, self.directory, name)

    def all(self) -> dict[str, DataFrame]:
        """Every registered table, loaded lazily."""
        return {name: self.table(name) for name in REGISTRY.tables}

    def orders_with_zip(self) -> DataFrame:
        return self.table("orders")

    def sales(self, keys: tuple[str, ...] = ()) -> DataFrame:
        if not keys:
            return self.table("sales").filter(F.col("date").isNotNull())
        return sales_by_day(self.table("order_items"), self.table("orders"), self.table("products"), keys)

    @property
    def horizon_days(self) -> int:
        """Rows of the template file, counted once."""
        if "_horizon_days" not in self.__dict__:
            self._horizon_days = self.table("sample_submission").count()
        return self._horizon_days

    def horizon(self) -> DataFrame:
        """Every row of the template, numbered from 1 by date; rows of one date follow each other.

        Files may be many and are read in any order, so the date says where a row belongs. The one
        window holds the template, which has a row per day of the forecast.
        """
        rows = self.table("sample_submission").select("date")
        place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("date").asc_nulls_last()))
        return rows.select(place.cast("bigint").alias("row_id"), "date")

    def __getattr__(self, name: str) -> Callable[[], DataFrame]:
        if name in REGISTRY.tables:
            return lambda: self.table(name)
        raise AttributeError(name)


def open_tables(spark: SparkSession, directory: str, kind: str) -> StarTables | CsvTables:
    """For a whole run: ``star`` for the Parquet star schema, ``csv`` for the folder of CSV files."""
    return {"star": SharedStarTables, "csv": CsvTables}[kind](spark, directory)
