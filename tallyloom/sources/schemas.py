"""Fixed schemas and table facts: keys, foreign keys, allowed nulls and date columns.

The audit operators are driven by these facts, so a new table needs an entry here and no code.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "date": T.DateType(),
}


@dataclass(frozen=True)
class TableSpec:
    """One logical table. ``columns`` is ``name type`` pairs; a trailing ``?`` allows nulls."""

    name: str
    columns: str
    key: tuple[str, ...] = ()
    optional_columns: str = ""

    @property
    def fields(self) -> list[tuple[str, T.DataType, bool]]:
        out = []
        for item in f"{self.columns}, {self.optional_columns}".split(","):
            if item.strip():
                name, kind = item.split()
                out.append((name, _TYPES[kind.rstrip("?")], kind.endswith("?")))
        return out

    @property
    def schema(self) -> T.StructType:
        """Every column is nullable to the reader: nulls are found by the audit, not refused."""
        return T.StructType([T.StructField(n, t, True) for n, t, _ in self.fields])

    @property
    def date_columns(self) -> list[str]:
        return [n for n, t, _ in self.fields if isinstance(t, T.DateType)]

    @property
    def expected_nulls(self) -> list[str]:
        return [n for n, _, nullable in self.fields if nullable]


@dataclass(frozen=True)
class ForeignKey:
    child: str
    child_column: str
    parent: str
    parent_column: str
    required: bool = True


@dataclass(frozen=True)
class Registry:
    tables: dict[str, TableSpec] = field(default_factory=dict)
    foreign_keys: tuple[ForeignKey, ...] = ()


_SPECS = [
    TableSpec(
        "products",
        "product_id long, product_name string, category string, segment string, size string, "
        "color string, price double, cogs double",
        ("product_id",),
    ),
    TableSpec(
        "customers",
        "customer_id long, zip int, city string, signup_date date, gender string?, "
        "age_group string?, acquisition_channel string?",
        ("customer_id",),
    ),
    TableSpec(
        "promotions",
        "promo_id string, promo_name string, promo_type string, discount_value double, "
        "start_date date, end_date date, applicable_category string?, promo_channel string?, "
        "stackable_flag int, min_order_value double?",
        ("promo_id",),
    ),
    TableSpec("geography", "zip int, city string, region string, district string", ("zip",)),
    TableSpec(
        "orders",
        "order_id long, order_date date, customer_id long, zip int, order_status string, "
        "payment_method string, device_type string, order_source string",
        ("order_id",),
    ),
    TableSpec(
        "order_items",
        "order_id long, product_id long, quantity long, unit_price double, "
        "discount_amount double, promo_id string?, promo_id_2 string?",
    ),
    TableSpec(
        "payments",
        "order_id long, payment_method string, payment_value double, installments int",
        ("order_id",),
    ),
    TableSpec(
        "shipments",
        "order_id long, ship_date date, delivery_date date, shipping_fee double",
        ("order_id",),
    ),
    TableSpec(
        "returns",
        "return_id string, order_id long, product_id long, return_date date, "
        "return_reason string, return_quantity long, refund_amount double",
        ("return_id",),
    ),
    TableSpec(
        "reviews",
        "review_id string, order_id long, product_id long, customer_id long, review_date date, "
        "rating int, review_title string",
        ("review_id",),
    ),
    TableSpec("sales", "date date, revenue double, cogs double", ("date",)),
    TableSpec("sample_submission", "date date, revenue double, cogs double", ("date",)),
    TableSpec(
        "inventory",
        "snapshot_date date, product_id long, stock_on_hand int, units_received int, "
        "units_sold long, stockout_days int, days_of_supply double, fill_rate double, "
        "stockout_flag int, overstock_flag int, reorder_flag int, sell_through_rate double, "
        "product_name string, category string, segment string, year int, month int",
        ("snapshot_date", "product_id"),
    ),
    TableSpec(
        "web_traffic",
        "date date, sessions long, unique_visitors long, page_views long, bounce_rate double, "
        "avg_session_duration_sec double, traffic_source string",
        (),
        optional_columns="conversion_rate double",
    ),
]

REGISTRY = Registry(
    tables={s.name: s for s in _SPECS},
    foreign_keys=(
        ForeignKey("customers", "zip", "geography", "zip"),
        ForeignKey("orders", "customer_id", "customers", "customer_id"),
        ForeignKey("orders", "zip", "geography", "zip"),
        ForeignKey("order_items", "order_id", "orders", "order_id"),
        ForeignKey("order_items", "product_id", "products", "product_id"),
        ForeignKey("order_items", "promo_id", "promotions", "promo_id", required=False),
        ForeignKey("order_items", "promo_id_2", "promotions", "promo_id", required=False),
        ForeignKey("payments", "order_id", "orders", "order_id"),
        ForeignKey("shipments", "order_id", "orders", "order_id"),
        ForeignKey("returns", "order_id", "orders", "order_id"),
        ForeignKey("returns", "product_id", "products", "product_id"),
        ForeignKey("reviews", "order_id", "orders", "order_id"),
        ForeignKey("reviews", "product_id", "products", "product_id"),
        ForeignKey("reviews", "customer_id", "customers", "customer_id"),
        ForeignKey("inventory", "product_id", "products", "product_id"),
    ),
)
