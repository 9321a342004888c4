"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: str | Column) -> Column:
    """Fixed-point value: sums of it do not depend on the order rows arrive in."""
    return col(c).cast(MONEY)


def money_sum(c: str | Column) -> Column:
    """Exact sum of a money expression, handed on as a double."""
    return F.sum(money(c)).cast("double")


def money_avg(c: str | Column) -> Column:
    """Mean of a money expression from its exact sum; nulls do not count."""
    return ratio(money_sum(c), F.count(col(c)))


def ratio(num: str | Column, den: str | Column) -> Column:
    """Division in double precision; a zero denominator gives null."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def rate(flag: Column) -> Column:
    """Share of rows for which the flag holds; a null flag counts as not holding."""
    return ratio(F.count_if(F.coalesce(flag, F.lit(False))), F.count(F.lit(1)))


def gross_value() -> Column:
    return F.col("unit_price") * F.col("quantity")


def net_value() -> Column:
    return F.col("unit_price") * F.col("quantity") - F.col("discount_amount")


def margin_rate() -> Column:
    return ratio(F.col("price") - F.col("cogs"), "price")


def month_of(c: str | Column) -> Column:
    return F.trunc(col(c), "month")


def month_text(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def flag(c: Column) -> Column:
    """Boolean to 1.0 / 0.0, null counting as 0.0."""
    return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))


def calendar_columns(d: str | Column = "date") -> dict[str, Column]:
    """Calendar features of one date column, all doubles, Monday = 0."""
    d = col(d)
    doy = F.dayofyear(d).cast("double")
    angle = doy * F.lit(2.0 * math.pi) / F.lit(365.25)
    dow = F.weekday(d)
    day = F.dayofmonth(d)
    return {
        "dow": dow.cast("double"),
        "month": F.month(d).cast("double"),
        "day": day.cast("double"),
        "quarter": F.quarter(d).cast("double"),
        "week_of_year": F.weekofyear(d).cast("double"),
        "day_of_year": doy,
        "is_weekend": flag(dow >= 5),
        "is_month_start": flag(day <= 3),
        "is_month_end": flag(day >= 28),
        "sin_doy_1": F.sin(angle),
        "cos_doy_1": F.cos(angle),
        "sin_doy_2": F.sin(angle * 2.0),
        "cos_doy_2": F.cos(angle * 2.0),
    }
