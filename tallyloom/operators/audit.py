"""Data audit: profiles, duplicates, date coverage, rules, foreign keys and cardinality.

Every check ends in a row ``(check_group, check_name, status, failures, details)``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.expr import ratio
from tallyloom.sources.schemas import ForeignKey, TableSpec


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# Profiles --------------------------------------------------------------------------------------


def _counts(table: str, df: DataFrame) -> DataFrame:
    """Rows and non-null rows of every column from one pass, one output row per column."""
    row = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(f"_nn_{i}") for i, c in enumerate(df.columns)]
    )
    lines = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.lit(kind).alias("dtype"), F.col(f"_nn_{i}").alias("non_null"))
            for i, (c, kind) in enumerate(df.dtypes)
        ]
    )
    return row.select(F.lit(table).alias("table"), F.col("_rows").alias("rows"), F.inline(lines))


def _value_counts(table: str, df: DataFrame) -> DataFrame:
    """Rows, non-null rows and distinct values of every column from one scan and one shuffle.

    Rows are unpivoted to narrow (column, value) pairs, and equal pairs are counted on the map
    side, so a value that fills a third of a column travels as one row per task.
    """
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    counted = texts.unpivot([], df.columns, "column", "v").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    # One empty entry per column, so that an empty table still shows its columns.
    kinds = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    empty = df.sparkSession.range(0, 1, 1, 1).select(
        F.explode(F.map_keys(kinds)).alias("column"),
        F.lit(None).cast("string").alias("v"),
        F.lit(0).cast("long").alias("n"),
    )
    known = F.when(F.col("v").isNotNull(), F.col("n"))
    return (
        counted.unionByName(empty)
        .groupBy("column")
        .agg(
            F.sum("n").alias("rows"),
            F.coalesce(F.sum(known), F.lit(0).cast("long")).alias("non_null"),
            F.count("v").alias("distinct_count"),
        )
        .select(
            F.lit(table).alias("table"), "column", kinds[F.col("column")].alias("dtype"), "rows", "non_null", "distinct_count"
        )
    )


def _sketched_counts(table: str, df: DataFrame) -> DataFrame:
    """The same with approximate distinct counts: one pass, nothing but sketches is shuffled."""
    row = df.agg(*[F.approx_count_distinct(F.col(c)).alias(f"_d_{i}") for i, c in enumerate(df.columns)])
    lines = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"_d_{i}").alias("distinct_count"))
            for i, c in enumerate(df.columns)
        ]
    )
    return _counts(table, df).join(row.select(F.inline(lines)), "column")


def column_profile(tables: Mapping[str, DataFrame], approximate: bool = False) -> DataFrame:
    """Type, rows, nulls and distinct values of every column of every table."""
    one = _sketched_counts if approximate else _value_counts
    profile = union_all(one(n, df) for n, df in tables.items())
    nulls = F.col("rows") - F.col("non_null")
    return profile.select(
        "table",
        "column",
        "dtype",
        "rows",
        "non_null",
        nulls.alias("null_count"),
        F.coalesce(ratio(nulls * 100, "rows"), F.lit(0.0)).alias("null_pct"),
        "distinct_count",
    )


def missing_report(tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec]) -> DataFrame:
    """Columns that hold nulls, and whether the registry allows them."""
    counts = union_all(_counts(n, df) for n, df in tables.items())
    allowed = [(n, c) for n in tables for c in specs[n].expected_nulls]
    expected = F.lit(False)
    for table, column in allowed:
        expected = expected | ((F.col("table") == table) & (F.col("column") == column))
    nulls = F.col("rows") - F.col("non_null")
    return counts.filter(nulls > 0).select(
        "table",
        "column",
        nulls.alias("null_count"),
        ratio(nulls * 100, "rows").alias("null_pct"),
        F.when(expected, "expected_business_null").otherwise("suspicious_null").alias("classification"),
    )


# Duplicates ------------------------------------------------------------------------------------


def duplicate_count(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of each group of equal rows (or equal keys); nulls are equal."""
    columns = list(columns) if columns is not None else df.columns
    grouped = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return grouped.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0).cast("long")).alias("duplicate_count"))


def _digest(df: DataFrame) -> list[Column]:
    """128 bits of a row; equal rows have equal ones, and nulls count by their place."""
    row = [*[F.col(f"`{c}`") for c in df.columns], F.array(*[F.isnull(f"`{c}`") for c in df.columns])]
    return [F.xxhash64(*row).alias("_h1"), F.xxhash64(F.lit(1), *row).alias("_h2")]


def full_row_duplicates(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows beyond the first of each group of equal rows, per table.

    Rows travel as digests, so that a task holds two numbers a row. Only rows whose digest repeats are then
    compared whole; other rows have no equal.
    """
    repeated = {
        n: df.select(*_digest(df)).groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        for n, df in tables.items()
    }
    found = union_all(r.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table"), "n") for n, r in repeated.items())
    some = {r["table"] for r in found.collect() if r["n"]}

    def one(n: str, df: DataFrame) -> DataFrame:
        if n not in some:
            return df.sparkSession.range(1).select(F.lit(n).alias("table"), F.lit(0).cast("long").alias("duplicate_count"))
        whole = df.select("*", *_digest(df)).join(repeated[n].drop("n"), ["_h1", "_h2"], "left_semi")
        return duplicate_count(whole, df.columns).select(F.lit(n).alias("table"), "duplicate_count")

    return union_all(one(n, df) for n, df in tables.items())


def key_duplicates(tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec]) -> DataFrame:
    return union_all(
        duplicate_count(df, specs[n].key).select(
            F.lit(n).alias("table"), F.lit(",".join(specs[n].key)).alias("columns"), "duplicate_count"
        )
        for n, df in tables.items()
        if specs[n].key
    )


# Dates -----------------------------------------------------------------------------------------


def parse_date(c: str) -> Column:
    """A date from text or from a date-like column; null where it does not parse."""
    text = F.col(c).cast("string")
    return F.coalesce(F.try_to_date(text), F.to_date(F.try_to_timestamp(text)))


def has_time_part(c: str) -> Column:
    """Aggregate: does any value carry a time of day."""
    return F.coalesce(F.bool_or(F.col(c).cast("string").rlike(r"\d{2}:\d{2}|T\d{2}")), F.lit(False))


def date_coverage(tables: Mapping[str, DataFrame], date_columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """First and last date, values that do not parse, and time-of-day parts, per date column.

    All date columns of a table come from one pass over it.
    """

    def one(table: str, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        lines = []
        for c in columns:
            parsed = parse_date(c)
            lines.append(
                F.struct(
                    F.lit(c).alias("column"),
                    F.min(parsed).alias("min_date"),
                    F.max(parsed).alias("max_date"),
                    F.count_if(parsed.isNull() & F.col(c).isNotNull()).alias("parse_fail_count"),
                    has_time_part(c).alias("has_time_component"),
                )
            )
        return df.agg(F.array(*lines).alias("_lines")).select(F.lit(table).alias("table"), F.inline("_lines"))

    return union_all(one(n, tables[n], cols) for n, cols in date_columns.items() if n in tables)


# Check rows ------------------------------------------------------------------------------------


def check_row(df: DataFrame, group: str, name: str, failures: Column, details: Column | None = None) -> DataFrame:
    """One check from an aggregate over ``df``; it passes when ``failures`` is zero."""
    row = df.agg(F.coalesce(failures, F.lit(0)).cast("long").alias("failures"), *([details.alias("details")] if details is not None else []))
    if details is None:
        row = row.withColumn("details", F.concat(F.lit("invalid_rows="), F.col("failures").cast("string")))
    return row.select(
        F.lit(group).alias("check_group"),
        F.lit(name).alias("check_name"),
        F.when(F.col("failures") == 0, "PASS").otherwise("FAIL").alias("status"),
        "failures",
        "details",
    )


def rule_check(df: DataFrame, name: str, violation: Column) -> DataFrame:
    """Row rule: counts rows for which ``violation`` holds; null does not count as a violation."""
    return check_row(df, "constraint", name, F.count_if(violation))


def less_than(df: DataFrame, name: str, low: str, high: str) -> DataFrame:
    return rule_check(df, name, F.col(low) >= F.col(high))


def date_order(df: DataFrame, name: str, first: str, last: str) -> DataFrame:
    return rule_check(df, name, F.col(first) > F.col(last))


def in_range_strict(df: DataFrame, name: str, column: str, low: float, high: float) -> DataFrame:
    """Range rule that a null breaks."""
    return rule_check(df, name, ~F.coalesce(F.col(column).between(low, high), F.lit(False)))


def ratio_range(df: DataFrame, name: str, column: str) -> DataFrame:
    """Null-tolerant range rule 0..1."""
    return rule_check(df, name, (F.col(column) < 0) | (F.col(column) > 1))


def optional_ratio_range(df: DataFrame, name: str, column: str) -> DataFrame | None:
    """The same for a column that a delivery may lack; no check then."""
    return ratio_range(df, name, column) if column in df.columns else None


# Keys ------------------------------------------------------------------------------------------


def orphan_keys(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Distinct child keys without a parent, with their row counts.

    Equal keys are counted before the join, so a key shared by a third of all rows arrives as one
    row. A null key is an orphan.
    """
    keys = child.groupBy(F.col(child_column).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    parents = parent.select(F.col(parent_column).alias("_key"))
    return keys.join(parents, "_key", "left_anti")


def _tagged(sides: Mapping[str, Column], tables: Mapping[str, DataFrame], extra: Mapping[str, Column] = {}) -> DataFrame:
    """(_key, _side, ...) of all sides below each other; ``extra`` columns are those of the first side."""
    parts = [
        tables[name].select(key.alias("_key"), F.lit(name).alias("_side"), *([c.alias(n) for n, c in extra.items()] if i == 0 else []))
        for i, (name, key) in enumerate(sides.items())
    ]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def _rows_of(side: str) -> Column:
    return F.count_if(F.col("_side") == side)


def _parent_report(parent: str, column: str, keys: Sequence[ForeignKey], tables: Mapping[str, DataFrame]) -> DataFrame:
    """All foreign keys into one parent: one row per key of any side, in one shuffle and without a join.

    Rows are counted on the map side first, so a key that a third of all rows share is one row a task.
    """
    sides = {"parent": F.col(column)}
    rows = {"parent": tables[parent]}
    for i, fk in enumerate(keys):
        child = tables[fk.child]
        sides[f"c{i}"] = F.col(fk.child_column)
        rows[f"c{i}"] = child if fk.required else child.filter(F.col(fk.child_column).isNotNull())
    per_key = _tagged(sides, rows).groupBy("_key").agg(*[_rows_of(s).alias(s) for s in sides])
    known = (F.col("parent") > 0) & F.col("_key").isNotNull()
    zero = F.lit(0).cast("long")
    totals = per_key.agg(
        *[F.coalesce(F.sum(f"c{i}"), zero).alias(f"n{i}") for i in range(len(keys))],
        *[F.coalesce(F.sum(F.when(~known, F.col(f"c{i}"))), zero).alias(f"bad{i}") for i in range(len(keys))],
    )
    lines = [
        F.struct(
            F.lit(fk.child).alias("child_table"), F.lit(fk.child_column).alias("child_column"),
            F.lit(fk.parent).alias("parent_table"), F.lit(fk.parent_column).alias("parent_column"),
            F.lit(fk.required).alias("required_fk"), F.col(f"n{i}").alias("checked_rows"),
            F.col(f"bad{i}").alias("invalid_fk_count"), F.when(F.col(f"bad{i}") == 0, "PASS").otherwise("FAIL").alias("status"),
        )
        for i, fk in enumerate(keys)
    ]
    return totals.select(F.inline(F.array(*lines)))


def foreign_key_check(fk: ForeignKey, child: DataFrame, parent: DataFrame) -> DataFrame:
    """Rows checked and rows whose key has no parent; an optional key may be null."""
    # A table may refer to itself.
    return _parent_report("parent", fk.parent_column, [replace(fk, child="child")], {"child": child, "parent": parent}).withColumn(
        "child_table", F.lit(fk.child)
    )


def foreign_key_report(keys: Iterable[ForeignKey], tables: Mapping[str, DataFrame]) -> DataFrame:
    """All registered foreign keys whose columns are present, those of one parent together."""
    by_parent: dict[tuple[str, str], list[ForeignKey]] = {}
    for fk in keys:
        if (
            fk.child in tables
            and fk.parent in tables
            and fk.child_column in tables[fk.child].columns
            and fk.parent_column in tables[fk.parent].columns
        ):
            by_parent.setdefault((fk.parent, fk.parent_column), []).append(fk)
    return union_all(_parent_report(parent, column, found, tables) for (parent, column), found in by_parent.items())


# Cardinality -----------------------------------------------------------------------------------


def _both_sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Row counts of each key on both sides, zero where it is absent."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("left_rows"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("right_rows"))
    return a.join(b, key, "full").na.fill(0)


def one_to_one(left: DataFrame, right: DataFrame, key: str, name: str, child: str) -> DataFrame:
    """Each key once on the right for each key on the left, and none more."""
    missing = F.count_if((F.col("left_rows") > 0) & (F.col("right_rows") == 0))
    extra = F.count_if((F.col("left_rows") == 0) & (F.col("right_rows") > 0))
    dup = F.coalesce(F.sum(F.when(F.col("right_rows") > 0, F.col("right_rows") - 1)), F.lit(0))
    details = F.concat(
        F.lit(f"missing_{child}="), missing.cast("string"), F.lit(f"; extra_{child}="), extra.cast("string"),
        F.lit(f"; {child}_duplicates="), dup.cast("string"),
    )
    return check_row(_both_sides(left, right, key), "cardinality", name, missing + extra + dup, details)


def one_to_optional(parent: DataFrame, child: DataFrame, key: str, name: str) -> DataFrame:
    """At most one child row per parent, and no child without a parent."""
    dup = F.coalesce(F.sum(F.when(F.col("right_rows") > 0, F.col("right_rows") - 1)), F.lit(0))
    orphan = F.coalesce(F.sum(F.when(F.col("left_rows") == 0, F.col("right_rows"))), F.lit(0))
    details = F.concat(
        F.lit("duplicates="), dup.cast("string"), F.lit("; invalid_links="), orphan.cast("string")
    )
    return check_row(_both_sides(parent, child, key), "cardinality", name, dup + orphan, details)


def status_requires_child(
    parent: DataFrame, child: DataFrame, key: str, status: str, values: Sequence[str], name: str
) -> DataFrame:
    """Parents in one of the states that have no child row."""
    wanted = parent.filter(F.lower(status).isin(*values)).select(key).distinct()
    return check_row(wanted.join(child.select(key), key, "left_anti"), "cardinality", name, F.count(F.lit(1)))


def child_links(parent: DataFrame, child: DataFrame, key: str, name: str) -> DataFrame:
    """Child rows whose parent does not exist."""
    return check_row(orphan_keys(child, key, parent, key), "cardinality", name, F.sum("n"))


def child_requires_status(
    parent: DataFrame, child: DataFrame, key: str, status: str, value: str, name: str
) -> DataFrame:
    """Child rows whose parent is not in the state they imply."""
    return child_links(parent.filter(F.lower(status) == value), child, key, name)


def cardinality_checks(
    parent: DataFrame, key: str, status: str, children: Mapping[str, DataFrame], specs: Sequence[tuple]
) -> DataFrame:
    """Several cardinality checks of one parent from one row per key, in one shuffle and without a join.

    A spec is (kind, check name, child, ...): ("one_to_one", name, child), ("one_to_optional", name, child),
    ("status_requires", name, child, states), ("links", name, child), ("requires_status", name, child, state).
    The rows are those of the checks above.
    """
    states = sorted({s for kind, _, _, *more in specs for s in (more[0] if kind == "status_requires" else more)})
    sides = {"_parent": F.col(key), **{name: F.col(key) for name in children}}
    tagged = _tagged(sides, {"_parent": parent, **children}, {"_state": F.lower(status)})
    per_key = tagged.groupBy("_key").agg(
        *[_rows_of(s).alias(s) for s in sides], *[F.count_if(F.col("_state") == s).alias(f"_is_{s}") for s in states]
    )
    has_key = F.col("_key").isNotNull()
    there = (F.col("_parent") > 0) & has_key
    zero = F.lit(0).cast("long")

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), zero)

    sums, lines = {}, []
    for i, (kind, name, child, *more) in enumerate(specs):
        n = F.col(child)
        dup = total(F.when(n > 0, n - 1))
        unlinked = total(F.when(~there, n))
        text = lambda c: F.col(c).cast("string")
        first, second, third = f"a{i}", f"b{i}", f"c{i}"
        if kind == "one_to_one":
            of_parent = F.col("_parent") > 0
            sums |= {first: F.count_if(of_parent & (n == 0)), second: F.count_if(~of_parent & (n > 0)), third: dup}
            failures = F.col(first) + F.col(second) + F.col(third)
            details = F.concat(F.lit(f"missing_{child}="), text(first), F.lit(f"; extra_{child}="), text(second),
                               F.lit(f"; {child}_duplicates="), text(third))
        elif kind == "one_to_optional":
            sums |= {first: dup, second: unlinked}
            failures = F.col(first) + F.col(second)
            details = F.concat(F.lit("duplicates="), text(first), F.lit("; invalid_links="), text(second))
        else:
            if kind == "status_requires":
                in_state = reduce(lambda x, y: x | y, [F.col(f"_is_{s}") > 0 for s in more[0]])
                sums[first] = F.count_if(in_state & ((n == 0) | ~has_key))
            elif kind == "links":
                sums[first] = unlinked
            else:
                sums[first] = total(F.when(~((F.col(f"_is_{more[0]}") > 0) & has_key), n))
            failures = F.col(first)
            details = F.concat(F.lit("invalid_rows="), text(first))
        lines.append(
            F.struct(
                F.lit("cardinality").alias("check_group"), F.lit(name).alias("check_name"),
                F.when(failures == 0, "PASS").otherwise("FAIL").alias("status"), failures.alias("failures"), details.alias("details"),
            )
        )
    return per_key.agg(*[c.alias(n) for n, c in sums.items()]).select(F.inline(F.array(*lines)))


def unique_grain(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    return check_row(duplicate_count(df, columns), "cardinality", name, F.sum("duplicate_count"))


def foreign_key_rows(report: DataFrame) -> DataFrame:
    """The foreign keys as check rows."""
    return report.select(
        F.lit("foreign_key").alias("check_group"),
        F.concat_ws(".", "child_table", "child_column").alias("check_name"),
        "status",
        F.col("invalid_fk_count").alias("failures"),
        F.concat(F.lit("checked_rows="), F.col("checked_rows").cast("string")).alias("details"),
    )


def roll_up(checks: DataFrame) -> DataFrame:
    """Checks per group and status, with the rows that failed."""
    return checks.groupBy("check_group", "status").agg(
        F.count(F.lit(1)).alias("checks"), F.sum("failures").alias("failures")
    )


# Forecast inputs and outputs -------------------------------------------------------------------


def window_check(df: DataFrame, name: str, first: str, last: str, date: str = "date") -> DataFrame:
    """First and last date are the expected ones."""
    a, b = F.min(date), F.max(date)
    wrong = F.when(a == F.lit(first).cast("date"), 0).otherwise(1) + F.when(b == F.lit(last).cast("date"), 0).otherwise(1)
    details = F.concat(F.coalesce(a.cast("string"), F.lit("none")), F.lit(" -> "), F.coalesce(b.cast("string"), F.lit("none")))
    return check_row(df, "window", name, wrong, details)


def output_contract(template: DataFrame, forecast: DataFrame, value: str, name: str, date: str = "date") -> DataFrame:
    """Every template day has exactly one forecast with a value, and there is no other day."""
    a = template.groupBy(date).agg(F.count(F.lit(1)).alias("wanted"))
    b = forecast.groupBy(date).agg(F.count(F.lit(1)).alias("given"), F.count(value).alias("filled"))
    joined = a.join(b, date, "full").na.fill(0)
    missing = F.count_if((F.col("wanted") > 0) & (F.col("given") == 0))
    extra = F.count_if((F.col("wanted") == 0) & (F.col("given") > 0))
    repeated = F.coalesce(F.sum(F.when(F.col("given") > F.col("wanted"), F.col("given") - F.col("wanted"))), F.lit(0))
    empty = F.coalesce(F.sum(F.col("given") - F.col("filled")), F.lit(0))
    details = F.concat(
        F.lit("missing="), missing.cast("string"), F.lit("; extra="), extra.cast("string"),
        F.lit("; repeated="), repeated.cast("string"), F.lit("; empty="), empty.cast("string"),
    )
    return check_row(joined, "forecast", name, missing + repeated + empty, details)


def fold_completeness(in_folds: DataFrame, horizon: int, keys: Sequence[str] = (), n_folds: int = 3) -> DataFrame:
    """Rows of each series in each expected fold against the horizon; a fold without rows fails."""
    rows = [F.count_if(F.col("fold_id") == k).alias(f"_{k}") for k in range(1, n_folds + 1)]
    lines = [F.struct(F.lit(k).alias("fold_id"), F.col(f"_{k}").alias("rows")) for k in range(1, n_folds + 1)]
    counted = in_folds.groupBy(*keys).agg(*rows).select(*keys, F.inline(F.array(*lines)))
    return counted.withColumn("status", F.when(F.col("rows") == horizon, "PASS").otherwise("FAIL"))


def enough_history(df: DataFrame, max_lag: int, keys: Sequence[str] = ()) -> DataFrame:
    """Days of each series and whether a forecast can use lag features, as the rollout asks."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "has_history", F.col("rows") >= max_lag
    )


# Agreement of two computations -----------------------------------------------------------------


def agreement(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """Answers of two independent computations side by side."""
    a = first.select(key, F.col(value).alias("first_value"))
    b = second.select(key, F.col(value).alias("second_value"))
    return a.join(b, key).withColumn("match", F.col("first_value") == F.col("second_value"))
