import datetime as dt

from pyspark.sql import functions as F

from tallyloom.operators import audit as a
from tallyloom.sources.schemas import REGISTRY, ForeignKey, TableSpec


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_profile_counts_nulls_and_distinct_values(spark):
    df = spark.createDataFrame([(1, "x"), (1, None), (2, "x")], "a int, b string")
    got = {r["column"]: r for r in rows(a.column_profile({"t": df}))}
    assert (got["a"]["rows"], got["a"]["non_null"], got["a"]["distinct_count"]) == (3, 3, 2)
    assert (got["b"]["null_count"], got["b"]["distinct_count"]) == (1, 1)
    sketched = {r["column"]: r["distinct_count"] for r in rows(a.column_profile({"t": df}, approximate=True))}
    assert sketched == {"a": 2, "b": 1}


def test_profile_of_an_empty_table(spark):
    got = rows(a.column_profile({"t": spark.createDataFrame([], "a int, b string")}))
    assert [(r["column"], r["rows"], r["null_pct"], r["distinct_count"]) for r in got] == [("a", 0, 0.0, 0), ("b", 0, 0.0, 0)]


def test_missing_report_classifies(spark):
    spec = {"t": TableSpec("t", "a int?, b int")}
    df = spark.createDataFrame([(None, None), (1, 1)], "a int, b int")
    got = {r["column"]: r["classification"] for r in rows(a.missing_report({"t": df}, spec))}
    assert got == {"a": "expected_business_null", "b": "suspicious_null"}


def test_duplicates_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (2, 1), (2, 2)], "a int, b int")
    assert rows(a.duplicate_count(df)) == [{"duplicate_count": 1}]
    assert rows(a.duplicate_count(df, ["a"])) == [{"duplicate_count": 2}]
    assert rows(a.duplicate_count(df.filter("b > 5"))) == [{"duplicate_count": 0}]


def test_date_coverage_counts_parse_failures_and_time_parts(spark):
    df = spark.createDataFrame([("2020-01-02",), ("not a date",), (None,), ("2020-03-04 10:30:00",)], "d string")
    got = rows(a.date_coverage({"t": df}, {"t": ["d"], "absent": ["x"]}))[0]
    assert (got["min_date"], got["max_date"]) == (dt.date(2020, 1, 2), dt.date(2020, 3, 4))
    assert (got["parse_fail_count"], got["has_time_component"]) == (1, True)


def test_null_rating_breaks_the_strict_range_but_not_the_ratio_range(spark):
    df = spark.createDataFrame([(0, -0.1), (6, 0.5), (None, None), (5, 1.0)], "rating int, r double")
    assert rows(a.in_range_strict(df, "n", "rating", 1, 5))[0]["failures"] == 3
    assert rows(a.ratio_range(df, "n", "r"))[0]["failures"] == 1
    assert a.optional_ratio_range(df, "n", "absent") is None


def test_foreign_key_required_and_optional(spark):
    child = spark.createDataFrame([(1,), (1,), (9,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    need = rows(a.foreign_key_check(ForeignKey("c", "k", "p", "k"), child, parent))[0]
    assert (need["checked_rows"], need["invalid_fk_count"], need["status"]) == (4, 2, "FAIL")
    free = rows(a.foreign_key_check(ForeignKey("c", "k", "p", "k", required=False), child, parent))[0]
    assert (free["checked_rows"], free["invalid_fk_count"]) == (3, 1)
    none = rows(a.foreign_key_check(ForeignKey("c", "k", "p", "k", False), child.filter("k is null"), parent))[0]
    assert (none["checked_rows"], none["invalid_fk_count"], none["status"]) == (0, 0, "PASS")


def test_cardinality_checks(spark):
    orders = spark.createDataFrame([(1, "Shipped"), (2, "delivered"), (3, "cancelled")], "id int, st string")
    child = spark.createDataFrame([(1,), (1,), (7,)], "id int")
    one = rows(a.one_to_one(orders, child, "id", "n", "child"))[0]
    assert one["details"] == "missing_child=2; extra_child=1; child_duplicates=1" and one["failures"] == 4
    assert rows(a.one_to_optional(orders, child, "id", "n"))[0]["details"] == "duplicates=1; invalid_links=1"
    assert rows(a.status_requires_child(orders, child, "id", "st", ["shipped", "delivered"], "n"))[0]["failures"] == 1
    assert rows(a.child_links(orders, child, "id", "n"))[0]["failures"] == 1
    assert rows(a.child_requires_status(orders, child, "id", "st", "delivered", "n"))[0]["failures"] == 3
    assert rows(a.unique_grain(child, ["id"], "n"))[0]["status"] == "FAIL"


def test_checks_of_one_parent_together(spark):
    orders = spark.createDataFrame([(1, "Shipped"), (2, "delivered"), (3, "cancelled"), (4, "delivered"), (4, "shipped")], "id int, st string")
    few = spark.createDataFrame([(1,), (1,), (7,), (4,)], "id int")
    many = spark.createDataFrame([(2,), (3,), (3,), (None,), (9,), (9,)], "id int")
    specs = [("one_to_one", "a", "few"), ("one_to_optional", "b", "many"), ("status_requires", "c", "few", ["shipped", "delivered"]),
             ("links", "d", "many"), ("requires_status", "e", "many", "delivered")]
    got = a.cardinality_checks(orders, "id", "st", {"few": few, "many": many}, specs)
    alone = [
        a.one_to_one(orders, few, "id", "a", "few"), a.one_to_optional(orders, many, "id", "b"),
        a.status_requires_child(orders, few, "id", "st", ["shipped", "delivered"], "c"), a.child_links(orders, many, "id", "d"),
        a.child_requires_status(orders, many, "id", "st", "delivered", "e"),
    ]
    assert sorted(map(tuple, rows(got))) == sorted(map(tuple, rows(a.union_all(alone))))
    nothing = a.cardinality_checks(orders.limit(0), "id", "st", {"few": few.limit(0), "many": many.limit(0)}, specs)
    assert {(r["status"], r["failures"]) for r in rows(nothing)} == {("PASS", 0)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_foreign_keys_of_several_children_share_a_shuffle(spark):
    parent = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    one = spark.createDataFrame([(1, 2), (3, None), (None, 5)], "k int, l int")
    keys = [ForeignKey("one", "k", "p", "k"), ForeignKey("one", "l", "p", "k", False), ForeignKey("p", "k", "p", "k"), ForeignKey("no", "k", "p", "k")]
    report = a.foreign_key_report(keys, {"one": one, "p": parent})
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning") == 1
    got = {(r["child_table"], r["child_column"]): (r["checked_rows"], r["invalid_fk_count"], r["status"]) for r in rows(report)}
    assert got == {("one", "k"): (3, 2, "FAIL"), ("one", "l"): (2, 1, "FAIL"), ("p", "k"): (4, 1, "FAIL")}


def test_roll_up(spark):
    df = spark.createDataFrame([(1,)], "v int")
    checks = a.union_all([a.rule_check(df, "good", F.col("v") > 1), a.rule_check(df, "bad", F.col("v") == 1)])
    got = {r["status"]: (r["checks"], r["failures"]) for r in rows(a.roll_up(checks))}
    assert got == {"PASS": (1, 0), "FAIL": (1, 1)}


def test_output_contract_finds_every_kind_of_break(spark):
    day = dt.date(2020, 1, 1)
    template = spark.createDataFrame([(day,), (day + dt.timedelta(1),), (day + dt.timedelta(2),)], "date date")
    given = spark.createDataFrame([(day, 1.0), (day, 1.0), (day + dt.timedelta(1), None), (day - dt.timedelta(1), 1.0)], "date date, v double")
    got = rows(a.output_contract(template, given, "v", "n"))[0]
    assert got["details"] == "missing=1; extra=1; repeated=2; empty=1" and got["status"] == "FAIL"
    fine = template.withColumn("v", F.lit(1.0))
    assert rows(a.output_contract(template, fine, "v", "n"))[0]["status"] == "PASS"


def test_registry_is_consistent():
    for fk in REGISTRY.foreign_keys:
        assert fk.child_column in REGISTRY.tables[fk.child].schema.names
        assert fk.parent_column in REGISTRY.tables[fk.parent].schema.names
    assert len(REGISTRY.tables) == 14 and len(REGISTRY.foreign_keys) == 15


def test_full_row_duplicates_compare_digests_first_and_then_rows(spark, monkeypatch):
    """Equal rows with nulls, nulls that change place, zeros of both signs; also when all digests clash."""
    from tallyloom.operators import audit

    rows = [("x", None, 0.0), ("x", None, -0.0), (None, "x", 0.0), (None, None, float("nan")), (None, None, float("nan")), ("y", "y", 1.0)]
    tables = {
        "some": spark.createDataFrame(rows, "a string, b string, c double"),
        "none": spark.range(5).toDF("a"),
        "empty": spark.range(0).toDF("a"),
    }
    want = {"some": 2, "none": 0, "empty": 0}
    plan = audit.full_row_duplicates({"none": tables["none"]})._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan  # a table without repeated digests groups no whole rows
    assert {r["table"]: r["duplicate_count"] for r in audit.full_row_duplicates(tables).collect()} == want
    clash = lambda df: [F.lit(1).cast("long").alias("_h1"), F.lit(2).cast("long").alias("_h2")]
    monkeypatch.setattr(audit, "_digest", clash)
    assert {r["table"]: r["duplicate_count"] for r in audit.full_row_duplicates(tables).collect()} == want
